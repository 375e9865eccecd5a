"""SQL type names of the dialect and their Spark types."""

from __future__ import annotations

import re

from tidewater.plans.tokens import DialectError, Token, render, split

# Every integer is 64 bits, every text a string, a bare decimal has 38 digits and scale 0.
NAMES = {
    "int": "bigint", "integer": "bigint", "bigint": "bigint", "smallint": "bigint", "tinyint": "bigint",
    "float": "double", "real": "double", "double": "double",
    "text": "string", "string": "string", "varchar": "string", "char": "string", "character": "string", "uuid": "string",
    "date": "date", "boolean": "boolean", "bool": "boolean", "decimal": "decimal", "numeric": "decimal",
}
REFUSED = {"blob", "time", "timestamp", "interval", "json", "map", "array"}


def spark_type(tokens: list[Token], aliases: dict[str, str] | None = None) -> str:
    """The Spark type that a type's tokens name."""
    head, rest = tokens[0].name, tokens[1:]
    if aliases and head in aliases:
        return aliases[head]
    if head in ("row", "struct") and rest:
        fields = [f for f in split(rest[1:-1]) if f]
        return "struct<" + ",".join(f"`{f[0].name}`:{spark_type(f[1:], aliases)}" for f in fields) + ">"
    if head in REFUSED or head not in NAMES:
        raise DialectError(f"Binder Error: unsupported type {render(tokens)}")
    if NAMES[head] == "decimal":
        digits = [t.text for t in rest if t.kind == "number"]
        return f"decimal({digits[0] if digits else 38},{digits[1] if len(digits) > 1 else 0})"
    return NAMES[head]


def stored_type(kind: str) -> str:
    """The type of a table's column for a query's column: integers are 64 bits, floats doubles, NULLs texts."""
    kind = re.sub(r"\b(tinyint|smallint|int)\b(?!:)", "bigint", kind)
    return re.sub(r"\bvoid\b(?!:)", "string", re.sub(r"\bfloat\b(?!:)", "double", kind))


def type_end(tokens: list[Token], at: int) -> int:
    """Where the type that begins at ``at`` ends."""
    from tidewater.plans.tokens import closing

    end = at + 1
    if tokens[at].word == "double" and end < len(tokens) and tokens[end].word == "precision":
        end += 1
    if end < len(tokens) and tokens[end].text == "(":
        end = closing(tokens, end) + 1
    return end
