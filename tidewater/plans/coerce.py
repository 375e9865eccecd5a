"""Booleans as numbers and numbers as booleans, where Spark's analyser refuses them.

Spark tells which expression it refuses and the types of its operands.  The operand that is of the
other kind is cast at that place, and the query is analysed again, which runs nothing, until Spark
accepts it.  A query without such an expression is analysed once.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException

from tidewater.plans import tokens as T
from tidewater.plans.rewrite import sql
from tidewater.plans.tokens import Token

#: Repairs of one query; each casts an operand, so a query has no more than operands.
REPAIRS = 1000
NUMBERS = ("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE", "DECIMAL")
#: Binary operators from the loosest to the tightest.
LEVELS = (("or",), ("and",), ("=", "<", ">", "<=", ">=", "<>", "!=", "<=>", "like"), ("|",), ("^",), ("&",), ("<<", ">>"), ("+", "-", "||"), ("*", "/", "%", "div"))
_PLACES = {"first": 0, "second": 1, "third": 2}


def coerced(tokens: list[Token], analyse: Callable[[str], object]) -> tuple[object, list[Token]]:
    """What ``analyse`` gives for the query's text, and the tokens that it accepted."""
    for _ in range(REPAIRS):
        text, begins = T.spark_spans(tokens)
        try:
            return analyse(text), tokens
        except AnalysisException as e:
            repaired = _repaired(tokens, begins, e)
            if repaired is None:
                raise
            tokens = repaired
    raise RecursionError("a query needs too many casts")


def _is_number(kind: str) -> bool:
    return kind.startswith(NUMBERS)


def _number(operand: list[Token]) -> list[Token]:
    return [*sql("cast(("), *operand, *sql(") as bigint)")]


def _truth(operand: list[Token]) -> list[Token]:
    return [*sql("(("), *operand, *sql(") <> 0)")]


def _repaired(tokens: list[Token], begins: list[int], e: AnalysisException) -> list[Token] | None:
    condition, places = e.getCondition() or "", e.getQueryContext()
    if not condition.startswith("DATATYPE_MISMATCH.") or not places:
        return None
    inside = [i for i, at in enumerate(begins) if places[0].startIndex() <= at <= places[0].stopIndex()]
    if not inside:
        return None
    a, b = inside[0], inside[-1] + 1
    piece, told = tokens[a:b], e.getMessageParameters()
    kind = condition.split(".")[1]
    if piece[0].word in ("between", "in", "not"):  # the context of these leaves out the operand before
        negated = piece[0].word == "not" and len(piece) > 1 and piece[1].word in ("between", "in")
        if negated or piece[0].word != "not":
            begin = T.sum_before(tokens, a if negated or a == 0 or tokens[a - 1].word != "not" else a - 1)
            return _after_operand(tokens, begin, a, a + negated, b, kind, told)
    if kind in ("BINARY_OP_DIFF_TYPES", "BINARY_OP_WRONG_TYPE"):
        left, right = (told.get(k, told.get("actualDataType", "")).strip('"') for k in ("left", "right"))
        new = _binary(piece, left, right)
    elif kind == "UNEXPECTED_INPUT_TYPE":
        new = _argument(piece, _PLACES.get(told["paramIndex"], None), told["inputType"].strip('"'), told["requiredType"])
    elif kind == "DATA_DIFF_TYPES":
        new = _alike(piece, re.findall(r'"([^"]+)"', told["dataType"]))
    else:
        new = None
    return None if new is None else [*tokens[:a], *new, *tokens[b:]]


def _after_operand(tokens: list[Token], begin: int, a: int, word: int, b: int, kind: str, told: dict) -> list[Token] | None:
    """``x [NOT] BETWEEN y AND z`` and ``x [NOT] IN (...)``."""
    operand, rest = tokens[begin:a], tokens[a:b]
    if operand and operand[-1].word == "not":
        operand, rest = operand[:-1], [operand[-1], *rest]
    if tokens[word].word == "between":
        left, right = (told.get(k, "").strip('"') for k in ("left", "right"))
        if left == "BOOLEAN" and _is_number(right):
            return [*tokens[:begin], *_number(operand), *rest, *tokens[b:]]
        return None
    kinds = re.findall(r'"([^"]+)"', told.get("dataType", ""))
    items = T.split(tokens[word + 2 : b - 1])
    if kind != "DATA_DIFF_TYPES" or len(kinds) != len(items) + 1 or not all(k in ("BOOLEAN", "VOID") or _is_number(k) for k in kinds):
        return None
    operand = _number(operand) if kinds[0] == "BOOLEAN" else operand
    out: list[Token] = []
    for item, k in zip(items, kinds[1:], strict=True):
        out += ([Token("op", ",")] if out else []) + (_number(item) if k == "BOOLEAN" else item)
    negation = rest[: len(rest) - (b - word)]
    return [*tokens[:begin], *operand, *negation, *tokens[word : word + 2], *out, *tokens[b - 1 :]]


def _binary(piece: list[Token], left: str, right: str) -> list[Token] | None:
    if piece[0].word == "case":  # CASE x WHEN y compares x with y
        when = next(i for i, t in enumerate(piece) if t.word == "when")
        return [piece[0], *_number(piece[1:when]), *piece[when:]] if left == "BOOLEAN" and when > 1 else None
    if piece[0].kind in ("name", "quoted") and len(piece) > 1 and piece[1].text == "(" and T.closing(piece, 1) == len(piece) - 1:
        args = T.split(piece[2:-1])
        if len(args) != 2:
            return None
        first, second = (_number(x) if k == "BOOLEAN" else x for x, k in zip(args, (left, right), strict=True))
        return [*piece[:2], *first, Token("op", ","), *second, piece[-1]]
    at = _operator(piece)
    if at is None:
        return None
    a, b = piece[:at], piece[at + 1 :]
    if piece[at].word in ("and", "or"):
        if not all(k in ("BOOLEAN", "VOID") or _is_number(k) for k in (left, right)) or left == right == "BOOLEAN":
            return None
        a, b = (_truth(x) if _is_number(k) else x for x, k in ((a, left), (b, right)))
    else:
        if "BOOLEAN" not in (left, right) or not all(k in ("BOOLEAN", "VOID") or _is_number(k) for k in (left, right)):
            return None
        a, b = (_number(x) if k == "BOOLEAN" else x for x, k in ((a, left), (b, right)))
    return [*a, piece[at], *b]


def _operator(piece: list[Token]) -> int | None:
    """The operator that is applied last: the last one of the loosest level outside of brackets and CASE."""
    found: list[tuple[int, int]] = []
    depth = between = 0
    for i, t in enumerate(piece):
        if t.kind == "op":
            depth += t.text in ("(", "[", "{")
            depth -= t.text in (")", "]", "}")
        depth += t.word == "case"
        depth -= t.word == "end"
        if depth or i == 0:
            continue
        if t.word == "between":
            between += 1
        elif t.word == "and" and between:
            between -= 1
        elif piece[i - 1].text in (")", "]", "}") or piece[i - 1].word == "end" or piece[i - 1].kind in ("string", "quoted", "number", "param") or piece[i - 1].kind == "name" and piece[i - 1].word not in T.STOPS | {"div"} or piece[i - 1].word == "null":
            level = next((k for k, words in enumerate(LEVELS) if t.word in words), None)
            if level is not None:
                found.append((level, -i))
    return -min(found)[1] if found else None


def _argument(piece: list[Token], place: int | None, kind: str, required: str) -> list[Token] | None:
    """An operand of a prefix, a call or a CASE that should be a boolean or a number."""
    wrap = _truth if "BOOLEAN" in required and _is_number(kind) else _number if "NUMERIC" in required and kind == "BOOLEAN" else None
    if wrap is None or place is None:
        return None
    if piece[0].word in ("not", "-", "+"):
        return [piece[0], *wrap(piece[1:])]
    if piece[0].word == "case" and wrap is _truth:
        whens = _at_depth(piece, ("when",))
        ends = _at_depth(piece, ("then",))
        k = place // 2
        return [*piece[: whens[k] + 1], *_truth(piece[whens[k] + 1 : ends[k]]), *piece[ends[k] :]] if k < len(whens) else None
    if len(piece) > 1 and piece[1].text == "(" and T.closing(piece, 1) == len(piece) - 1:
        distinct = piece[2].word == "distinct"
        args = T.split(piece[2 + distinct : -1])
        if place >= len(args) or piece[0].word in ("sum", "avg") and len(args[0]) == 1:  # sums of boolean columns are refused
            return None
        args[place] = wrap(args[place])
        out: list[Token] = []
        for x in args:
            out += ([Token("op", ",")] if out else []) + x
        return [*piece[: 2 + distinct], *out, piece[-1]]
    return None


def _at_depth(piece: list[Token], words: tuple[str, ...]) -> list[int]:
    """Places of these words in a CASE itself, not in what it holds."""
    out, depth = [], 0
    for i, t in enumerate(piece):
        if t.kind == "op":
            depth += t.text in ("(", "[", "{")
            depth -= t.text in (")", "]", "}")
        depth += t.word == "case"
        depth -= t.word == "end"
        if depth == 1 and t.word in words:
            out.append(i)
    return out


def _alike(piece: list[Token], kinds: list[str]) -> list[Token] | None:
    """Arguments or branches that should be of one type: those that are booleans become numbers."""
    if "BOOLEAN" not in kinds or not all(k in ("BOOLEAN", "VOID") or _is_number(k) for k in kinds):
        return None
    if piece[0].word == "case":
        spans = []
        starts = _at_depth(piece, ("then", "else"))
        for i in starts:
            later = [k for k in _at_depth(piece, ("when", "else")) if k > i]
            spans.append((i + 1, min([*later, len(piece) - 1])))
    elif len(piece) > 1 and piece[1].text == "(":
        spans, at = [], 2
        for part in T.split(piece[2:-1]):
            spans.append((at, at + len(part)))
            at += len(part) + 1
    else:
        return None
    exact = len(spans) == len(kinds)
    for k in range(len(spans) - 1, -1, -1):
        a, b = spans[k]
        if not exact and [t.word for t in piece[a:b]] == ["null"]:
            continue
        if not exact or kinds[k] == "BOOLEAN":
            piece = [*piece[:a], *_number(piece[a:b]), *piece[b:]]
    return piece
