"""A runner for SQL logic tests: statement ok/error, query with types and sort modes, loops, connections."""

from __future__ import annotations

import re

from pyspark.sql import Row

from tidewater.plans.tokens import DialectError
from tidewater.session import Session


def expand(lines: list[str]) -> list[str]:
    """Unroll ``loop var first end`` ... ``endloop``."""
    out, i = [], 0
    while i < len(lines):
        if m := re.match(r"loop\s+(\w+)\s+(\d+)\s+(\d+)", lines[i]):
            depth, j = 1, i + 1
            while depth:
                depth += lines[j].startswith("loop ") - (lines[j].strip() == "endloop")
                j += 1
            body = expand(lines[i + 1 : j - 1])
            for k in range(int(m[2]), int(m[3])):
                out += [x.replace("${" + m[1] + "}", str(k)) for x in body]
            i = j
        else:
            out.append(lines[i])
            i += 1
    return out


def shown(value, kind: str) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, Row):
        return "{" + ", ".join(f"'{k}': {shown(v, 'T')}" for k, v in value.asDict().items()) + "}"
    if kind == "R":
        return f"{float(value):.3f}"
    if kind == "I" and not isinstance(value, str):
        return str(int(value))
    return str(value) if value != "" else "(empty)"


class Failed(AssertionError):
    """A record whose outcome is not the expected one."""


def run(session: Session, text: str, engine: str = "tidewater") -> int:
    """Run a script; returns the number of records, raises ``Failed`` at the first mismatch."""
    sessions = {"": session}
    blocks = [b.split("\n") for b in re.split(r"\n\s*\n", "\n".join(expand([x.rstrip() for x in text.split("\n") if not x.startswith("#")])))]
    done = 0
    for block in blocks:
        block = [x for x in block if x.strip()]
        skip = False
        while block and re.match(r"(skipif|onlyif)\s", block[0]):
            word, name = block.pop(0).split()[:2]
            skip |= (word == "skipif") == (name == engine)
        if not block or skip:
            continue
        head = block[0].split()
        if head[0] in ("halt",):
            break
        if head[0] not in ("statement", "query"):
            continue
        words = [w for w in head[2:] if w not in ("nosort", "rowsort", "valuesort")]
        mode = next((w for w in head[2:] if w not in words), "nosort")
        name = words[0] if words else ""
        if head[0] == "query" and name not in sessions and not name.startswith("con"):
            name = ""  # a label
        own = sessions.setdefault(name, Session(session.spark, session.database))
        cut = block.index("----") if "----" in block else len(block)
        sql, expected = "\n".join(block[1:cut]), block[cut + 1 :]
        done += 1
        if head[0] == "statement":
            try:
                result = own.execute(sql)
                if result.frame is not None:
                    result.frame.collect()
                own.flush()
            except Exception as e:  # noqa: BLE001  any failure is the statement's outcome
                if head[1] == "ok":
                    raise Failed(f"{sql}\n{e}") from e
                wanted = "\n".join(expected).removeprefix("<REGEX>:")
                if wanted and not re.search(wanted, str(e), re.DOTALL):
                    raise Failed(f"{sql}\nexpected {wanted}, got {e}") from e
            else:
                if head[1] == "error":
                    raise Failed(f"{sql}\nshould have failed")
            continue
        kinds = head[1]
        rows = [[shown(v, kinds[i] if i < len(kinds) else "T") for i, v in enumerate(r)] for r in own.sql(sql).collect()]
        rows = sorted(rows) if mode == "rowsort" else rows
        got = [v for r in rows for v in r]
        by_row = len(kinds) > 1 and len(expected) == len(rows) and all(len(x.split("\t" if "\t" in x else None)) == len(kinds) for x in expected)
        want = [v for x in expected for v in (x.split("\t" if "\t" in x else None) if by_row else x.split("\t") if "\t" in x else [x])]
        if mode == "valuesort":
            got, want = sorted(got), sorted(want)
        elif mode == "rowsort" and want and len(want) % len(kinds) == 0:
            want = [v for r in sorted(want[i : i + len(kinds)] for i in range(0, len(want), len(kinds))) for v in r]
        if got != want:
            raise Failed(f"{sql}\nexpected {want}\ngot      {got}")
    return done


__all__ = ["DialectError", "Failed", "expand", "run", "shown"]
