"""Rewriting the dialect's expressions and queries to Spark SQL, token by token.

Catalyst parses, analyses and optimises the result; what is rewritten are spellings that Spark lacks
and meanings that differ.  Only integer division needs types: Spark is asked to analyse the query with
both operands exposed, which runs nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from tidewater.plans import tokens as T
from tidewater.plans.tokens import DialectError, Token
from tidewater.types import NAMES, spark_type, type_end


def sql(text: str) -> list[Token]:
    return T.tokenize(text)


def _find(tokens: list[Token], word: str, start: int = 0) -> int:
    return next((i for i in range(start, len(tokens)) if tokens[i].word == word), -1)


def exclude(tokens: list[Token]) -> list[Token]:
    """``* EXCLUDE (t.a, b)`` and ``* EXCLUDE a``."""
    out, i = [], 0
    while i < len(tokens):
        if tokens[i].word == "exclude" and i and tokens[i - 1].text == "*":
            if tokens[i + 1].text == "(":
                end = T.closing(tokens, i + 1)
                names = [part[-1] for part in T.split(tokens[i + 2 : end])]
            else:
                end, names = i + 1, [tokens[i + 1]]
            out += sql("except (")
            for k, n in enumerate(names):
                out += ([Token("op", ",")] if k else []) + [n]
            out.append(Token("op", ")"))
            i = end + 1
        else:
            out.append(tokens[i])
            i += 1
    return out


def in_lists(tokens: list[Token]) -> list[Token]:
    """``x IN ()`` is false and ``x NOT IN ()`` true, for NULL too; ``x IN t`` reads the table t."""
    i = 0
    while (i := _find(tokens, "in", i)) >= 0:
        negated = i > 0 and tokens[i - 1].word == "not"
        if [t.text for t in tokens[i + 1 : i + 3]] == ["(", ")"]:
            begin = T.sum_before(tokens, i - negated)
            tokens = [*tokens[:begin], *sql("(true)" if negated else "(false)"), *tokens[i + 3 :]]
            i = begin
        elif i + 1 < len(tokens) and tokens[i + 1].kind in ("name", "quoted"):
            end = i + 2
            while end + 1 < len(tokens) and tokens[end].text == ".":
                end += 2
            tokens = [*tokens[: i + 1], *sql("(select * from"), *tokens[i + 1 : end], Token("op", ")"), *tokens[end:]]
        i += 1
    return tokens


def structs(tokens: list[Token]) -> list[Token]:
    """``{'a': 1}`` is a struct."""
    while (i := next((i for i in range(len(tokens) - 1, -1, -1) if tokens[i].text == "{"), -1)) >= 0:
        end = T.closing(tokens, i)
        out = sql("named_struct(")
        for k, part in enumerate(T.split(tokens[i + 1 : end])):
            name = part[0] if part[0].kind == "string" else Token("string", f"'{part[0].name}'")
            rest = part[2:] if part[1].text == ":" else [Token(part[1].kind, part[1].text.lstrip(":")), *part[2:]]
            out += ([Token("op", ",")] if k else []) + [name, Token("op", ",")] + rest
        tokens = [*tokens[:i], *out, Token("op", ")"), *tokens[end + 1 :]]
    return tokens


def casts(tokens: list[Token], aliases: dict[str, str]) -> list[Token]:
    """Type names after AS in CAST and after ``::``."""
    out, i, depth, casting = [], 0, 0, []
    while i < len(tokens):
        t = tokens[i]
        if t.text == "(" and t.kind == "op":
            depth += 1
            if i and tokens[i - 1].word in ("cast", "try_cast"):
                casting.append(depth)
        elif t.text == ")" and t.kind == "op":
            if casting and casting[-1] == depth:
                casting.pop()
            depth -= 1
        typed = t.text == "::" or t.word == "as" and casting and casting[-1] == depth
        if typed and tokens[i + 1].kind in ("name", "quoted") and (tokens[i + 1].name in NAMES or tokens[i + 1].name in aliases or tokens[i + 1].name == "row"):
            end = type_end(tokens, i + 1)
            out += [t, *sql(spark_type(tokens[i + 1 : end], aliases))]
            i = end
            continue
        out.append(t)
        i += 1
    return out


def functions(tokens: list[Token]) -> list[Token]:
    """TOTAL, GROUP_CONCAT, RANDOM, and sums that count NULLs, which are 0 on no rows."""
    i = len(tokens) - 2
    while i >= 0:
        if tokens[i].kind == "name" and tokens[i + 1].text == "(" and (i == 0 or tokens[i - 1].text != "."):
            word, end = tokens[i].word, T.closing(tokens, i + 1)
            inner = tokens[i + 2 : end]
            distinct = bool(inner) and inner[0].word == "distinct"
            args = T.split(inner[distinct:])
            if word == "total":  # what it becomes depends on types, see ``aggregates``
                tokens = [*tokens[:i], Token("total", "sum"), *tokens[i + 1 :]]
            elif word == "sum" and (what := _counted_nulls(inner)):
                tokens = [*tokens[:i], *sql("count_if(("), *what, *sql(") is null)"), *tokens[end + 1 :]]
            elif word == "group_concat":
                if distinct and len(args) > 1:
                    raise DialectError("Binder Error: GROUP_CONCAT(DISTINCT) takes no separator")
                if len(args) > 1 and [t.kind for t in args[1]] != ["string"]:
                    raise DialectError("Binder Error: the separator of GROUP_CONCAT must be a string literal")
                value = [*sql("cast("), *args[0], *sql(" as string)")]
                body = [*sql("listagg(distinct" if distinct else "listagg("), *value, Token("op", ","), *(args[1] if len(args) > 1 else sql("','")), *sql(") within group ( order by"), *value, *sql("asc nulls last)")]
                tokens = [*tokens[:i], *body, *tokens[end + 1 :]]
            elif word == "random":
                tokens = [*tokens[:i], *sql("rand()"), *tokens[end + 1 :]]
            elif word == "count" and distinct and [t.text for t in args[0]] == ["*"]:
                raise DialectError("Binder Error: COUNT(DISTINCT *) is not supported")
        i -= 1
    return tokens


def _counted_nulls(inner: list[Token]) -> list[Token]:
    """x of ``CASE WHEN x IS NULL THEN 1 ELSE 0 END``."""
    words = [t.word for t in inner]
    if words[:2] == ["case", "when"] and words[-7:] == ["is", "null", "then", "1", "else", "0", "end"] and not {"and", "or", "not", "when", "case"} & set(words[2:-7]):
        return inner[2:-7]
    return []


def value_tables(tokens: list[Token]) -> list[Token]:
    """``SELECT AS STRUCT a, b`` gives one column ``value`` of structs, ``SELECT AS VALUE x`` one of x."""
    i = 0
    while (i := _find(tokens, "select", i)) >= 0:
        at = i + 1 + (i + 1 < len(tokens) and tokens[i + 1].word in ("distinct", "all"))
        if [t.word for t in tokens[at : at + 2]] in (["as", "struct"], ["as", "value"]):
            end = clause_end(tokens, at + 2, ("from", "where", "group", "having", "order", "limit", "union", "intersect", "except"))
            items = tokens[at + 2 : end]
            if tokens[at + 1].word == "struct":
                items = [*sql("struct("), *items, Token("op", ")")]
            elif len(T.split(items)) != 1:
                raise DialectError("Binder Error: SELECT AS VALUE takes one expression")
            tokens = [*tokens[:at], *items, *sql("as value"), *tokens[end:]]
        i += 1
    return tokens


def clause_end(tokens: list[Token], at: int, words: tuple[str, ...]) -> int:
    """Where, from ``at`` on, one of these words or the closing bracket comes outside of brackets."""
    depth = 0
    for i in range(at, len(tokens)):
        t = tokens[i]
        if t.kind == "op":
            depth += t.text in ("(", "[", "{")
            depth -= t.text in (")", "]", "}")
        if depth < 0 or depth == 0 and t.word in words and not (t.word == "except" and tokens[i - 1].text == "*"):
            return i
    return len(tokens)


_UNITS = {"year": 12, "month": 1, "week": 7, "day": 1, "hour": 0, "minute": 0, "second": 0}


def intervals(tokens: list[Token]) -> list[Token]:
    """``x + INTERVAL '1 year 2 days'`` adds months first and then days, which Spark has no one literal for."""
    out, i = [], 0
    while i < len(tokens):
        if tokens[i].word != "interval" or i + 1 >= len(tokens):
            out.append(tokens[i])
            i += 1
            continue
        end = i + 1
        if tokens[end].kind == "string":
            unit = tokens[end + 1].word.removesuffix("s") if end + 1 < len(tokens) else ""
            words = [] if unit in _UNITS else tokens[end].text[1:-1].split()
            end += 1
        else:
            while end + 1 < len(tokens) and tokens[end].kind == "number" and tokens[end + 1].word.removesuffix("s") in _UNITS:
                end += 2
            words = [t.word for t in tokens[i + 1 : end]]
        pairs = [(n, u.lower().removesuffix("s")) for n, u in zip(words[::2], words[1::2], strict=False)]
        if not pairs or len(words) % 2 or any(u not in _UNITS or not n.lstrip("+-").isdigit() for n, u in pairs):
            out.append(tokens[i])
            i += 1
            continue
        months = sum(int(n) * _UNITS[u] for n, u in pairs if u in ("year", "month"))
        days = sum(int(n) * _UNITS[u] for n, u in pairs if u in ("week", "day"))
        sign = out[-1].text if out and out[-1].text in ("+", "-") else "+"
        parts = [f"interval '{months}' month"] * (months != 0) + [f"interval '{days}' day"] * (days != 0) + [f"interval '{n}' {u}" for n, u in pairs if not _UNITS[u]]
        out += sql(f" {sign} ".join(parts or ["interval '0' day"]))
        i = end
    return out


def aggregates(tokens: list[Token], kinds_of: Callable[[list[list[Token]], list[Token]], list[str] | None]) -> list[Token]:
    """SUM, AVG and TOTAL of texts and decimals: texts count as their numbers, else 0, and decimals keep their type.

    ``kinds_of`` gets arguments of one SELECT and its FROM, and returns the arguments' types,
    or None where they can't be told, as where they are an outer query's.
    """
    scopes: dict[tuple[int, int], list[int]] = {}
    for i in range(len(tokens) - 1):
        if (tokens[i].kind == "total" or tokens[i].kind == "name" and tokens[i].word in ("sum", "avg")) and tokens[i + 1].text == "(":
            scopes.setdefault(_scope(tokens, i), []).append(i)
    kind: dict[int, str] = {}
    for (a, b), calls in scopes.items():
        args = [_argument(tokens, i)[1] for i in calls]
        found = kinds_of(args, tokens[a:b])
        kind |= dict(zip(calls, found or ["double"] * len(calls), strict=True))
    for i in sorted(kind, reverse=True):
        distinct, arg = _argument(tokens, i)
        end = T.closing(tokens, i + 1)
        word = "total" if tokens[i].kind == "total" else tokens[i].word
        tokens = [*tokens[:i], *_aggregate(word, distinct, arg, kind[i]), *tokens[end + 1 :]]
    return tokens


def _argument(tokens: list[Token], i: int) -> tuple[bool, list[Token]]:
    inner = tokens[i + 2 : T.closing(tokens, i + 1)]
    distinct = bool(inner) and inner[0].word == "distinct"
    return distinct, inner[distinct:]


def _scope(tokens: list[Token], i: int) -> tuple[int, int]:
    """FROM of the SELECT whose list or HAVING or ORDER BY holds token ``i``; an empty span without FROM."""
    depth, k = 0, i
    while k >= 0 and not (depth == 0 and tokens[k].word == "select"):
        if tokens[k].kind == "op":
            depth += tokens[k].text in (")", "]", "}")
            depth = max(-1, depth - (tokens[k].text in ("(", "[", "{")))
            depth = max(depth, 0)
        k -= 1
    begin = clause_end(tokens, k + 1, ("from", "union", "intersect", "except"))
    if begin >= len(tokens) or tokens[begin].word != "from":
        return begin, begin
    return begin, clause_end(tokens, begin + 1, ("where", "group", "having", "order", "limit", "offset", "window", "union", "intersect", "except", "minus"))


def _aggregate(word: str, distinct: bool, arg: list[Token], kind: str) -> list[Token]:
    some = "distinct " if distinct else ""
    if kind == "string":
        arg = [*sql("case when ("), *arg, *sql(") is not null then coalesce(try_cast(trim("), *arg, *sql(") as double), cast(0 as double)) end")]
    if kind.startswith("decimal"):
        precision, scale = (int(x) for x in kind[8:-1].split(","))
        total = [*sql(f"cast(sum({some}"), *arg, *sql(f") as {kind})")]
        if word == "sum":
            return total
        if word == "total":
            return [*sql("coalesce("), *total, *sql(f", cast(0 as {kind}))")]
        wide = f"decimal({min(38, precision + 10)},{scale})"
        return [*sql(f"cast(round(try_divide(sum({some}cast("), *arg, *sql(f"as {wide})), cast(count({some}"), *arg, *sql(f") as decimal(20,0))), {scale}) as {kind})")]
    if word == "total":
        return [*sql(f"coalesce(sum({some}cast("), *arg, *sql("as double)), cast(0 as double))")]
    return [*sql(f"{word}({some}"), *arg, Token("op", ")")]


def null_order(tokens: list[Token], nulls_first: bool) -> list[Token]:
    """Explicit places for NULLs: ``nulls_first`` ascending, and the other way descending."""
    i = 0
    while (i := _find(tokens, "order", i)) >= 0:
        if i + 1 >= len(tokens) or tokens[i + 1].word != "by":
            i += 1
            continue
        depth, end = 0, i + 2
        while end < len(tokens):
            t = tokens[end]
            if t.kind == "op":
                depth += t.text in ("(", "[", "{")
                depth -= t.text in (")", "]", "}")
            if depth < 0 or depth == 0 and t.word in ("limit", "offset", "union", "intersect", "except", "rows", "range", "minus"):
                break
            end += 1
        items = []
        for k, item in enumerate(T.split(tokens[i + 2 : end])):
            if [t.word for t in item[:2]] == ["cast", "("] and item[T.closing(item, 1) - 1].word in ("bigint", "double"):  # what can't be cast sorts as NULL
                item = [Token("name", "try_cast"), *item[1:]]
            words = [t.word for t in item]
            if "nulls" not in words:
                first = not nulls_first if words[-1] == "desc" else nulls_first
                item = [*item, *sql("nulls first" if first else "nulls last")]
            items += ([Token("op", ",")] if k else []) + null_order(item, nulls_first)
        tokens = [*tokens[: i + 2], *items, *tokens[end:]]
        i += 2
    return tokens


def indexed_by(tokens: list[Token]) -> list[Token]:
    """Index hints say nothing here."""
    out, i = [], 0
    while i < len(tokens):
        if tokens[i].word == "indexed" and i + 2 < len(tokens) and tokens[i + 1].word == "by":
            i += 3
        elif tokens[i].word == "not" and i + 1 < len(tokens) and tokens[i + 1].word == "indexed":
            i += 2
        else:
            out.append(tokens[i])
            i += 1
    return out


def trailing_commas(tokens: list[Token]) -> list[Token]:
    return [t for i, t in enumerate(tokens) if not (t.text == "," and i + 1 < len(tokens) and tokens[i + 1].text == ")")]


def parameters(tokens: list[Token]) -> tuple[list[Token], list[str]]:
    """Named markers p1, p2, ... for ``?``, ``?2``, ``$2`` and ``:name``; and each one's key in order of use."""
    out, keys, following = [], [], 0
    for t in tokens:
        if t.kind == "param":
            if t.text == "?":
                following += 1
                key = str(following)
            else:
                key = t.text[1:]
            keys.append(key)
            out += [Token("param", ":p_" + key)]
        else:
            out.append(t)
    return out, list(dict.fromkeys(keys))


def divisions(tokens: list[Token], operand_types: Callable[[list[Token]], tuple[str, str]]) -> list[Token]:
    """``a / b`` between integers truncates; every division by zero is NULL.

    ``operand_types`` gets the query with one division exposed and returns its operands' types.
    """
    while True:
        spots = [i for i, t in enumerate(tokens) if t.text == "/" and t.kind == "op"]
        if not spots:
            return [Token("op", "/") if t.kind == "done" else t for t in tokens]
        spans = {i: (T.term_before(tokens, i), T.primary_after(tokens, i + 1)) for i in spots}
        i = next(i for i in spots if not any(spans[i][0] <= j < spans[i][1] for j in spots if j != i))
        a, b = spans[i]
        left, right = tokens[a:i], tokens[i + 1 : b]
        probe = [*sql("named_struct('tw_left',"), *left, *sql(", 'tw_right',"), *right, *sql(", 'tw_value',"), *left, Token("done", "/"), *right, *sql(").tw_value")]
        kinds = operand_types([Token("op", "/") if t.kind == "done" else t for t in [*tokens[:a], *probe, *tokens[b:]]])
        integral = all(k in ("tinyint", "smallint", "int", "bigint") for k in kinds)
        body = [*sql("(cast("), *left, *sql("as bigint) div nullif(cast("), *right, *sql("as bigint), 0))")] if integral else [*sql("try_divide("), *left, Token("op", ","), *right, Token("op", ")")]
        tokens = [*tokens[:a], *body, *tokens[b:]]


def dialect(tokens: list[Token], nulls_first: bool, aliases: dict[str, str]) -> list[Token]:
    """All rewrites that need no types."""
    for step in (indexed_by, trailing_commas, value_tables, intervals, exclude, in_lists, structs, functions):
        tokens = step(tokens)
    return null_order(casts(tokens, aliases), nulls_first)
