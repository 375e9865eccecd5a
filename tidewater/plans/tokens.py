"""Tokens of the dialect, and the spans of operands in them."""

from __future__ import annotations

import re
from typing import NamedTuple

_PATTERN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
    |(?P<string>'(?:[^']|'')*')
    |(?P<quoted>"(?:[^"]|"")*"|`(?:[^`]|``)*`)
    |(?P<number>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?)
    |(?P<param>\?\d*|\$\d+|:[A-Za-z_]\w*|:\d+)
    |(?P<name>[A-Za-z_]\w*)
    |(?P<op><=>|<<|>>|<>|!=|<=|>=|\|\||::|->|[-+*/%=<>(),.;{}\[\]:&|~^!])""",
    re.VERBOSE | re.DOTALL,
)

#: Names that end an operand to their left or right.
STOPS = set("select distinct from where group having order limit offset union intersect except and or not in like between is as on then when else case end asc desc nulls join left inner cross by using set values escape all".split())


class Token(NamedTuple):
    kind: str
    text: str

    @property
    def word(self) -> str:
        """The lower-cased text of an unquoted name, else the text itself."""
        return self.text.lower() if self.kind == "name" else self.text

    @property
    def name(self) -> str:
        """An identifier without its quotes, lower-cased."""
        return self.text[1:-1].lower() if self.kind == "quoted" else self.text.lower()


class DialectError(ValueError):
    """A statement that the dialect refuses, or that breaks a rule of its tables."""


def tokenize(text: str) -> list[Token]:
    """Tokens without spaces and comments."""
    out, at = [], 0
    while at < len(text):
        m = _PATTERN.match(text, at)
        if m is None:
            raise DialectError(f"Parser Error: unexpected character {text[at]!r}")
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0]))
        at = m.end()
    return out


def spaced(tokens: list[Token], shown) -> tuple[str, list[int]]:
    """The tokens' text, each as ``shown`` gives it, and where each begins."""
    out, begins, at, before = [], [], 0, ""
    for t in tokens:
        text = shown(t)
        tight = text in ".,)]}:" and t.kind == "op" or before in (".", "(", "[", "{") or text == "(" and before.isidentifier() and before.lower() not in STOPS
        if out and not tight:
            out.append(" ")
            at += 1
        out.append(text)
        begins.append(at)
        at += len(text)
        before = text
    return "".join(out), begins


def _spark(t: Token) -> str:
    """Double-quoted names become Spark's, and backslashes in strings stay what they are."""
    if t.kind == "quoted" and t.text[0] == '"':
        return "`" + t.text[1:-1].replace('""', '"').replace("`", "``") + "`"
    return t.text.replace("\\", "\\\\") if t.kind == "string" else t.text


def render(tokens: list[Token]) -> str:
    """The dialect's text, for showing and storing."""
    return spaced(tokens, lambda t: t.text)[0]


def spark_sql(tokens: list[Token]) -> str:
    """The text that Spark parses."""
    return spaced(tokens, _spark)[0]


def spark_spans(tokens: list[Token]) -> tuple[str, list[int]]:
    """``spark_sql``'s text and where each token begins in it, in UTF-16 units as Spark counts."""
    text, begins = spaced(tokens, _spark)
    if text.isascii():
        return text, begins
    units = [0]
    for c in text:
        units.append(units[-1] + 1 + (c > "\uffff"))
    return text, [units[b] for b in begins]


def statements(tokens: list[Token]) -> list[list[Token]]:
    """Tokens between semicolons; those of a trigger's body, from BEGIN to its END, end nothing."""
    out: list[list[Token]] = [[]]
    depth = 0
    for t in tokens:
        if _makes_trigger(out[-1]):
            depth += t.word in ("begin", "case")
            depth -= t.word == "end"
        if t.text == ";" and t.kind == "op" and depth <= 0:
            out.append([])
            depth = 0
        else:
            out[-1].append(t)
    return [s for s in out if s]


def _makes_trigger(tokens: list[Token]) -> bool:
    words = [t.word for t in tokens[:5]]
    return words[:1] == ["create"] and "trigger" in words


def closing(tokens: list[Token], at: int) -> int:
    """The bracket that closes the one at ``at``."""
    depth = 0
    for i in range(at, len(tokens)):
        if tokens[i].kind == "op":
            depth += tokens[i].text in ("(", "[", "{")
            depth -= tokens[i].text in (")", "]", "}")
            if depth == 0:
                return i
    raise DialectError("Parser Error: a bracket is not closed")


def opening(tokens: list[Token], at: int) -> int:
    depth = 0
    for i in range(at, -1, -1):
        if tokens[i].kind == "op":
            depth += tokens[i].text in (")", "]", "}")
            depth -= tokens[i].text in ("(", "[", "{")
            if depth == 0:
                return i
    raise DialectError("Parser Error: a bracket is not opened")


def split(tokens: list[Token], separator: str = ",") -> list[list[Token]]:
    """Parts between separators outside brackets."""
    out: list[list[Token]] = [[]]
    depth = 0
    for t in tokens:
        if t.kind == "op":
            depth += t.text in ("(", "[", "{")
            depth -= t.text in (")", "]", "}")
        if depth == 0 and t.word == separator:
            out.append([])
        else:
            out[-1].append(t)
    return out


def _operand(t: Token) -> bool:
    return t.kind in ("string", "quoted", "number", "param", "total") or t.kind == "name" and t.word not in STOPS


def primary_before(tokens: list[Token], end: int) -> int:
    """Where the primary expression that ends before ``end`` begins, with its signs."""
    i = end - 1
    while True:
        t = tokens[i]
        if t.kind == "op" and t.text in (")", "]", "}"):
            i = opening(tokens, i)
            if i and _operand(tokens[i - 1]) and tokens[i - 1].kind in ("name", "quoted", "total"):
                i -= 1
        elif t.word == "end":
            depth = 0
            while True:
                depth += tokens[i].word == "end"
                depth -= tokens[i].word == "case"
                if depth == 0:
                    break
                i -= 1
        if i >= 2 and tokens[i - 1].text in (".", "::"):
            i -= 2
            continue
        if i and tokens[i].kind == "string" and tokens[i - 1].word in ("date", "timestamp", "interval"):
            i -= 1
        break
    while i and tokens[i - 1].text in ("-", "+") and (i == 1 or not (_operand(tokens[i - 2]) or tokens[i - 2].text in (")", "]", "}") or tokens[i - 2].word == "end")):
        i -= 1
    return i


def term_before(tokens: list[Token], end: int) -> int:
    """Where the chain of factors that ends before ``end`` begins."""
    i = primary_before(tokens, end)
    while i and tokens[i - 1].text in ("*", "/", "%") or i and tokens[i - 1].word == "div":
        i = primary_before(tokens, i - 1)
    return i


def sum_before(tokens: list[Token], end: int) -> int:
    """Where the arithmetic expression that ends before ``end`` begins."""
    i = term_before(tokens, end)
    while i and tokens[i - 1].text in ("+", "-", "||"):
        i = term_before(tokens, i - 1)
    return i


def primary_after(tokens: list[Token], at: int) -> int:
    """Where the primary expression that begins at ``at`` ends."""
    while tokens[at].text in ("-", "+"):
        at += 1
    if tokens[at].word == "case":
        depth = 0
        while True:
            depth += tokens[at].word == "case"
            depth -= tokens[at].word == "end"
            at += 1
            if depth == 0:
                return at
    if tokens[at].text == "(":
        at = closing(tokens, at)
    elif tokens[at].word in ("date", "timestamp", "interval") and at + 1 < len(tokens) and tokens[at + 1].kind == "string":
        at += 1
    at += 1
    while at < len(tokens):
        if tokens[at].text in (".", "::"):
            at += 2
        elif tokens[at].text in ("(", "["):
            at = closing(tokens, at) + 1
        else:
            break
    return at
