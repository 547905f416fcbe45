"""A tolerant tokenizer for brace languages.

Comments vanish, strings stay one token each; nothing ever fails: what is not
understood becomes a one-character token.  Rows count from 0.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # id, str, num, op, jsx
    text: str
    row: int
    start: int
    end: int


@dataclass(frozen=True)
class Dialect:
    nested_comments: bool = False
    hash_comments: bool = False
    raw_strings: bool = False
    lifetimes: bool = False
    templates: bool = False
    regexes: bool = False
    dollar: bool = False


RUST = Dialect(nested_comments=True, raw_strings=True, lifetimes=True)
PHP = Dialect(hash_comments=True, dollar=True)
SCRIPT = Dialect(templates=True, regexes=True, dollar=True)

_WORD = re.compile(r"[^\W\d]\w*")
_DOLLAR_WORD = re.compile(r"[$]?[^\W\d][\w$]*|[$]")
_NUMBER = re.compile(r"\d[\w]*(?:\.\d[\w]*)?")
_OPS = re.compile(r"::|->|=>|\?->|\?\.|\.\.\.?|[=!]==?|&&|\|\||[<>]=|[-+*/%&|^]=")
_RAW = re.compile(r"b?r(#*)\"")
_CHAR = re.compile(r"b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\\n])'")
_BEFORE_REGEX = {"", "(", ",", "=", ":", "[", "!", "&&", "||", "?", "{", "}", ";", "=>", "return", "typeof", "case", "==", "===", "!=", "!=="}


def tokens(text: str, dialect: Dialect, row: int = 0, at: int = 0, stop: int | None = None) -> list[Token]:
    out: list[Token] = []
    i, n = at, len(text) if stop is None else stop

    def put(kind: str, end: int) -> None:
        nonlocal i, row
        piece = text[i:end]
        out.append(Token(kind, piece, row, i, end))
        row += piece.count("\n")
        i = end

    def skip(end: int) -> None:
        nonlocal i, row
        row += text.count("\n", i, end)
        i = end

    word = _DOLLAR_WORD if dialect.dollar else _WORD
    while i < n:
        c = text[i]
        if c.isspace():
            j = i + 1
            while j < n and text[j].isspace():
                j += 1
            skip(j)
        elif text.startswith("//", i) or (dialect.hash_comments and c == "#" and not text.startswith("#[", i)):
            j = text.find("\n", i)
            skip(n if j < 0 else min(j, n))
        elif text.startswith("/*", i):
            skip(min(n, _comment_end(text, i, dialect.nested_comments)))
        elif dialect.raw_strings and (m := _RAW.match(text, i)):
            j = text.find('"' + m[1], m.end())
            put("str", n if j < 0 else min(n, j + 1 + len(m[1])))
        elif dialect.lifetimes and (c == "'" or text.startswith("b'", i)):
            m = _CHAR.match(text, i)
            if m:
                put("str", min(n, m.end()))
            else:
                m = _WORD.match(text, i + 1)
                put("op", m.end() if m else i + 1)
        elif c == '"' or (c == "'" and not dialect.lifetimes):
            put("str", min(n, _string_end(text, i, c)))
        elif dialect.templates and c == "`":
            j = _template(text, i, n)
            inner = j[1]
            first_row, first = row, i
            put("str", j[0])
            for lo, hi in inner:
                out += tokens(text, dialect, first_row + text.count("\n", first, lo), lo, hi)
        elif dialect.regexes and c == "/" and (out[-1].text if out else "") in _BEFORE_REGEX and (j := _regex_end(text, i, n)):
            put("str", j)
        elif m := word.match(text, i):
            put("id", min(n, m.end()))
        elif m := _NUMBER.match(text, i):
            put("num", min(n, m.end()))
        elif m := _OPS.match(text, i):
            put("op", min(n, m.end()))
        else:
            put("op", i + 1)
    return out


def _comment_end(text: str, i: int, nested: bool) -> int:
    if not nested:
        j = text.find("*/", i + 2)
        return len(text) if j < 0 else j + 2
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(text, i):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(text)


def _string_end(text: str, i: int, quote: str) -> int:
    j = i + 1
    while j < len(text) and text[j] != quote:
        j += 2 if text[j] == "\\" else 1
    return min(j + 1, len(text))


def _template(text: str, i: int, n: int) -> tuple[int, list[tuple[int, int]]]:
    """End of a template string and its ${...} parts."""
    parts, j = [], i + 1
    while j < n and text[j] != "`":
        if text[j] == "\\":
            j += 2
        elif text.startswith("${", j):
            depth, k = 1, j + 2
            while k < n and depth:
                if text[k] == "`":
                    k = _template(text, k, n)[0]
                    continue
                if text[k] in "\"'":
                    k = _string_end(text, k, text[k])
                    continue
                depth += {"{": 1, "}": -1}.get(text[k], 0)
                k += 1
            parts.append((j + 2, max(j + 2, k - 1)))
            j = k
        else:
            j += 1
    return min(j + 1, n), parts


def _regex_end(text: str, i: int, n: int) -> int | None:
    j, inside = i + 1, False
    while j < n and text[j] != "\n":
        if text[j] == "\\":
            j += 1
        elif text[j] == "[":
            inside = True
        elif text[j] == "]":
            inside = False
        elif text[j] == "/" and not inside:
            j += 1
            while j < n and text[j].isalpha():
                j += 1
            return j
        j += 1
    return None


_OPEN, _CLOSE = "([{", ")]}"


def matching(ts: list[Token], i: int) -> int:
    """Index of the token that closes the bracket at i; the last one if none does."""
    depth = 0
    for j in range(i, len(ts)):
        if ts[j].kind == "op":
            if ts[j].text in _OPEN:
                depth += 1
            elif ts[j].text in _CLOSE:
                depth -= 1
                if depth <= 0:
                    return j
    return len(ts) - 1


def after_generics(ts: list[Token], i: int) -> int:
    """The index after <...> that starts at i (i itself if none does)."""
    if i >= len(ts) or ts[i].text != "<":
        return i
    depth = 0
    for j in range(i, len(ts)):
        t = ts[j].text
        if t == "<":
            depth += 1
        elif t in (">", ">="):
            depth -= 1
            if not depth:
                return j + 1
        elif t in (";", "{"):
            return j
        elif t == "(" and ts[j].kind == "op":
            pass
    return len(ts)
