"""Symbols, calls, uses and inheritance of PHP sources."""

from __future__ import annotations

import re

from graphloom.sources.extract.lexer import PHP, Token, matching, tokens
from graphloom.sources.extract.model import Extract, Import, Reference, Symbol

#: Words before "(" that call nothing, and member modifiers.
NOT_CALLED = frozenset("if elseif else while for foreach switch match return catch function fn array list isset unset empty echo print exit die and or xor declare include include_once require require_once use new clone yield throw static".split())
MODIFIERS = frozenset(("public", "protected", "private", "static", "abstract", "final", "readonly"))
SHOWN = ("public", "protected", "private", "static", "abstract")


def _php_only(text: str) -> str:
    """HTML around <?php ... ?> blanked, rows kept; a text without tags is all PHP."""
    if "<?" not in text:
        return text
    out, at = [], 0
    for m in re.finditer(r"<\?(?:php|=)?(.*?)(?:\?>|\Z)", text, re.S):
        out.append(re.sub(r"[^\n]", " ", text[at : m.start(1)]))
        out.append(m[1])
        at = m.end(1)
    out.append(re.sub(r"[^\n]", " ", text[at:]))
    return "".join(out)


def _names(ts: list[Token]) -> list[Token]:
    """Words joined with their backslashes into qualified names."""
    out: list[Token] = []
    for t in ts:
        joins = out and out[-1].end == t.start and (t.text == "\\" or out[-1].text.endswith("\\"))
        if joins and out[-1].kind == "id" and (t.kind == "id" or t.text == "\\"):
            out[-1] = Token("id", out[-1].text + t.text, out[-1].row, out[-1].start, t.end)
        elif t.text == "\\":
            out.append(Token("id", t.text, *t[2:]))
        else:
            out.append(t)
    return out


class _Reader:
    def __init__(self, text: str) -> None:
        self.text = _php_only(text)
        self.ts, self.out = _names(tokens(self.text, PHP)), Extract()

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.ts) and self.ts[i].kind != "str" and self.ts[i].text.lower() in texts

    def body(self, i: int, end: int, owner: str | None) -> None:
        ts = self.ts
        while i < end:
            if ts[i].text == "#" and self.is_(i + 1, "["):
                i = matching(ts, i + 1) + 1
            elif self.is_(i, "class", "interface", "trait") and i + 1 < end and ts[i + 1].kind == "id" and not self.is_(i - 1, "::", "->", "new"):
                i = self.type_(i, end)
            elif self.is_(i, "function", "fn") and not self.is_(i - 1, "->", "::", "use"):
                i = self.function(i, end, owner)
            elif self.is_(i, "use") and owner is None and not self.is_(i - 1, ")"):
                i = self.use(i, end)
            elif self.is_(i, "new") and i + 1 < end and ts[i + 1].kind == "id" and not ts[i + 1].text.startswith("$"):
                if self.is_(i + 1, "class"):  # an anonymous class
                    i += 2
                    while i < end and not self.is_(i, "{"):
                        i = matching(ts, i) + 1 if self.is_(i, "(") else i + 1
                    close = matching(ts, i) if i < end else end
                    self.body(i + 1, min(close, end), owner)
                    i = close + 1
                    continue
                self.named(ts[i + 1])
                i += 2
            elif ts[i].kind == "id" and self.is_(i + 1, "("):
                self.call(i)
                i += 1
            else:
                i += 1

    def named(self, t: Token) -> None:
        """A possibly qualified name as the target of a call."""
        last = t.text.split("\\")[-1]
        if last:
            self.out.call(last, t.row, t.text if "\\" in t.text else None)

    def call(self, i: int) -> None:
        t = self.ts[i]
        if t.text.startswith("$"):
            return
        if self.is_(i - 1, "->", "?->"):
            self.out.call(t.text, t.row)
        elif self.is_(i - 1, "::"):
            if i >= 2 and self.ts[i - 2].kind == "id":
                self.out.call(t.text, t.row, self.ts[i - 2].text)
        elif t.text.lower() not in NOT_CALLED:
            self.named(t)

    def type_(self, i: int, end: int) -> int:
        ts, begin = self.ts, i
        while begin and self.is_(begin - 1, "abstract", "final", "readonly"):
            begin -= 1
        kind, name = ts[i].text.lower(), ts[i + 1].text
        j, state = i + 2, None
        while j < end and not self.is_(j, "{", ";"):
            if self.is_(j, "extends", "implements"):
                state = {"extends": "inherit", "implements": "implement"}[ts[j].text.lower()]
            elif ts[j].kind == "id" and state and kind == "class":
                text = ts[j].text
                self.out.refs.append(Reference(state, text.split("\\")[-1], text if "\\" in text else None, ts[j].row, name))
            j += 1
        if not self.is_(j, "{"):
            return j + 1
        last = matching(ts, j)
        self.out.symbols.append(Symbol(name, kind, ts[begin].row, ts[last].row))
        self.body(j + 1, min(last, end), name)
        return last + 1

    def function(self, i: int, end: int, owner: str | None) -> int:
        ts, begin = self.ts, i
        while begin and ts[begin - 1].text.lower() in MODIFIERS:
            begin -= 1
        j = i + 1
        if self.is_(j, "&"):
            j += 1
        name = ts[j].text if j < end and ts[j].kind == "id" and self.is_(j + 1, "(") else None
        open_ = j + 1 if name else j
        if not self.is_(open_, "("):
            return i + 1
        close = matching(ts, open_)
        k = close + 1
        while k < end and not self.is_(k, "{", ";", "=>"):
            k = matching(ts, k) + 1 if self.is_(k, "(") else k + 1
        if not self.is_(k, "{"):
            if name and owner and self.is_(k, ";"):  # abstract or interface method
                self.method(name, begin, i, open_, close, k, owner)
            return k + 1
        last = matching(ts, k)
        if name and owner:
            self.method(name, begin, i, open_, close, last, owner)
        elif name:
            self.out.symbols.append(Symbol(name, "function", ts[i].row, ts[last].row, signature=self.params(open_, close)))
        self.body(open_ + 1, close, owner)
        self.body(k + 1, min(last, end), None if owner is None else owner)
        return last + 1

    def params(self, open_: int, close: int) -> str:
        return "function " + self.text[self.ts[open_].start : self.ts[close].end]

    def method(self, name: str, begin: int, i: int, open_: int, close: int, last: int, owner: str) -> None:
        shown = next((t.text.lower() for t in self.ts[begin:i] if t.text.lower() in SHOWN), None)
        test = name.startswith("test") and owner.endswith(("Test", "Cest"))
        self.out.symbols.append(Symbol(name, "method", self.ts[begin].row, self.ts[last].row, owner, shown, self.params(open_, close), test))

    def use(self, i: int, end: int) -> int:
        ts, j = self.ts, i + 1
        if self.is_(j, "function", "const"):
            j += 1
        while j < end and not self.is_(j, ";"):
            t = ts[j]
            if t.kind == "id" and "\\" in t.text and not self.is_(j + 1, "{"):
                alias = ts[j + 2].text if self.is_(j + 1, "as") and j + 2 < end else None
                path = t.text.lstrip("\\") if t.text.count("\\") > 1 else t.text
                self.out.imports.append(Import(alias or path.split("\\")[-1], path, alias, t.row))
            elif self.is_(j, "{"):
                j = matching(ts, j)
            j += 1
        return j + 1


def extract(text: str) -> Extract:
    r = _Reader(text)
    r.body(0, len(r.ts), None)
    return r.out.finish()
