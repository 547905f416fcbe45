"""Symbols, calls, uses and trait implementations of Rust sources."""

from __future__ import annotations

from graphloom.sources.extract.lexer import RUST, Token, after_generics, matching, tokens
from graphloom.sources.extract.model import Extract, Import, Reference, Symbol

#: Words that are never called, although "(" may follow.
KEYWORDS = frozenset(
    "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while yield".split()
)
MODIFIERS = frozenset(("const", "async", "unsafe", "default", "extern"))
#: The argument of these methods that names functions to run.
REGISTRATION = {"add_systems": 1, "add_observer": 0, "observe": 0}


class _Reader:
    def __init__(self, text: str) -> None:
        self.text, self.ts, self.out = text, tokens(text, RUST), Extract()

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.ts) and self.ts[i].text in texts and self.ts[i].kind != "str"

    def items(self, i: int, end: int, impl: tuple[str | None] | None) -> None:
        """Items and expressions of ts[i:end]; impl holds the enclosing impl's parent."""
        tests = False
        while i < end:
            ts, t = self.ts, self.ts[i]
            if t.text == "#" and self.is_(i + 1, "[", "!"):
                open_ = i + 1 if self.is_(i + 1, "[") else i + 2
                close = matching(ts, open_)
                tests = tests or (open_ == i + 1 and "test" in self.text[ts[open_].start : ts[close].end])
                i = close + 1
                continue
            begin, visibility = i, None
            if t.text == "pub" and t.kind == "id":
                close = matching(ts, i + 1) if self.is_(i + 1, "(") else i
                visibility = self.text[t.start : ts[close].end]
                i = close + 1
            k = i
            while k < end and (ts[k].text in MODIFIERS or (ts[k].kind == "str" and self.is_(k - 1, "extern"))):
                k += 1
            if self.is_(k, "fn") and k + 1 < end and ts[k + 1].kind == "id":
                i = self.function(begin, k, end, impl, visibility, tests)
            elif self.is_(i, "struct", "enum", "trait") and i + 1 < end and ts[i + 1].kind == "id":
                i = self.type_(begin, i, end, impl, visibility)
            elif self.is_(i, "impl") and self.item_place(i):
                i = self.implementation(i, end)
            elif self.is_(i, "use"):
                i = self.use(i, end)
            else:
                i = self.expression(max(i, begin), end, impl)
            tests = False

    def item_place(self, i: int) -> bool:
        return i == 0 or self.ts[i - 1].text in ("}", "{", ";", "]", "unsafe", "default")

    def function(self, begin: int, k: int, end: int, impl: tuple | None, visibility: str | None, tests: bool) -> int:
        ts = self.ts
        open_ = after_generics(ts, k + 2)
        if not self.is_(open_, "("):
            return k + 1
        close = matching(ts, open_)
        j = close + 1
        while j < end and not self.is_(j, "{", ";"):
            j = matching(ts, j) + 1 if self.is_(j, "(", "[") else j + 1
        if not self.is_(j, "{"):
            return j + 1
        last = matching(ts, j)
        params = self.text[ts[open_].start : ts[close].end]
        self.out.symbols.append(Symbol(ts[k + 1].text, "method" if impl else "function", ts[begin].row, ts[last].row, impl[0] if impl else None, visibility, "fn " + params, tests))
        self.items(j + 1, last, impl)
        return last + 1

    def type_(self, begin: int, i: int, end: int, impl: tuple | None, visibility: str | None) -> int:
        ts, kind = self.ts, self.ts[i].text
        j = after_generics(ts, i + 2)
        while j < end and not self.is_(j, "{", ";"):
            j = matching(ts, j) + 1 if self.is_(j, "(", "[") else j + 1
        last = matching(ts, j) if self.is_(j, "{") else min(j, end - 1)
        self.out.symbols.append(Symbol(ts[i + 1].text, kind, ts[begin].row, ts[last].row, None, visibility))
        if kind == "trait" and self.is_(j, "{"):
            self.items(j + 1, last, impl)
        return last + 1

    def implementation(self, i: int, end: int) -> int:
        ts = self.ts
        j = after_generics(ts, i + 1)
        sides: list[list[Token]] = [[]]
        while j < end and not self.is_(j, "{", ";"):
            if self.is_(j, "for") and not self.is_(j + 1, "<"):
                sides.append([])
            elif self.is_(j, "where"):
                while j < end and not self.is_(j, "{", ";"):
                    j += 1
                continue
            else:
                sides[-1].append(ts[j])
            j += 1
        plain = [s[0].text if len(s) == 1 and s[0].kind == "id" else None for s in sides]
        parent = next((p for p in plain if p), None)
        if len(plain) == 2 and all(plain):
            self.out.refs.append(Reference("trait_impl", plain[0], plain[1], ts[i].row))
        if not self.is_(j, "{"):
            return j + 1
        last = matching(ts, j)
        self.items(j + 1, last, (parent,))
        return last + 1

    def use(self, i: int, end: int) -> int:
        ts, j = self.ts, i + 1
        while j < end and not self.is_(j, ";"):
            j += 1
        if j > i + 1:
            path = self.text[ts[i + 1].start : ts[j - 1].end]
            before, found, after = path.partition(" as ")
            self.out.imports.append(Import(after if found else before.split("::")[-1], path, None, ts[i].row))
        return j + 1

    def expression(self, i: int, end: int, impl: tuple | None) -> int:
        """One step through an expression: a block, a macro, a call, a pattern or a token."""
        ts, t = self.ts, self.ts[i]
        if self.is_(i, "{"):
            last = matching(ts, i)
            self.items(i + 1, min(last, end), impl)
            return last + 1
        if self.is_(i, "let"):
            depth = 0
            for j in range(i + 1, end):
                depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(ts[j].text, 0) if ts[j].kind == "op" else 0
                if depth <= 0 and self.is_(j, "=", ";"):
                    return j + 1
            return end
        if self.is_(i, "match"):
            return self.match_(i, end, impl)
        if t.kind != "id":
            return i + 1
        if self.is_(i + 1, "!") and self.is_(i + 2, "(", "[", "{") and not self.is_(i - 1, "."):
            last = matching(ts, i + 2)
            self.out.call(t.text + "!", t.row)
            source = len(self.out.refs) - 1
            for name, qualifier, row in scan_calls(ts[i + 2 : last + 1]):
                self.out.call(name, row, qualifier)
            self.macros.extend(range(source, len(self.out.refs)))
            return last + 1
        j = i + 1
        if self.is_(j, "::") and self.is_(j + 1, "<"):
            j = after_generics(ts, j + 1)
        if self.is_(j, "(") and (t.text not in KEYWORDS or self.is_(i - 1, ".")):
            self.out.call(t.text, t.row, _qualifier(ts, i))
            if self.is_(i - 1, ".") and t.text in REGISTRATION:
                self.registered(j, REGISTRATION[t.text])
            return j
        return i + 1

    def match_(self, i: int, end: int, impl: tuple | None) -> int:
        """The subject and the arms of a match; patterns call nothing."""
        ts, j = self.ts, i + 1
        while j < end and not self.is_(j, "{"):
            j = self.expression(j, end, impl)
        if j >= end:
            return end
        last = min(matching(ts, j), end)
        j += 1
        while j < last:
            guard = False
            while j < last and not self.is_(j, "=>"):
                if self.is_(j, "if"):
                    guard = True
                if guard:
                    j = self.expression(j, last, impl)
                else:
                    j = matching(ts, j) + 1 if self.is_(j, "(", "[", "{") else j + 1
            j += 1
            if self.is_(j, "{"):
                j = self.expression(j, last, impl)
                j += self.is_(j, ",")
                continue
            depth = 0
            while j < last and not (depth == 0 and self.is_(j, ",")):
                if self.is_(j, "(", "["):
                    depth += 1
                elif self.is_(j, ")", "]"):
                    depth -= 1
                j = self.expression(j, last, impl)
            j += 1
        return last + 1

    def registered(self, open_: int, wanted: int) -> None:
        ts, close = self.ts, matching(self.ts, open_)
        depth, argument, held = 0, 0, []
        for t in ts[open_ + 1 : close]:
            if t.kind == "op":
                if depth == 0 and t.text == ",":
                    argument += 1
                    continue
                depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(t.text, 0)
            if argument == wanted:
                held.append(t)
        for name, qualifier, row in scan_functions(held):
            self.out.call(name, row, qualifier)

    macros: list[int]


def _qualifier(ts: list[Token], i: int) -> str | None:
    """The path before a name, as `a::b`; none after a dot."""
    parts: list[str] = []
    while i >= 2 and ts[i - 1].text == "::":
        j = i - 2
        if ts[j].text == ">":  # a path with generics: text up to its start is not kept
            depth = 0
            while j >= 0:
                depth += {">": 1, "<": -1}.get(ts[j].text, 0)
                if not depth:
                    break
                j -= 1
            j -= 2 if j >= 1 and ts[j - 1].text == "::" else 1
        if j < 0 or ts[j].kind != "id":
            break
        parts.append(ts[j].text)
        i = j
    return "::".join(reversed(parts)) or None


def scan_calls(ts: list[Token]) -> list[tuple[str, str | None, int]]:
    """(name, qualifier, row) of paths followed by "(" in a macro's body."""
    out = []
    for i, t in enumerate(ts[:-1]):
        if t.kind == "id" and ts[i + 1].text == "(" and ts[i + 1].kind == "op":
            qualifier = _qualifier(ts, i)
            if qualifier is None and t.text in KEYWORDS and (not i or ts[i - 1].text != "."):
                continue
            out.append((t.text, qualifier, t.row))
    return out


def scan_functions(ts: list[Token]) -> list[tuple[str, str | None, int]]:
    """Bare snake_case names: neither called, nor a macro, nor after a dot."""
    out = []
    for i, t in enumerate(ts):
        after = ts[i + 1].text if i + 1 < len(ts) else ""
        before = ts[i - 1].text if i else ""
        snake = t.text[:1].islower() or t.text[:1] == "_"
        if t.kind == "id" and snake and t.text == t.text.lower() and t.text not in KEYWORDS and after not in ("(", "!", "::") and before != ".":
            out.append((t.text, _qualifier(ts, i), t.row))
    return out


def extract(text: str) -> Extract:
    r = _Reader(text)
    r.macros = []
    r.items(0, len(r.ts), None)
    # what a macro's body calls belongs to the symbol around the macro
    row = None
    for i in r.macros:
        ref = r.out.refs[i]
        row = ref.line if ref.target_name.endswith("!") else row
        ref.source_symbol_name = r.out.around(row)
    return r.out.finish()
