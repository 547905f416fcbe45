"""Symbols, calls, imports and inheritance of TypeScript and JavaScript."""

from __future__ import annotations

from graphloom.sources.extract.lexer import SCRIPT, after_generics, matching, tokens
from graphloom.sources.extract.model import Extract, Import, Reference, Symbol

#: Words before "(" that call nothing, member modifiers, test names.
NOT_CALLED = frozenset("if for while switch catch function return typeof await in do else case void delete super import with yield throw instanceof async constructor".split())
MODIFIERS = frozenset(("public", "private", "protected", "static", "async", "abstract", "override", "readonly", "get", "set", "declare"))
ACCESS = ("public", "private", "protected")
TESTS, VARIANTS = ("test", "it"), ("only", "skip", "concurrent", "fails")


class _Reader:
    def __init__(self, text: str) -> None:
        self.text, self.ts, self.out = text, tokens(text, SCRIPT), Extract()
        self.callbacks = 0

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.ts) and self.ts[i].kind != "str" and self.ts[i].text in texts

    def word(self, i: int) -> bool:
        return 0 <= i < len(self.ts) and self.ts[i].kind == "id"

    def code(self, i: int, end: int) -> None:
        """Statements and expressions of ts[i:end]."""
        ts = self.ts
        while i < end:
            if ts[i].kind == "str":
                i += 1
            elif self.is_(i, "import") and not self.is_(i + 1, "(", "."):
                i = self.import_(i, end)
            elif self.is_(i, "class") and not self.is_(i - 1, ".", "?."):
                i = self.class_(i, end)
            elif self.is_(i, "interface") and self.word(i + 1) and not self.is_(i - 1, "."):
                i = self.interface(i, end)
            elif self.is_(i, "enum") and self.word(i + 1) and self.is_(i + 2, "{"):
                last = matching(ts, i + 2)
                begin = i - 1 if self.is_(i - 1, "const", "declare") else i
                self.out.symbols.append(Symbol(ts[i + 1].text, "enum", ts[begin].row, ts[last].row, visibility=self.exported(begin)))
                i = last + 1
            elif self.is_(i, "type") and self.word(i + 1) and self.is_(after_generics(ts, i + 2), "="):
                i = self.type_alias(i, end)
            elif self.is_(i, "function") and not self.is_(i - 1, ".", "?."):
                i = self.function(i, end)
            elif self.is_(i, "const", "let", "var") and self.word(i + 1):
                i = self.variable(i, end)
            elif self.is_(i, "new") and self.word(i + 1):
                i = self.new(i)
            elif self.is_(i, "<") and self.word(i + 1) and self.element(i):
                self.out.call(ts[i + 1].text, ts[i + 1].row)
                i += 2
            elif self.word(i):
                i = self.name(i, end)
            else:
                i += 1

    def name(self, i: int, end: int) -> int:
        """A called name; of test(...) and it(...) also the callback."""
        ts, t = self.ts, self.ts[i]
        j = i + 1
        if self.is_(j, "<"):
            k = after_generics(ts, j)
            j = k if self.is_(k, "(") and all(x.kind == "id" or x.text in "<>,.[]|&{}:;" for x in ts[j:k]) else j
        if self.is_(j, "?.") and self.is_(j + 1, "("):
            j += 1
        if not self.is_(j, "("):
            return i + 1
        member = self.is_(i - 1, ".", "?.")
        # in `for (x of (...))` the word stands after a name or a pattern
        loop = t.text == "of" and (self.word(i - 1) or self.is_(i - 1, "]", "}")) and ts[i - 1].row == t.row
        if member or (t.text not in NOT_CALLED and not loop):
            self.out.call(t.text, t.row)
            callee = i - 2 if member and t.text in VARIANTS and self.is_(i - 2, *TESTS) else i
            if self.is_(callee, *TESTS) and not self.is_(callee - 1, ".", "?."):
                self.callback(j)
        return j

    def callback(self, open_: int) -> None:
        """test("...", callback): a symbol for the function argument."""
        ts, close = self.ts, matching(self.ts, open_)
        i = open_ + 1
        while i < close:
            begin = i
            if self.is_(i, "async"):
                i += 1
            if self.is_(i, "function"):
                while i < close and not self.is_(i, "("):
                    i += 1
                body = self.past_type(matching(ts, i) + 1, close)
                last = matching(ts, body) if self.is_(body, "{") else None
            else:
                arrow = self.arrow(i, close)
                last = self.arrow_end(arrow, close) if arrow else None
            if last is not None:
                self.callbacks += 1
                name = f"__ts_test_{ts[begin].row}_{self.callbacks}"
                self.out.symbols.append(Symbol(name, "function", ts[begin].row, ts[min(last, close)].row, signature="test callback", is_test=True))
                return
            while i < close and not self.is_(i, ","):
                i = matching(ts, i) + 1 if self.is_(i, "(", "[", "{") else i + 1
            i += 1

    def past_type(self, i: int, end: int) -> int:
        """After an optional `: type`, at `{`, `=>` or `;`."""
        ts = self.ts
        if self.is_(i, ":"):
            i += 1
            while i < end and not self.is_(i, "=>", ";"):
                if self.is_(i, "{"):
                    if not self.is_(i - 1, ":", "|", "&", "<", "=>"):
                        break
                    i = matching(ts, i) + 1
                elif self.is_(i, "(", "["):
                    i = matching(ts, i) + 1
                else:
                    i += 1
        return i

    def arrow(self, i: int, end: int) -> int | None:
        """Index of the => of an arrow function that starts at i."""
        ts = self.ts
        i += self.is_(i, "async")
        i = after_generics(ts, i)
        if self.word(i) and self.is_(i + 1, "=>"):
            return i + 1
        if self.is_(i, "("):
            j = self.past_type(matching(ts, i) + 1, end)
            return j if self.is_(j, "=>") else None
        return None

    def arrow_end(self, arrow: int, end: int) -> int:
        """The last token of the arrow function's body."""
        ts, i = self.ts, arrow + 1
        if self.is_(i, "{"):
            return matching(ts, i)
        while i < end and not self.is_(i, ",", ";", ")", "]", "}"):
            if i > arrow + 1 and self.is_(i, "const", "let", "var", "function", "class", "export", "import"):
                break
            i = matching(ts, i) + 1 if self.is_(i, "(", "[", "{") else i + 1
        return i - 1

    def exported(self, i: int) -> str | None:
        return "export" if self.is_(i - 1, "export") or (self.is_(i - 1, "default") and self.is_(i - 2, "export")) else None

    def function(self, i: int, end: int) -> int:
        ts, j = self.ts, i + 1
        begin = i - 1 if self.is_(i - 1, "async") else i
        j += self.is_(j, "*")
        name = ts[j].text if self.word(j) else None
        open_ = after_generics(ts, j + 1 if name else j)
        if not self.is_(open_, "("):
            return i + 1
        close = matching(ts, open_)
        body = self.past_type(close + 1, end)
        if not self.is_(body, "{"):
            return body + 1
        last = matching(ts, body)
        statement = begin == 0 or self.is_(begin - 1, ";", "{", "}", "export", "default", ")") or ts[begin - 1].row < ts[begin].row and not self.is_(begin - 1, "=", "(", ",", "?", ":", "=>", "return")
        if name and statement:
            self.out.symbols.append(Symbol(name, "function", ts[begin].row, ts[last].row, visibility=self.exported(begin), signature="function " + self.text[ts[open_].start : ts[close].end], is_test=name.startswith("test")))
        self.code(open_ + 1, close)
        self.code(body + 1, min(last, end))
        return last + 1

    def variable(self, i: int, end: int) -> int:
        """`const f = (..) => ..` and `const f = function ..` are symbols."""
        ts, name = self.ts, self.ts[i + 1].text
        j = i + 2
        if self.is_(j, ":"):
            while j < end and not self.is_(j, "=", ";"):
                j = matching(ts, j) + 1 if self.is_(j, "(", "[", "{") else j + 1
        if not self.is_(j, "="):
            return i + 2
        k = j + 1
        arrow = self.arrow(k, end)
        head, last = None, None
        if arrow is not None:
            open_ = after_generics(ts, k + self.is_(k, "async"))
            params = self.text[ts[open_].start : ts[matching(ts, open_)].end] if self.is_(open_, "(") else ts[open_].text
            head, last = f"const => {params}", self.arrow_end(arrow, end)
        elif self.is_(k, "function") or (self.is_(k, "async") and self.is_(k + 1, "function")):
            open_ = k
            while open_ < end and not self.is_(open_, "("):
                open_ += 1
            close = matching(ts, open_)
            body = self.past_type(close + 1, end)
            if self.is_(body, "{"):
                head, last = "const function " + self.text[ts[open_].start : ts[close].end], matching(ts, body)
        if head is not None:
            # the symbol is the declarator, which starts at its name
            self.out.symbols.append(Symbol(name, "function", ts[i + 1].row, ts[min(last, len(ts) - 1)].row, visibility=self.exported(i), signature=head, is_test=name.startswith("test")))
        return j + 1

    def new(self, i: int) -> int:
        ts, j = self.ts, i + 1
        while self.is_(j + 1, ".") and self.word(j + 2):
            j += 2
        if self.is_(j, "class", "function"):
            return i + 1
        self.out.call(ts[j].text, ts[j].row)
        k = after_generics(ts, j + 1)
        return k if self.is_(k, "(") else j + 1

    def element(self, i: int) -> bool:
        """<Name .. as a JSX element: an upper-case name where a value may start."""
        ts = self.ts
        first = ts[i + 1].text[:1]
        if not ("A" <= first <= "Z") or ts[i].end != ts[i + 1].start or self.is_(i + 2, "."):
            return False
        before = ts[i - 1] if i else None
        opens = before is None or before.kind == "op" and before.text in ("(", ",", "=", ":", "[", "?", "&&", "||", "=>", "{", "}", ">", ";") or before.text in ("return", "default") or before.row < ts[i].row
        after = ts[i + 2] if i + 2 < len(ts) else None
        return opens and after is not None and (after.text in ("/", ">", "{") or after.kind == "id")

    def heritage(self, j: int, end: int, name: str | None) -> int:
        """`extends A<B> implements C, D` up to the body."""
        ts, state = self.ts, None
        while j < end and not self.is_(j, "{"):
            if self.is_(j, "extends", "implements"):
                state = {"extends": "inherit", "implements": "implement"}[ts[j].text]
                fresh = True
            elif state and self.is_(j, ","):
                fresh = True
            elif state and fresh and self.word(j):
                k = j
                while self.is_(k + 1, ".") and self.word(k + 2):
                    k += 2
                self.out.refs.append(Reference(state, self.text[ts[j].start : ts[k].end], None, ts[j].row, name))
                fresh, j = False, k
            elif self.is_(j, "<"):
                j = after_generics(ts, j) - 1
            elif self.is_(j, "("):
                close = matching(ts, j)
                self.code(j, close)
                j = close
            j += 1
        return j

    def class_(self, i: int, end: int) -> int:
        ts = self.ts
        begin = i - 1 if self.is_(i - 1, "abstract") else i
        name = ts[i + 1].text if self.word(i + 1) and not self.is_(i + 1, "extends", "implements") else None
        j = after_generics(ts, i + 2 if name else i + 1)
        j = self.heritage(j, end, name)
        if not self.is_(j, "{"):
            return j + 1
        last = matching(ts, j)
        if name:
            self.out.symbols.append(Symbol(name, "class", ts[begin].row, ts[last].row, visibility="abstract" if begin < i else None))
        self.members(j + 1, min(last, end), name)
        return last + 1

    def members(self, i: int, end: int, owner: str | None) -> None:
        ts = self.ts
        while i < end:
            if self.is_(i, "@"):
                i += 1
                while self.word(i) and self.is_(i + 1, "."):
                    i += 2
                if self.is_(i + 1, "("):
                    close = matching(ts, i + 1)
                    self.code(i, close)
                    i = close
                i += 1
                continue
            begin = i
            while self.word(i) and ts[i].text in MODIFIERS and not self.is_(i + 1, "(", "=", ":", ";", "?", "<"):
                i += 1
            i += self.is_(i, "*") + self.is_(i, "#")
            computed = self.is_(i, "[")
            at = matching(ts, i) if computed else i
            open_ = after_generics(ts, at + 1 + self.is_(at + 1, "?"))
            if (self.word(at) or ts[at].kind in ("str", "num") or computed) and self.is_(open_, "("):
                close = matching(ts, open_)
                body = self.past_type(close + 1, end)
                if self.is_(body, "{"):
                    last = matching(ts, body)
                    if self.word(at):
                        shown = next((t.text for t in ts[begin:i] if t.text in ACCESS), None)
                        self.out.symbols.append(Symbol(ts[at].text, "method", ts[begin].row, ts[last].row, owner, shown, "method " + self.text[ts[open_].start : ts[close].end]))
                    self.code(open_ + 1, close)
                    self.code(body + 1, min(last, end))
                    i = last + 1
                    continue
                i = body + 1
                continue
            # a field: its value may call
            start = i
            while i < end and not self.is_(i, ";"):
                if i > start and ts[i].row > ts[i - 1].row and not self.is_(i - 1, "=", ",", "(", ".", "=>", "|", "&", ":") and not self.is_(i, ".", "?.", "|", "&", "=", ")"):
                    break
                i = matching(ts, i) + 1 if self.is_(i, "(", "[", "{") else i + 1
            value = next((k for k in range(start, min(i, end)) if self.is_(k, "=")), None)
            if value is not None:
                self.code(value + 1, min(i, end))
            i = max(i, start + 1) if not self.is_(i, ";") else i + 1

    def interface(self, i: int, end: int) -> int:
        ts, j = self.ts, i + 2
        while j < end and not self.is_(j, "{"):
            j += 1
        last = matching(ts, j) if j < end else end - 1
        self.out.symbols.append(Symbol(ts[i + 1].text, "interface", ts[i].row, ts[last].row, visibility=self.exported(i)))
        return last + 1

    def type_alias(self, i: int, end: int) -> int:
        ts = self.ts
        j = i + 2
        while j < end and not self.is_(j, ";"):
            if ts[j].row > ts[j - 1].row and not self.is_(j, "|", "&", "=", "?", ":") and not self.is_(j - 1, "=", "|", "&", "?", ":", "=>"):
                return j
            j = matching(ts, j) + 1 if self.is_(j, "(", "[", "{") else j + 1
        return j + 1

    def import_(self, i: int, end: int) -> int:
        ts, j, row = self.ts, i + 1, self.ts[i].row
        j += self.is_(j, "type") and not self.is_(j + 1, "from", ",")
        default, named = None, []
        while j < end and ts[j].kind != "str" and not self.is_(j, ";"):
            if self.is_(j, "{"):
                close = matching(ts, j)
                k = j + 1
                while k < close:
                    k += self.is_(k, "type") and self.word(k + 1) and not self.is_(k + 1, "as")
                    if self.word(k):
                        alias = ts[k + 2].text if self.is_(k + 1, "as") and self.word(k + 2) else None
                        named.append((ts[k].text, alias, ts[k].row))
                        k += 2 if alias else 0
                    k += 1
                j = close
            elif self.is_(j, "*"):
                j += 2
            elif self.word(j) and not self.is_(j, "from", "as"):
                default = default or ts[j].text
            j += 1
        if j < end and ts[j].kind == "str":
            source = ts[j].text[1:-1]
            self.out.imports += [Import(alias or name, f"{source}.{name}", alias, at) for name, alias, at in named]
            if default:
                self.out.imports.append(Import(default, f"{source}.default", None, row))
        return j + 1


def extract(text: str) -> Extract:
    r = _Reader(text)
    r.code(0, len(r.ts))
    return r.out.finish()
