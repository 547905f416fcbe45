"""Symbols of QML documents; rows count from 1 here."""

from __future__ import annotations

from graphloom.sources.extract.lexer import SCRIPT, matching, tokens
from graphloom.sources.extract.model import Extract, Symbol


def extract(text: str) -> Extract:
    ts, out = tokens(text, SCRIPT), Extract()

    def is_(i: int, *texts: str) -> bool:
        return 0 <= i < len(ts) and ts[i].kind != "str" and ts[i].text in texts

    def put(name: str, kind: str, first: int, last: int, parent: str | None) -> None:
        out.symbols.append(Symbol(name, kind, ts[first].row + 1, ts[min(last, len(ts) - 1)].row + 1, parent, None, header(first, last)))

    def header(first: int, last: int) -> str:
        """The declaration up to its body, its default value or its end."""
        j = first
        while j <= last and j < len(ts) and not is_(j, "{", ":", ";"):
            j = matching(ts, j) + 1 if is_(j, "(") else j + 1
        return " ".join(text[ts[first].start : ts[min(j, len(ts)) - 1].end].split())

    def line_end(i: int, end: int) -> int:
        j = i
        while j + 1 < end and ts[j + 1].row == ts[i].row and not is_(j + 1, ";", "}"):
            j = min(matching(ts, j + 1), end - 1) if is_(j + 1, "(", "[", "{") else j + 1
        return j

    def body(i: int, end: int, parent: str | None, script: bool) -> None:
        while i < end:
            if is_(i, "function") and i + 1 < end and ts[i + 1].kind == "id":
                j = i + 2
                while j < end and not is_(j, "{"):
                    j = matching(ts, j) + 1 if is_(j, "(") else j + 1
                last = matching(ts, j) if j < end else end - 1
                put(ts[i + 1].text, "function", i, last, parent)
                body(j + 1, min(last, end), ts[i + 1].text, True)
                i = last + 1
            elif script:
                i += 1
            elif is_(i, "component") and is_(i + 2, ":") and ts[i + 1].kind == "id":
                j = i + 3
                while j < end and not is_(j, "{"):
                    j += 1
                last = matching(ts, j) if j < end else end - 1
                put(ts[i + 1].text, "class", i, last, parent)
                body(j + 1, min(last, end), ts[i + 1].text, False)
                i = last + 1
            elif is_(i, "signal") and i + 1 < end and ts[i + 1].kind == "id":
                last = matching(ts, i + 2) if is_(i + 2, "(") else i + 1
                put(ts[i + 1].text, "event", i, last, parent)
                i = last + 1
            elif is_(i, "property") and i + 2 < end and ts[i + 1].kind == "id":
                j = i + 1
                while j + 1 < end and not is_(j + 1, ":", ";", "}") and ts[j + 1].row == ts[i].row:
                    j += 1
                put(ts[j].text, "property", i, line_end(i, end), parent)
                i = j + 1
            elif is_(i, "import", "pragma"):
                row = ts[i].row
                while i < end and ts[i].row == row:
                    i += 1
            elif ts[i].kind == "id":
                j = i
                while is_(j + 1, ".") and j + 2 < end and ts[j + 2].kind == "id":
                    j += 2
                if is_(j + 1, "{") and ts[j].text[:1].isupper():
                    last = matching(ts, j + 1)
                    put(text[ts[i].start : ts[j].end], "class", i, last, parent)
                    body(j + 2, min(last, end), text[ts[i].start : ts[j].end], False)
                    i = last + 1
                elif is_(j + 1, ":") and is_(j + 2, "{"):
                    last = matching(ts, j + 2)
                    body(j + 3, min(last, end), parent, True)
                    i = last + 1
                else:
                    i = j + 1
            else:
                i += 1

    body(0, len(ts), None, False)
    return out
