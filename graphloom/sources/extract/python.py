"""Symbols, calls, bases and imports of Python sources.

Sources that do not parse are read without the lines from the first error on
that cannot be repaired; an unreadable file gives nothing but never fails.
"""

from __future__ import annotations

import ast
import warnings

from graphloom.sources.extract.model import Extract, Import, Reference, Symbol

ATTEMPTS = 200


def visibility(name: str) -> str | None:
    if name.startswith("__") and not name.endswith("__"):
        return "private"
    return "protected" if name.startswith("_") else None


def _parsed(text: str) -> ast.Module:
    lines = text.split("\n")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for _ in range(min(ATTEMPTS, len(lines)) + 1):
            try:
                return ast.parse("\n".join(lines))
            except SyntaxError as e:
                at = min(max((e.lineno or 1) - 1, 0), len(lines) - 1)
                indent = lines[at][: len(lines[at]) - len(lines[at].lstrip())]
                lines[at] = indent + "pass" if lines[at].strip() != "pass" else ""
            except (ValueError, RecursionError, MemoryError):
                break
    return ast.Module([], [])


def _dotted(node: ast.expr) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        before = _dotted(node.value)
        return None if before is None else f"{before}.{node.attr}"
    return None


def _params(text_lines: list[bytes], node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    """The parameter list as written, brackets included."""
    rest = b"\n".join([text_lines[node.lineno - 1][node.col_offset :], *text_lines[node.lineno : node.end_lineno]])
    rest = rest[rest.find(node.name.encode()) :]
    begin = rest.find(b"(")
    depth, quote = 0, 0
    for i in range(begin, len(rest)):
        c = rest[i]
        if quote:
            quote = 0 if c == quote and rest[i - 1] != 92 else quote
        elif c in b"\"'":
            quote = c
        elif c in b"([{":
            depth += 1
        elif c in b")]}":
            depth -= 1
            if not depth:
                return rest[begin : i + 1].decode("utf-8", "replace")
    return "()"


class _Visitor(ast.NodeVisitor):
    def __init__(self, lines: list[bytes]) -> None:
        self.lines, self.out, self.classes = lines, Extract(), []

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.out.symbols.append(Symbol(node.name, "class", node.lineno - 1, node.end_lineno - 1))
        for base in node.bases:
            if isinstance(base, ast.Name):
                self.out.refs.append(Reference("inherit", base.id, None, base.lineno - 1, node.name))
            elif isinstance(base, ast.Attribute):
                self.out.refs.append(Reference("inherit", base.attr, _dotted(base), base.lineno - 1, node.name))
        self.classes.append(node.name)
        self.generic_visit(node)
        self.classes.pop()

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        inside = self.classes[-1] if self.classes else None
        self.out.symbols.append(Symbol(node.name, "method" if inside else "function", node.lineno - 1, node.end_lineno - 1, inside, visibility(node.name), "def " + _params(self.lines, node), node.name.startswith("test")))
        self.generic_visit(node)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Call(self, node: ast.Call) -> None:
        if isinstance(node.func, ast.Name):
            self.out.call(node.func.id, node.func.lineno - 1)
        elif isinstance(node.func, ast.Attribute):
            self.out.call(node.func.attr, node.func.end_lineno - 1)
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            if a.asname is None:
                self.out.imports.append(Import(a.name.split(".")[-1], a.name, None, a.lineno - 1))

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for a in node.names:
            if a.name != "*":
                path = f"{node.module}.{a.name}" if node.module and not node.level else a.name
                self.out.imports.append(Import(a.asname or a.name, path, a.asname, a.lineno - 1))


def extract(text: str) -> Extract:
    v = _Visitor([line.encode() for line in text.split("\n")])
    v.visit(_parsed(text))
    return v.out.finish()
