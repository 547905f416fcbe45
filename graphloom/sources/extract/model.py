"""What an extractor gives for one file."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Symbol:
    name: str
    kind: str
    line_start: int
    line_end: int
    parent_name: str | None = None
    visibility: str | None = None
    signature: str | None = None
    is_test: bool = False


@dataclass
class Reference:
    kind: str
    target_name: str
    target_qualifier: str | None
    line: int
    source_symbol_name: str | None = None


@dataclass
class Import:
    local_name: str
    full_path: str
    alias: str | None
    line: int


@dataclass
class Extract:
    symbols: list[Symbol] = field(default_factory=list)
    refs: list[Reference] = field(default_factory=list)
    imports: list[Import] = field(default_factory=list)

    def call(self, name: str, line: int, qualifier: str | None = None) -> None:
        self.refs.append(Reference("call", name, qualifier, line))

    def finish(self) -> Extract:
        """References without a source get the symbol around their line."""
        for r in self.refs:
            if r.source_symbol_name is None:
                r.source_symbol_name = self.around(r.line)
        return self

    def around(self, line: int) -> str | None:
        """The shortest symbol that holds the line, the first on ties."""
        held = [s for s in self.symbols if s.line_start <= line <= s.line_end]
        return min(held, key=lambda s: s.line_end - s.line_start).name if held else None
