"""The twelve tools on a project's store, as text."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from graphloom import projects, render
from graphloom.operators import calls, hierarchy, imports, references, resolve, symbols, testing
from graphloom.plans.catalog import CodeGraph
from graphloom.sources import ingest
from graphloom.sources.store import Store


class CodeTools:
    """Each call reads the snapshot that is current then; none refreshes it."""

    def __init__(self, spark: SparkSession, folder: str | Path) -> None:
        self.folder = Path(folder)
        self.store = Store(spark, self.folder / projects.STORE_NAME)

    @property
    def graph(self) -> CodeGraph:
        return self.store.graph()

    def index(self, path: str | None = None, full: bool = False) -> str:
        stats = ingest.index(self.store, path or str(self.folder), full)
        return f"{stats}\n{render.resolution(resolve.stats(resolve.resolve(self.graph)).first())}"

    def symbol(self, name: str, kind: str | None = None, file: str | None = None) -> str:
        return render.symbols(render.rows(symbols.find_symbols(self.graph, name, kind, file)))

    def callers(self, name: str, file: str | None = None, depth: int = 1) -> str:
        return render.calls(render.rows(calls.find_callers(self.graph, name, file, depth)), "callers")

    def callees(self, name: str, file: str | None = None, depth: int = 1) -> str:
        return render.calls(render.rows(calls.find_callees(self.graph, name, file, depth)), "callees")

    def references(self, name: str, kind: str | None = None) -> str:
        return render.references(render.rows(references.find_references(self.graph, name, kind)))

    def hierarchy(self, name: str, direction: str = "both") -> str:
        return render.hierarchy(render.rows(hierarchy.find_hierarchy(self.graph, name, direction)))

    def resolve_import(self, name: str, file: str | None = None) -> str:
        return render.resolved_imports(render.rows(imports.resolve_import(self.graph, name, file)))

    def imported_by(self, name: str, file: str | None = None) -> str:
        return render.imported_by(render.rows(imports.find_imported_by(self.graph, name, file)))

    def tested_by(self, name: str, file: str | None = None, depth: int = 10) -> str:
        return render.tested_by(render.rows(testing.find_tested_by(self.graph, name, file, depth)))

    def untested(self, path: str | None = None, exclude: Sequence[str] = ()) -> str:
        return render.untested(render.rows(testing.find_untested(self.graph, path, exclude)))

    def dead_code(self, path: str | None = None, exclude: Sequence[str] = ()) -> str:
        return render.dead_code(render.rows(symbols.find_dead_code(self.graph, path, exclude)))

    def list(self, kind: str | None = None, file: str | None = None) -> str:
        return render.symbols(render.rows(symbols.list_symbols(self.graph, kind, file)))

    def status(self) -> str:
        return render.status(symbols.status(self.graph).first())
