"""Snapshots of a code graph: immutable Parquet folders and one pointer.

A writer puts a new snapshot beside the old and swaps CURRENT in one rename, so
readers always see a whole graph.  Two advisory locks keep writers apart.
"""

from __future__ import annotations

import fcntl
import json
import os
import shutil
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

from graphloom import schema
from graphloom.plans.catalog import CodeGraph, empty_graph

TABLES = {"files": schema.FILES, "symbols": schema.SYMBOLS, "refs": schema.REFS, "imports": schema.IMPORTS, "sources": schema.SOURCES}
KEPT = 2


class Busy(RuntimeError):
    """Another writer holds the lock."""


class Store:
    def __init__(self, spark: SparkSession, folder: str | Path) -> None:
        self.spark, self.folder = spark, Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def current(self) -> int | None:
        try:
            return int((self.folder / "CURRENT").read_text())
        except FileNotFoundError:
            return None

    def graph(self, version: int | None = None) -> CodeGraph:
        """A snapshot (the current one), pinned; empty if there is none.  Columns
        that an older snapshot lacks are null."""
        version = self.current() if version is None else version
        if version is None:
            return empty_graph(self.spark)
        read = lambda t: self.spark.read.schema(TABLES[t]).parquet(str(self.folder / str(version) / t))
        return CodeGraph(*(read(t) for t in TABLES))

    def commit(self, graph: CodeGraph) -> int:
        version = (self.current() or 0) + 1
        path = self.folder / str(version)
        shutil.rmtree(path, ignore_errors=True)
        for t in TABLES:
            getattr(graph, t).write.parquet(str(path / t))
        swap = self.folder / "CURRENT.new"
        swap.write_text(str(version))
        os.replace(swap, self.folder / "CURRENT")
        for old in self.folder.iterdir():
            if old.name.isdigit() and int(old.name) <= version - KEPT:
                shutil.rmtree(old, ignore_errors=True)
        return version

    def reset(self) -> None:
        """Empties the tables; meta stays."""
        self.commit(empty_graph(self.spark))

    def meta(self) -> dict[str, str]:
        try:
            return json.loads((self.folder / "meta.json").read_text())
        except FileNotFoundError:
            return {}

    def set_meta(self, key: str, value: str) -> None:
        new = self.folder / "meta.json.new"
        new.write_text(json.dumps(self.meta() | {key: value}))
        os.replace(new, self.folder / "meta.json")

    @contextmanager
    def lock(self, name: str = "index", wait: bool = True) -> Iterator[None]:
        with open(self.folder / f"{name}.lock", "w") as f:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | (0 if wait else fcntl.LOCK_NB))
            except BlockingIOError:
                raise Busy(name) from None
            yield
