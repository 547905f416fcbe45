"""Symbol lookups: definitions, listing, dead code, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import split_qualified
from graphloom.plans.catalog import CodeGraph, in_path, stored_symbols
from graphloom.schema import ENTRY_POINTS

ORDER = ("file_path", "line_start", "id")


def find_symbols(g: CodeGraph, name: str, kind: str | None = None, file: str | None = None) -> DataFrame:
    """Definitions of a name; `A::b`, `A\\b` and `A.b` ask for a parent named A."""
    found = g.named(*split_qualified(name)).where(in_path("file_path", file))
    return stored_symbols(found if kind is None else found.where(F.col("kind") == kind))


def list_symbols(g: CodeGraph, kind: str | None = None, file: str | None = None) -> DataFrame:
    found = g.located_symbols().where(in_path("file_path", file))
    return stored_symbols(found if kind is None else found.where(F.col("kind") == kind)).orderBy(*ORDER)


def callables(g: CodeGraph, path: str | None, exclude: Sequence[str]) -> DataFrame:
    """Functions and methods but entry points and excluded names."""
    found = g.located_symbols().where(F.col("kind").isin("function", "method") & in_path("file_path", path))
    return found.where(~F.col("name").isin(*ENTRY_POINTS, *exclude))


def find_dead_code(g: CodeGraph, path: str | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """Functions and methods whose name no call anywhere mentions."""
    called = g.refs.where("kind = 'call'").select(F.col("target_name").alias("name")).distinct()
    return stored_symbols(callables(g, path, exclude).join(called, "name", "left_anti")).orderBy(*ORDER)


def status(g: CodeGraph) -> DataFrame:
    """One row: files, symbols, references."""
    counted = [t.agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "n") for k, t in (("files", g.files), ("symbols", g.symbols), ("refs", g.refs))]
    every = counted[0].unionByName(counted[1]).unionByName(counted[2])
    total = lambda k: F.sum(F.when(F.col("k") == k, F.col("n"))).cast("long")
    return every.agg(total("files").alias("files"), total("symbols").alias("symbols"), total("refs").alias("references"))
