"""The call graph by name: callers and callees to a chosen depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import split_qualified
from graphloom.plans.catalog import CodeGraph, in_path
from graphloom.plans import traverse
from graphloom.plans.tables import durable
from graphloom.schema import TOP_LEVEL

COLUMNS = ("symbol_name", "file_path", "line", "kind")


def _calls(g: CodeGraph, depth: int) -> DataFrame:
    """Call references with the file and the name of the calling symbol."""
    source = g.symbols.select(F.col("id").alias("source_symbol_id"), F.col("name").alias("source_name"), F.col("parent_id").alias("source_parent_id"))
    located = g.refs.where("kind = 'call'").join(g.paths(key="source_file_id"), "source_file_id")
    calls = located.join(source, "source_symbol_id", "left")
    # a deep walk reads them again at each level
    return durable(calls, "calls") if depth > traverse.UNROLLED else calls


def _as_callers(rows: DataFrame, *key: str) -> DataFrame:
    name = F.coalesce("source_name", F.lit(TOP_LEVEL)).alias("symbol_name")
    return rows.select(*key, name, "file_path", "line", "kind").distinct()


def find_callers(g: CodeGraph, name: str, file: str | None = None, depth: int = 1) -> DataFrame:
    """Who calls a name.  A qualifier must be the text written at the call; with a
    file, calls resolved to the name's symbols there, or unresolved by name."""
    bare, qualifier = split_qualified(name)
    calls = _calls(g, depth)
    if file is None:
        first = calls.where(F.col("target_name") == bare)
        if qualifier is not None:
            first = first.where(F.col("target_qualifier") == qualifier)
    else:
        ids = g.named(bare, qualifier).where(in_path("file_path", file)).select(F.col("id").alias("target_symbol_id"))
        known = calls.join(ids, "target_symbol_id", "left_semi")
        # calls without a target count only where the file has the name at all: one row, broadcast
        loose = calls.where(F.col("target_symbol_id").isNull() & (F.col("target_name") == bare))
        some = ids.limit(1).agg(F.count("*").alias("_some"))
        first = known.unionByName(loose.crossJoin(F.broadcast(some)).where("_some > 0").drop("_some"))

    def expand(frontier: DataFrame) -> DataFrame:
        return _as_callers(calls.join(frontier.withColumnRenamed("name", "target_name"), "target_name", "left_semi"), "target_name").drop("target_name")

    return traverse.levels(_as_callers(first), expand, "symbol_name", name, depth).select(*COLUMNS)


def find_callees(g: CodeGraph, name: str, file: str | None = None, depth: int = 1) -> DataFrame:
    """What a name's symbols call, with the calling file; repeated calls stay."""
    bare, qualifier = split_qualified(name)
    calls = _calls(g, depth).where(F.col("source_name").isNotNull())
    shape = lambda rows: rows.select(F.col("target_name").alias("symbol_name"), "file_path", "line", "kind")
    first = calls.where((F.col("source_name") == bare) & in_path("file_path", file))
    if qualifier is not None:
        parents = g.symbols.where(F.col("name") == qualifier).select(F.col("id").alias("source_parent_id"))
        first = first.join(parents, "source_parent_id", "left_semi")

    def expand(frontier: DataFrame) -> DataFrame:
        return shape(calls.join(frontier.withColumnRenamed("name", "source_name"), "source_name", "left_semi"))

    return traverse.levels(shape(first), expand, "symbol_name", name, depth).select(*COLUMNS)
