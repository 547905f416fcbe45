"""All references to a name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import split_qualified
from graphloom.plans.catalog import CodeGraph
from graphloom.plans.tables import growing


def find_references(g: CodeGraph, name: str, kind: str | None = None) -> DataFrame:
    bare, qualifier = split_qualified(name)
    rows = g.refs.where(F.col("target_name") == bare)
    if qualifier is not None:
        rows = rows.where(F.col("target_qualifier") == qualifier)
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    source = growing(g.symbols.select(F.col("id").alias("source_symbol_id"), F.col("name").alias("source_symbol")))
    target = growing(g.symbols.select(F.col("id").alias("target_symbol_id"), F.col("name").alias("target_symbol"), F.col("file_id").alias("target_file_id")))
    rows = rows.join(growing(g.paths(key="source_file_id", name="source_file")), "source_file_id").join(source, "source_symbol_id", "left")
    rows = rows.join(target, "target_symbol_id", "left").join(growing(g.paths(key="target_file_id", name="target_file")), "target_file_id", "left")
    return rows.orderBy("source_file", "line", "id").select("source_file", "source_symbol", "target_name", "target_qualifier", "kind", "line", "resolved", "target_file", "target_symbol")
