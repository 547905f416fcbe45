"""Digest of a tree: what each directory holds, and the first members of each type."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.catalog import CodeGraph
from graphloom.schema import TYPES

MEMBERS = 50


def directories(g: CodeGraph) -> DataFrame:
    """(directory, files, symbols, types, callables, tests) of every directory that has a
    file below it, at any depth.

    Symbols are counted by file first, so a file's directories are listed once, not
    once for each of its symbols.  Files without symbols count too.
    """
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    kind = F.col("kind")
    held = g.symbols.groupBy("file_id").agg(F.count("*").alias("symbols"), one(kind.isin(*TYPES)).alias("types"), one(kind.isin("function", "method")).alias("callables"), one(F.col("is_test") == 1).alias("tests"))
    files = g.paths().join(held, "file_id", "left").na.fill(0, ["symbols", "types", "callables", "tests"])
    parts = F.split("file_path", "/")
    # the first part of an absolute path is empty, the last is the file
    above = F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    files = files.where(F.size(parts) > 2).withColumn("directory", F.explode(above))
    sums = [F.sum(c).cast("long").alias(c) for c in ("symbols", "types", "callables", "tests")]
    return files.groupBy("directory").agg(F.count("*").alias("files"), *sums)


def members(g: CodeGraph, top: int = MEMBERS) -> DataFrame:
    """(file_path, type, members, rank, name, kind, line_start): the first `top` members of
    each type by line, with the number of all of them; a type without members has a row
    of rank null."""
    types = g.symbols.where(F.col("kind").isin(*TYPES)).select("id", "file_id", F.col("name").alias("type"))
    inside = g.symbols.where("parent_id is not null").select("parent_id", "id", "name", "kind", "line_start")
    count = inside.groupBy("parent_id").agg(F.count("*").alias("members"))
    # the limit is pushed below the shuffle, so a type of many members sends `top` from each task
    order = Window.partitionBy("parent_id").orderBy("line_start", "id")
    first = inside.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).drop("id")
    rows = types.join(count.withColumnRenamed("parent_id", "id"), "id", "left").join(first.withColumnRenamed("parent_id", "id"), "id", "left")
    return rows.join(g.paths(), "file_id").select("file_path", "type", F.coalesce("members", F.lit(0)).alias("members"), "rank", "name", "kind", "line_start")
