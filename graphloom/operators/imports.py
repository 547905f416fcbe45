"""Import lookup, resolution and reverse imports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.substring import candidates, index, needle_pieces
from graphloom.functions.text import ascii_like, last_segment
from graphloom.plans.catalog import CodeGraph, in_path

MARKS = "\\.:/"


def _located(g: CodeGraph, file: str | None) -> DataFrame:
    return g.imports.join(g.paths(name="source_file"), "file_id").where(in_path("source_file", file))


def find_imported_by(g: CodeGraph, name: str, file: str | None = None) -> DataFrame:
    """Imports whose full path holds the name."""
    rows = _located(g, file).where(ascii_like(F.col("full_path"), name)).orderBy("source_file", "line", "id")
    return rows.select(F.col("source_file").alias("file_path"), "local_name", "full_path", "alias", "line")


def query_imports(g: CodeGraph, name: str, file: str | None = None) -> DataFrame:
    """Imports of that local name, or whose full path holds the name."""
    return _located(g, file).where((F.col("local_name") == name) | ascii_like(F.col("full_path"), name))


def resolve_import(g: CodeGraph, name: str, file: str | None = None) -> DataFrame:
    """Imports with their target: a symbol named like the path's last part, the
    first by path whose path holds all parts, else the first by path; where there
    is none, the first symbol of the local name."""
    rows = query_imports(g, name, file).withColumn("actual", last_segment(F.col("full_path"), MARKS))
    target = g.symbols.join(g.paths(), "file_id").select("name", F.struct(F.col("file_path").alias("path"), F.col("id").alias("sid"), "name", "kind", "line_start").alias("t"))
    # the first of a name is one row, whatever the number of its symbols
    first = target.groupBy("name").agg(F.min("t").alias("t"), F.count("*").alias("n"))
    asked = rows.select("actual", "full_path").distinct()
    parts = F.split(F.lower("full_path"), r"[\\.:/]")
    fits = F.forall(parts, lambda p: F.contains(F.lower(F.col("t.path")), p))
    several = first.where("n > 1").select(F.col("name").alias("actual"))
    # looked up by the rarest piece of all parts, in each file's path once
    asked = asked.join(several, "actual", "left_semi")
    held = target.withColumnRenamed("name", "actual").join(asked.select("actual"), "actual", "left_semi")
    texts = held.select(F.col("t.path").alias("id")).distinct().withColumn("text", F.lower("id"))
    needles = asked.select("full_path", F.array_distinct(F.flatten(F.transform(parts, needle_pieces))).alias("pieces")).distinct()
    near = candidates(needles, index(texts, needles.select(F.explode("pieces").alias("piece")))).withColumnRenamed("id", "path")
    best = asked.join(near, "full_path").join(held.withColumn("path", F.col("t.path")), ["actual", "path"]).where(fits)
    best = best.groupBy("actual", "full_path").agg(F.min("t").alias("fit"))
    rows = rows.join(best, ["actual", "full_path"], "left")
    rows = rows.join(first.select(F.col("name").alias("actual"), F.col("t").alias("any")), "actual", "left")
    rows = rows.join(first.select(F.col("name").alias("local_name"), F.col("t").alias("local")), "local_name", "left")
    chosen = F.coalesce("fit", "any", F.when(F.col("local_name") != F.col("actual"), F.col("local")))
    rows = rows.withColumn("c", chosen).orderBy("source_file", "line", "id")
    return rows.select("source_file", "local_name", "full_path", "alias", "line", F.col("c.path").alias("target_file"), F.col("c.name").alias("target_symbol"), F.col("c.kind").alias("target_kind"), F.col("c.line_start").alias("target_line"))
