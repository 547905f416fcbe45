"""Inheritance: a name's ancestors and descendants, by files they share.

An inheritance reference belongs to every symbol of its file, as in the data
model; `depth` is the least distance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.catalog import CodeGraph
from graphloom.plans.tables import durable
from graphloom.plans.traverse import least_depths
from graphloom.schema import INHERITANCE, TYPES

COLUMNS = ("name", "kind", "file_path", "relation", "depth")


def _links(g: CodeGraph) -> DataFrame:
    return g.refs.where(F.col("kind").isin(*INHERITANCE)).join(g.paths(key="source_file_id"), "source_file_id").select("source_file_id", "target_name", "kind", "file_path")


def ancestors(g: CodeGraph, name: str) -> DataFrame:
    links = durable(_links(g), "links")  # read again at each level
    homes = durable(g.symbols.select("name", F.col("file_id").alias("source_file_id")).join(links.select("source_file_id"), "source_file_id", "left_semi").distinct(), "homes")
    depths, _ = least_depths(homes.withColumnRenamed("source_file_id", "at"), links.select(F.col("source_file_id").alias("at"), F.col("target_name").alias("next")), name)
    # one row for each (name, reference): a reference counts for each name of its file
    of = homes.join(depths, "name").select("source_file_id", "depth")
    return links.join(of, "source_file_id").select(F.col("target_name").alias("name"), "kind", "file_path", F.lit("ancestor").alias("relation"), "depth")


def descendants(g: CodeGraph, name: str) -> DataFrame:
    links = durable(_links(g), "links")  # read again at each level
    types = durable(g.symbols.where(F.col("kind").isin(*TYPES)).select("name", F.col("file_id").alias("source_file_id")).join(links.select("source_file_id"), "source_file_id", "left_semi"), "types")
    depths, _ = least_depths(links.select(F.col("target_name").alias("name"), F.col("source_file_id").alias("at")), types.select(F.col("source_file_id").alias("at"), F.col("name").alias("next")), name)
    hit = links.join(depths.withColumnRenamed("name", "target_name"), "target_name")
    found = hit.join(types, "source_file_id").select("target_name", "name", "kind", "file_path", "depth").distinct()
    return found.select("name", "kind", "file_path", F.lit("descendant").alias("relation"), "depth")


def find_hierarchy(g: CodeGraph, name: str, direction: str = "both") -> DataFrame:
    """Ancestors, descendants or both; an unknown direction gives no rows."""
    parts = [f(g, name) for key, f in (("ancestors", ancestors), ("descendants", descendants)) if direction in (key, "both")]
    if not parts:
        return g.spark.createDataFrame([], "name string, kind string, file_path string, relation string, depth int")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
