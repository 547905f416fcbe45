"""Connected components of an edge table, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import discard, durable


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): each id of an edge with the smallest id it is joined to.

    Each round points every larger neighbour, then every smaller one, at the
    smallest id known; rounds grow with the logarithm of the longest path.  A
    star's centre is aggregated map-side and its join can be split.
    """
    pairs = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    pairs = durable(pairs.distinct(), "pairs")
    before = None
    while True:
        # large star: larger neighbours go to the least of the neighbourhood
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = durable(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "pairs")
        discard(pairs)
        pairs = after
        state = tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == before:
            break
        before = state
    lone = pairs.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(lone)
