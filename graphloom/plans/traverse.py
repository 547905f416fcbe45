"""Traversals of name graphs, set-based, with few jobs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.tables import bucketed, discard, durable, durable_counted
from graphloom.schema import TOP_LEVEL

UNROLLED = 1
#: Levels that reachable() walks in one job.
LEVELS_A_JOB = 3
#: Levels that least_depths() walks before it starts to double.
PLAIN_LEVELS = 4


def levels(first: DataFrame, expand: Callable[[DataFrame], DataFrame], follow: str, seed: str, max_depth: int | None) -> DataFrame:
    """Rows of every reached name, each name expanded once at its least depth.

    `expand` takes (name) and gives the rows of those names; column `follow` of
    a row names the next one.  A walk of more than UNROLLED levels writes each
    frontier to the shared folder, so plans stay flat and no level is derived twice.
    """
    spark = first.sparkSession
    if max_depth is not None and max_depth < 1:
        return first.withColumn("depth", F.lit(0)).limit(0)
    deep = max_depth is None or max_depth > UNROLLED
    out = [first.withColumn("depth", F.lit(0))]
    seen = spark.createDataFrame([(seed,)], "name string")
    for depth in count(1):
        if max_depth is not None and depth >= max_depth:
            break
        named = out[-1].select(F.col(follow).alias("name")).where(F.col("name") != TOP_LEVEL).distinct()
        frontier = named.join(seen, "name", "left_anti")
        if deep:
            frontier, found = durable_counted(frontier, "frontier")
            if not found:
                break
        seen = seen.unionByName(frontier)
        out.append(expand(frontier).withColumn("depth", F.lit(depth)))
    return reduce(DataFrame.unionByName, out)


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(name): the seeds and all names that edges (source, target) lead to.

    The edges are written once, in buckets of their source, so no level shuffles them;
    a job walks LEVELS_A_JOB levels, of which only the first can find nothing new.
    """
    edges = bucketed(edges.distinct(), "source", name="edges")
    seen, found = durable_counted(seeds.where("name is not null").distinct(), "reached")
    parts = [frontier := seen]
    while found:
        # levels inside a job may meet names that were seen; the job's end removes them
        steps = [frontier]
        for _ in range(LEVELS_A_JOB):
            steps.append(edges.join(steps[-1].withColumnRenamed("name", "source"), "source", "left_semi").select(F.col("target").alias("name")).distinct())
        new = reduce(DataFrame.unionByName, steps[1:]).distinct()
        frontier, found = durable_counted(new.join(seen, "name", "left_anti"), "reached")
        parts.append(frontier)
        seen = seen.unionByName(frontier)
    out = durable(seen, "reached")
    discard(edges, *parts)
    return out


def least_depths(enter: DataFrame, leave: DataFrame, seed: str) -> tuple[DataFrame, int]:
    """(name, depth) of every name that the seed leads to, and the number of rounds.

    A step goes from a name to a place, by `enter` (name, at), and from there to a name,
    by `leave` (at, next).  After PLAIN_LEVELS levels, names with a single next one
    (most of a deep chain) also get jumps of 1, 4, 16, ... steps: a table of one row a
    name each, so a chain is walked in rounds by the logarithm of its length.  Depths
    are corrected where another way is shorter, so the least one is kept.
    """
    spark = enter.sparkSession
    enter, leave = enter.distinct(), leave.where(F.col("next") != TOP_LEVEL).distinct()
    known = durable(spark.createDataFrame([(seed, 0)], "name string, depth int"), "known")
    frontier, found, rounds, jumps, span, left = known, 1, 0, [], 1, None
    stale: list[DataFrame] = []
    while found:
        rounds += 1
        step = frontier.join(enter, "name").join(leave, "at").select(F.col("next").alias("name"), (F.col("depth") + 1).alias("depth"))
        if rounds > PLAIN_LEVELS:
            if left is None:  # single places and single next names
                one = enter.groupBy("name").agg(F.min("at").alias("at"), F.max("at").alias("most")).where("at = most").drop("most")
                then = leave.groupBy("at").agg(F.min("next").alias("next"), F.max("next").alias("most")).where("next = most").drop("most")
                jump, left = durable_counted(one.join(then, "at").where("name <> next").select("name", "next"), "jump")
            elif left:  # four times as far
                last = jumps[-1][0]
                for k in range(3):
                    on = jumps[-1][0].select(F.col("name").alias("next"), F.col("next").alias(f"next{k}"))
                    last = last.join(on, "next").drop("next").withColumnRenamed(f"next{k}", "next")
                jump, left = durable_counted(last.select("name", "next"), "jump")
            if left and len(jumps) < rounds - PLAIN_LEVELS:
                jumps.append((jump, span))
                span *= 4
            # the newest jumps from all that is known, the others from what is new
            for k, (table, length) in enumerate(jumps):
                at = known if k == len(jumps) - 1 else frontier
                for _ in range(3):
                    at = at.join(table, "name").select(F.col("next").alias("name"), (F.col("depth") + length).alias("depth"))
                    step = step.unionByName(at)
        better = step.groupBy("name").agg(F.min("depth").alias("depth"))
        better = better.join(known.withColumnRenamed("depth", "had"), "name", "left").where("had is null or depth < had").drop("had")
        frontier, found = durable_counted(better, "frontier")
        stale += [known, frontier]
        if found:
            known = durable(known.join(frontier, "name", "left_anti").unionByName(frontier), "known")
    discard(*[t for t in stale if t is not known], *[t for t, _ in jumps])
    return known, rounds
