"""How many tests reach each name, over any number of calls, for all names at once.

Names that call each other in a circle are reached by the same tests.  The strongly
connected component of the busiest name (in a call graph by name usually by far the
largest) becomes one node; smaller circles need no such step, since the walk below
ends on any graph.  Every test symbol has a bit; bits stand in words of 64, a row for
each (node, block of 64 tests) that any of them reaches, and only words that gained
a bit are passed on.  So memory is bounded by rows, not by a set in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.catalog import CodeGraph
from graphloom.plans.tables import bucketed, discard, durable, durable_counted
from graphloom.plans.traverse import reachable


def largest_circle(edges: DataFrame) -> DataFrame:
    """(name, node): the names of the busiest name's component with that name; no rows
    where it is alone."""
    ends = edges.select(F.col("source").alias("name"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select(F.col("target").alias("name"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    busy = ends.groupBy("name").agg(F.sum("out").alias("out"), F.sum("in").alias("in")).select("name", (F.col("out") * F.col("in")).alias("ways"))
    pivot = busy.where("ways > 0").orderBy(F.desc("ways"), "name").limit(1).select("name")
    found = pivot.collect()
    if not found:
        return edges.sparkSession.createDataFrame([], "name string, node string")
    down = reachable(edges, pivot)
    up = reachable(edges.select(F.col("target").alias("source"), F.col("source").alias("target")), pivot)
    out = durable(down.join(up, "name", "left_semi").withColumn("node", F.lit(found[0].name)), "circle")
    discard(down, up)
    return out


def test_counts(g: CodeGraph) -> DataFrame:
    """(name, tests): for each name that a test is or reaches, the number of test symbols."""
    source = g.symbols.select(F.col("id").alias("source_symbol_id"), F.col("name").alias("source"))
    edges = durable(g.refs.where("kind = 'call'").join(source, "source_symbol_id").select("source", F.col("target_name").alias("target")).distinct(), "calls")
    circle = largest_circle(edges)

    def as_node(df: DataFrame, column: str) -> DataFrame:
        found = df.join(circle.select(F.col("name").alias(column), "node"), column, "left")
        return found.withColumn(column, F.coalesce("node", column)).drop("node")

    between = bucketed(as_node(as_node(edges, "source"), "target").where("source <> target").distinct(), "source", name="between")
    # numbers that are unique without an order over all tests: (task, place in it)
    tests = durable(g.symbols.where("is_test = 1 and name is not null").select("id", "name").withColumn("at", F.monotonically_increasing_id()), "tests")
    bit = F.expr("shiftleft(1L, cast(at % 64 as int))")
    first = as_node(tests, "name").select(F.col("name").alias("node"), F.expr("at div 64").alias("block"), bit.alias("bits"))
    new, found = durable_counted(first.groupBy("node", "block").agg(F.bit_or("bits").alias("bits")), "bits")
    known, stale = new, [new]
    while found:
        step = between.join(new.withColumnRenamed("node", "source"), "source").groupBy(F.col("target").alias("node"), "block").agg(F.bit_or("bits").alias("bits"))
        had = known.withColumnRenamed("bits", "had")
        gained = step.join(had, ["node", "block"], "left").select("node", "block", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("long")))).alias("bits"))
        new, found = durable_counted(gained.where("bits <> 0"), "bits")
        stale.append(new)
        if found:
            known = durable(known.unionByName(new).groupBy("node", "block").agg(F.bit_or("bits").alias("bits")), "bits")
            stale.append(known)
    each = known.groupBy("node").agg(F.sum(F.bit_count("bits")).cast("long").alias("tests"))
    lone = each.withColumnRenamed("node", "name").join(circle, "name", "left_anti")
    out = durable(lone.unionByName(circle.join(each, "node").select("name", "tests")), "counts")
    discard(edges, circle, between, tests, *stale)
    return out


test_counts.__test__ = False
