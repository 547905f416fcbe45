"""Test coverage: which tests reach a symbol, and what no test reaches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.substring import checked
from graphloom.functions.text import split_qualified
from graphloom.operators.calls import find_callers
from graphloom.operators.symbols import ORDER, callables
from graphloom.plans.catalog import CodeGraph, stored_symbols
from graphloom.plans.traverse import reachable


def find_tested_by(g: CodeGraph, name: str, file: str | None = None, depth: int = 10) -> DataFrame:
    """Tests among the transitive callers, then tests of the name itself (so one
    that calls itself is there twice)."""
    tests = g.located_symbols().where("is_test = 1")
    callers = find_callers(g, name, file, depth).select(F.col("symbol_name").alias("name")).distinct()
    own = tests.where(F.col("name") == split_qualified(name)[0])
    return stored_symbols(tests.join(callers, "name", "left_semi")).unionByName(stored_symbols(own))


def test_reachable(g: CodeGraph) -> DataFrame:
    """Names that a test is or calls, over any number of calls."""
    source = g.symbols.select(F.col("id").alias("source_symbol_id"), F.col("name").alias("source"))
    edges = g.refs.where("kind = 'call'").join(source, "source_symbol_id").select("source", F.col("target_name").alias("target"))
    return reachable(edges, g.symbols.where("is_test = 1").select("name"))


test_reachable.__test__ = False


def untested_candidates(g: CodeGraph, path: str | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    handler = (F.col("lang") == "qml") & F.col("name").rlike("^on[A-Z]")
    return callables(g, path, exclude).where((F.col("is_test") == 0) & ~handler)


def covered_by_text(g: CodeGraph, candidates: DataFrame) -> DataFrame:
    """(file_path, name) of .qml candidates that the text of one test file names,
    together with their path or an ending of it of two parts or more.

    Test files are looked up by the file names they hold: what stands between a
    slash and the next `.qml`.  A path without a slash is looked up by the character
    before its `.qml`.
    """
    slashed = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    tests = g.located_symbols().where("is_test = 1").select(F.col("file_path").alias("path")).distinct()
    texts = g.sources.join(tests, "path", "left_semi").select("path", slashed(F.col("content")).alias("content"))
    qml = candidates.where(F.endswith("file_path", F.lit(".qml"))).select("file_path", "name").distinct()
    qml = qml.withColumn("norm", slashed(F.col("file_path")))
    # every accepted ending holds `/file.qml`; a file name may hold `.qml` before its end
    named = F.regexp_extract("norm", r"(/[^/]*?\.qml)[^/]*$", 1)
    qml = qml.withColumn("_file", F.when(named != "", named).otherwise(F.regexp_extract("norm", r"(?s)(.?)\.qml$", 1)))
    found = lambda pattern: F.regexp_extract_all("content", F.lit(pattern), F.lit(1))
    names = F.array_distinct(F.concat(found(r"(/[^/]*?\.qml)"), found(r"(?s)(?<=(.))\.qml"), F.array(F.lit(""))))
    mentioned = texts.where(F.contains("content", F.lit(".qml"))).select("path", F.explode(names).alias("_file"))
    pairs = qml.join(mentioned, "_file").select(F.col("path").alias("id"), "file_path", "name", "norm")
    ending = lambda parts, k: F.array_join(F.slice(parts, k, F.size(parts)), "/")

    def said(x: Column, text: Column) -> Column:
        parts = F.split(x["norm"], "/")
        ends = F.when(F.size(parts) > 2, F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda k: ending(parts, k))).otherwise(F.array().cast("array<string>"))
        return F.contains(text, x["name"]) & (F.contains(text, x["norm"]) | F.exists(ends, lambda e: F.contains(text, e)))

    found = checked(pairs.distinct(), texts.select(F.col("path").alias("id"), F.col("content").alias("text")), said)
    return found.select("file_path", "name").distinct()


def find_untested(g: CodeGraph, path: str | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    found = untested_candidates(g, path, exclude).join(test_reachable(g), "name", "left_anti")
    if g.sources is not None:
        found = found.join(covered_by_text(g, found), ["file_path", "name"], "left_anti")
    return stored_symbols(found).orderBy(*ORDER)
