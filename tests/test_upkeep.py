"""Stored layout, coverage counts, deep chains, versions, streams, digests, slices, owners."""

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from graphloom.operators import coverage, digest, hierarchy, link, owners, references, slices, symbols
from graphloom.plans import tables, traverse
from graphloom.plans.catalog import empty_graph
from graphloom.plans.layout import kept, stored
from graphloom.sources import versions
from graphloom.streaming import changes
from tests.graphs import Builder


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def many(spark, n=200):
    b = Builder(spark)
    for k in range(n):
        b.symbol(f"m{k % 9}.rs", f"name{k % 150}", "function", k)
    for k in range(n):
        b.ref(f"m{k % 9}.rs", "call", 1 + k % n, f"name{k * 7 % 160}", k)
    return b.graph()


def test_stored_graph_prunes_lookups_and_joins_names_in_place(spark):
    plain = many(spark)
    g = stored(plain, 8)
    found = symbols.find_symbols(g, "name7")
    # a file a task: the number of tasks is that of the files that are read
    spark.conf.set("spark.sql.files.openCostInBytes", spark.conf.get("spark.sql.files.maxPartitionBytes"))
    files = lambda df: df.rdd.getNumPartitions()
    assert files(g.symbols.where("name = 'name7'")) == 1 and files(g.symbols) == 8
    assert files(g.refs.where("target_name = 'name7'")) == 1 and files(g.refs) == 8
    assert files(g.imports.where("local_name = 'x'")) <= 1
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, symbols.find_symbols(plain, "name7").collect()))
    assert sorted(map(str, references.find_references(g, "name7").collect())) == sorted(map(str, references.find_references(plain, "name7").collect()))
    # names against names, both sides too long to broadcast
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        called = g.refs.where("kind = 'call'").select(F.col("target_name").alias("name")).distinct()
        assert "Exchange" not in plan(g.symbols.join(called, "name", "left_anti"))
        assert "Exchange" not in plan(g.symbols.groupBy("name").count().join(g.refs, F.col("name") == F.col("target_name")))
        assert not re.search(r"Exchange hashpartitioning\((target_)?name#", plan(symbols.find_dead_code(g)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(tuple, symbols.find_dead_code(g).collect())) == sorted(map(tuple, symbols.find_dead_code(kept(plain)).collect()))
    tables.discard(g.files, g.symbols, g.refs, g.imports)


def test_tables_are_deleted_by_their_owner(spark):
    df = tables.durable(spark.range(5).toDF("x"), "mine")
    path = tables._PATHS[df]
    assert path in tables._WRITTEN
    tables.discard(df, df)
    assert path not in tables._WRITTEN
    tables.discard(spark.range(1))  # not one of ours
    left = tables.durable(spark.range(2).toDF("x"), "left")
    assert tables._PATHS[left] in tables._WRITTEN and tables.sweep(spark) >= 1 and not tables._WRITTEN


def plain_depths(enter, leave, seed):
    seen, level = {seed: 0}, [seed]
    while level:
        after = sorted({n for name in level for a in enter.get(name, ()) for n in leave.get(a, ())} - set(seen))
        for n in after:
            seen[n] = seen[level[0]] + 1
        level = after
    return seen


def as_tables(spark, edges):
    """Edges as steps over a place of their own, named by the source."""
    enter = {a: [f"at-{a}"] for a, _ in edges}
    leave = {}
    for a, b in edges:
        leave.setdefault(f"at-{a}", []).append(b)
    rows = lambda d: [(k, v) for k, vs in d.items() for v in vs]
    return enter, leave, spark.createDataFrame(rows(enter), "name string, at string"), spark.createDataFrame(rows(leave), "at string, next string")


def test_a_chain_of_a_thousand_levels_takes_few_rounds(spark):
    edges = [(f"c{k:04}", f"c{k + 1:04}") for k in range(1000)]
    *_, enter, leave = as_tables(spark, edges)
    found, rounds = traverse.least_depths(enter, leave, "c0000")
    assert {r.name: r.depth for r in found.collect()} == {f"c{k:04}": k for k in range(1001)}
    assert rounds <= 12


def test_least_depths_with_shortcuts_and_circles(spark):
    # a long chain with a fork, a way back, a second chain and a late shortcut into the first
    edges = [(f"a{k}", f"a{k + 1}") for k in range(60)] + [("a5", "b0"), ("a60", "a2")]
    edges += [(f"b{k}", f"b{k + 1}") for k in range(30)] + [("b3", "a55"), ("b30", "b30"), ("b10", "a20")]
    enter, leave, e, v = as_tables(spark, edges)
    found, _ = traverse.least_depths(e, v, "a0")
    assert {r.name: r.depth for r in found.collect()} == plain_depths(enter, leave, "a0")


def test_deep_inheritance(spark):
    b = Builder(spark)
    for k in range(40):
        b.symbol(f"t{k}.rs", f"T{k}", "struct", 1)
        if k:
            b.ref(f"t{k}.rs", "inherit", None, f"T{k - 1}", 1)
    g = b.graph()
    up = {r.name: r.depth for r in hierarchy.find_hierarchy(g, "T39", "ancestors").collect()}
    down = {r.name: r.depth for r in hierarchy.find_hierarchy(g, "T0", "descendants").collect()}
    assert up == {f"T{k}": 38 - k for k in range(39)} and down == {f"T{k}": k - 1 for k in range(1, 40)}


def test_test_counts(spark):
    b = Builder(spark)
    ids = {n: b.symbol("a.rs", n, "function", k) for k, n in enumerate("abcdefg")}
    for k in range(70):  # more than a word of bits
        ids[f"t{k}"] = b.symbol("t.rs", f"t{k}", "function", k, is_test=1)
        b.ref("t.rs", "call", ids[f"t{k}"], "a" if k % 2 else "d", k)
    b.symbol("u.rs", "t0", "function", 1, is_test=1)  # two tests of a name
    for s, t in (("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "g")):
        b.ref("a.rs", "call", ids[s], t, 1)
    got = {r.name: r.tests for r in coverage.test_counts(b.graph()).collect()}
    assert {n: got.get(n) for n in "abcdefg"} == {"a": 35, "b": 35, "c": 35, "d": 71, "e": 71, "f": None, "g": None}
    assert got["t0"] == 2 and got["t1"] == 1 and len(got) == 75
    assert coverage.test_counts(empty_graph(spark)).count() == 0


FILES = "key long, size long, modified long, content string"


def test_versions(spark):
    before = spark.createDataFrame([(1, 5, 1, "same"), (2, 5, 1, "touched"), (3, 5, 1, "old"), (4, 5, 1, "gone"), (5, None, None, "unknown"), (6, 0, 1, None), (None, 1, 1, "x")], FILES)
    after = spark.createDataFrame([(1, 5, 1, "never read"), (2, 5, 2, "touched"), (3, 6, 1, "new"), (5, None, None, "unknown"), (6, 0, 2, ""), (7, 1, 1, "first"), (None, 1, 1, "x")], FILES)
    kept_rows = versions.snapshot(before)
    actions = lambda df: {r.key: r.action for r in df.collect()}
    assert actions(versions.changes(kept_rows, after)) == {1: "skip", 2: "touch", 3: "parse", 4: "gone", 5: "touch", 6: "touch", 7: "parse"}
    assert actions(versions.changes(kept_rows, after, full=True)) == {1: "parse", 2: "parse", 3: "parse", 4: "gone", 5: "parse", 6: "parse", 7: "parse"}
    assert actions(versions.changes(kept_rows.limit(0), after.limit(0))) == {}
    # unchanged metadata: content is only read where they differ
    assert versions.changes(kept_rows, after).where("action = 'skip'").select("hash").first() == kept_rows.where("key = 1").select("hash").first()


def test_a_change_stream_goes_on_after_a_restart(spark, tmp_path):
    start = datetime(2024, 1, 1)
    schema = "user long, at timestamp, id long, text string"
    shape = lambda df: df.select(F.col("user").alias("key"), "at", "id", F.xxhash64("text").alias("hash"))
    source, state, target = (str(tmp_path / n) for n in ("in", "state", "out"))
    parts = [[(1, 0, "a"), (1, 1, "a"), (2, 1, "x"), (None, 1, "x")], [(1, 2, "b"), (2, 2, "x")], [(1, 3, "b"), (1, 4, "a"), (3, 4, None), (3, 5, None)]]
    seen = 0
    for part in parts:
        rows = [(u, start + timedelta(minutes=m), seen + k, t) for k, (u, m, t) in enumerate(part)]
        seen += len(part)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        changes.follow(spark, source, spark.createDataFrame([], schema).schema, shape, state, target)
    changes.follow(spark, source, spark.createDataFrame([], schema).schema, shape, state, target)  # nothing new
    got = {r.key: (r.seen, r.changed) for r in changes.latest(spark, target).collect()}
    assert got == {1: (5, 3), 2: (2, 1), 3: (2, 1)}


def test_digests(spark):
    b = Builder(spark)
    box = b.symbol("/r/a/x.rs", "Box", "class", 0)
    for k in range(5):
        b.symbol("/r/a/x.rs", f"m{k}", "method", 9 - k, box, is_test=int(k == 0))
    b.symbol("/r/a/b/y.rs", "free", "function", 0)
    b.symbol("/r/a/b/y.rs", "Bare", "trait", 3)
    b.file("/r/a/b/empty.rs")
    b.file("/top.rs")
    g = b.graph()
    rows = {r.directory: tuple(r)[1:] for r in digest.directories(g).collect()}
    assert rows == {"/r": (3, 8, 2, 6, 1), "/r/a": (3, 8, 2, 6, 1), "/r/a/b": (2, 2, 1, 1, 0)}
    found = sorted(digest.members(g, 2).collect(), key=lambda r: (r.type, r.rank))
    assert [(r.type, r.members, r.rank, r.name) for r in found] == [("Bare", 0, None, None), ("Box", 5, 1, "m4"), ("Box", 5, 2, "m3")]


@pytest.mark.parametrize("block", [1, 3, 64])
def test_slices(spark, block):
    texts = {"a": "\n".join(f"line {k}" for k in range(10)), "b": "", "c": None, "d": "one\r\n\ntwo\n"}
    spans = [(1, "a", 0, 0), (2, "a", 2, 7), (3, "a", 8, 99), (4, "a", 10, 12), (5, "a", 5, 4), (6, "b", 0, 3), (7, "c", 0, 0), (8, "d", 0, 3), (9, "zz", 0, 0), (10, "a", -3, 1), (11, "d", 3, 3)]
    got = {r.span_id: r.source for r in slices.slices(spark.createDataFrame(list(texts.items()), "key string, text string"), spark.createDataFrame(spans, "span_id long, key string, line_start long, line_end long"), block).collect()}
    want = {}
    for i, key, low, high in spans:
        lines = texts[key].split("\n")[max(low, 0) : high + 1] if texts.get(key) is not None and high >= 0 else []
        want[i] = "\n".join(lines) if lines else None
    assert got == want


def test_owners(spark):
    projects = [("one", "/src/n1"), ("deep", "/src/n1/lib"), ("twin", "/src/n1"), ("none", None), ("ten", "/src/n10")]
    paths = ["/src/n1/a", "/src/n12", "/src/n10/a", "/src/n1/lib/x", "/sr", None, "/src/n1/lib/x"]
    table = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "id long, path string")
    registered = spark.createDataFrame(projects, "name string, root string")
    got = {r.id: r.project for r in owners.owners(table, registered).collect()}
    assert got == {0: "one", 1: "one", 2: "ten", 3: "deep", 4: None, 5: None, 6: "deep"}
    assert {r.project for r in owners.owners(table, registered.limit(0)).collect()} == {None}
    everything = registered.unionByName(spark.createDataFrame([("all", "")], "name string, root string"))
    assert {r.id: r.project for r in owners.owners(table, everything).collect()}[4] == "all"


def test_sources_are_linked_to_the_first_symbol_of_the_name(spark):
    rows = spark.createDataFrame([(1, 7, "f"), (2, 7, "g"), (3, 8, "f"), (4, 7, None)], "id long, file_id long, source_symbol_name string")
    syms = spark.createDataFrame([(10, 7, "f", 5), (11, 7, "f", 2), (12, 9, "f", 0)], "id long, file_id long, name string, pos long")
    assert {r.id: r.source_symbol_id for r in link.sources(rows, syms).collect()} == {1: 11, 2: None, 3: None, 4: None}
