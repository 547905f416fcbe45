"""Graph queries on small graphs, and properties that must hold on any."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import substring
from graphloom.functions.substring import holding, needle_pieces, pieces
from graphloom.functions.text import ascii_like, last_segment, split_qualified
from graphloom.operators import calls, hierarchy, imports, link, references, resolve, symbols, testing
from graphloom.plans import catalogue, layout
from graphloom.plans.catalog import empty_graph
from graphloom.plans.tables import durable
from graphloom.sources import bridge
from tests.graphs import Builder

SMALL = "/root/testdata/sf0.001"


def col(df, name):
    return [r[name] for r in df.collect()]


@pytest.fixture(scope="module")
def derived(spark):
    return bridge.graph(spark, SMALL)


def test_names_are_split_at_the_last_mark():
    assert split_qualified("a::b::c") == ("c", "a::b")
    assert split_qualified("A\\B.c\\D") == ("D", "A\\B.c")
    assert split_qualified("m.C.f") == ("f", "m.C")
    assert split_qualified("a.b::c") == ("c", "a.b")
    assert split_qualified("plain") == ("plain", None)


def test_like_folds_ascii_only(spark):
    df = spark.createDataFrame([("Éa/B\\c_d%",)], "s string")
    for part, want in (("éA", False), ("a/b", True), ("B\\C", True), ("c_D", True), ("cxd", False), ("c%d", True), ("\\", True), ("", True), ("_a", True)):
        assert df.select(ascii_like(df.s, part)).first()[0] is want, part
    for text, want in (("a\\b.c:d/e", "e"), ("x", "x"), ("a/", "")):
        d = spark.createDataFrame([(text,)], "s string")
        assert d.select(last_segment(d.s, "\\.:/")).first()[0] == want


def test_callers(spark):
    # oven <- bake <- open_shop, and a call outside of any symbol
    b = Builder(spark)
    oven = b.symbol("oven.rs", "heat", "function", 4)
    bake, shop = b.symbol("bakery.rs", "bake", "function", 10), b.symbol("shop.rs", "open_shop", "function", 3)
    b.symbol("shop.rs", "heat", "function", 40)
    b.ref("bakery.rs", "call", bake, "heat", 12, resolved=oven)
    b.ref("shop.rs", "call", shop, "bake", 5)
    b.ref("shop.rs", "call", None, "bake", 1)
    g = b.graph()
    assert sorted(col(calls.find_callers(g, "heat", depth=2), "symbol_name")) == ["<top-level>", "bake", "open_shop"]
    (row,) = calls.find_callers(g, "heat", "oven.rs", 1).collect()
    assert (row.symbol_name, row.file_path, row.line) == ("bake", "/repo/src/bakery.rs", 12)
    # a call resolved elsewhere is none of this file's, and unknown files have none
    assert calls.find_callers(g, "heat", "shop.rs", 1).count() == 0
    assert calls.find_callers(g, "heat", "nowhere.rs", 1).count() == 0
    assert calls.find_callers(g, "heat", depth=0).count() == 0
    assert calls.find_callers(g, "x::heat").count() == 0
    assert len(col(calls.find_callers(g, "heat", depth=9), "symbol_name")) == 3


def test_callees(spark):
    b = Builder(spark)
    press = b.symbol("press.rs", "Press", "struct", 1)
    roll, ink = b.symbol("press.rs", "roll", "method", 3, press), b.symbol("press.rs", "ink", "function", 20)
    b.symbol("press.rs", "roll", "function", 30)
    for line in (4, 5):
        b.ref("press.rs", "call", roll, "ink", line)
    b.ref("press.rs", "call", ink, "dry", 21)
    b.ref("press.rs", "inherit", ink, "Paper", 22)
    rows = calls.find_callees(b.graph(), "Press.roll", "press.rs", 2).collect()
    assert sorted((r.line, r.symbol_name) for r in rows) == [(4, "ink"), (5, "ink"), (21, "dry")]
    assert {(r.kind, r.file_path) for r in rows} == {("call", "/repo/src/press.rs")}


def test_symbols_and_dead_code(spark):
    b = Builder(spark)
    kiln = b.symbol("src/kiln.rs", "Kiln", "struct", 1)
    b.symbol("src/kiln.rs", "fire", "method", 2, kiln)
    b.symbol("bench/kiln.rs", "fire", "function", 2)
    g = b.graph()
    assert symbols.find_symbols(g, "Kiln.fire", "method", "src").count() == 1
    assert symbols.find_symbols(g, "fire").count() == 2 and symbols.find_symbols(g, "fire", "enum").count() == 0
    b = Builder(spark)
    ids = {name: b.symbol("pots.rs", name, "function", line) for line, name in enumerate(("glaze", "mix", "main", "spare", "kept"))}
    b.ref("pots.rs", "call", ids["mix"], "glaze", 1)
    b.ref("pots.rs", "inherit", ids["mix"], "spare", 1)
    g = b.graph()
    assert symbols.list_symbols(g, "function", "src").count() == 5
    assert col(symbols.find_dead_code(g, "src", ["kept"]), "name") == ["mix", "spare"]


def test_references(spark):
    b = Builder(spark)
    boat = b.symbol("boat.rs", "Boat", "struct", 0)
    sail, trip = b.symbol("boat.rs", "sail", "method", 1, boat), b.symbol("trip.rs", "trip", "function", 7)
    b.ref("trip.rs", "call", trip, "sail", 8, "Boat", resolved=sail)
    b.ref("trip.rs", "call", trip, "sail", 9, "Kite")
    b.ref("harbour.rs", "call", None, "moor", 2)
    g = b.graph()
    (r,) = references.find_references(g, "Boat.sail", "call").collect()
    assert (r.source_symbol, r.target_file, r.target_symbol, r.resolved) == ("trip", "/repo/src/boat.rs", "sail", True)
    (r,) = references.find_references(g, "moor").collect()
    assert r.source_symbol is None and r.target_file is None and not r.resolved
    assert references.find_references(g, "sail").count() == 2 and references.find_references(g, "sail", "import").count() == 0


def test_references_broadcast_nothing_that_grows_with_the_tables(spark, monkeypatch):
    # files of 10 MB can hold millions of rows: by their size Spark must not choose
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plans = []
    for module in (layout, resolve, substring):
        monkeypatch.setattr(module, "durable", lambda df, name: plans.append(plan(df)) or durable(df, name))
    plans.append(plan(catalogue.QUERIES["references_all"](spark, SMALL.replace("0.001", "0.01"))))
    assert len(plans) == 18
    # only the distinct pieces of three characters may be
    assert set(re.findall(r"BroadcastHashJoin \[(\w+)#", "".join(plans))) <= {"piece"}
    assert "MERGE" not in bridge.CTES


def test_hierarchy(spark):
    # Oak and Elm are trees, a Sapling is an Oak, and a Plant is made by a Tree: a circle
    b = Builder(spark)
    for name in ("Plant", "Tree", "Oak", "Elm", "Sapling"):
        b.symbol(f"{name.lower()}.rs", name, "class", 1)
    for child, parent in (("tree", "Plant"), ("oak", "Tree"), ("elm", "Tree"), ("sapling", "Oak"), ("sapling", "Plant"), ("plant", "Tree")):
        b.ref(f"{child}.rs", "inherit", None, parent, 1)
    g = b.graph()
    rows = lambda df: sorted((r.name, r.depth) for r in df.collect())
    assert rows(hierarchy.find_hierarchy(g, "Sapling", "ancestors")) == [("Oak", 0), ("Plant", 0), ("Plant", 2), ("Tree", 1), ("Tree", 1)]
    assert rows(hierarchy.find_hierarchy(g, "Tree", "descendants")) == [("Elm", 0), ("Oak", 0), ("Plant", 0), ("Sapling", 1), ("Sapling", 1), ("Tree", 1)]
    assert hierarchy.find_hierarchy(g, "Tree", "sideways").count() == 0
    assert hierarchy.find_hierarchy(g, "Stone").count() == 0
    b = Builder(spark)
    b.symbol("gate.rs", "Lockable", "trait", 1)
    b.symbol("gate.rs", "Gate", "struct", 9)
    b.ref("gate.rs", "trait_impl", None, "Lockable", 10)
    both = {(r.name, r.kind, r.relation) for r in hierarchy.find_hierarchy(b.graph(), "Lockable").collect()}
    # a reference belongs to all symbols of its file
    assert both == {("Lockable", "trait_impl", "ancestor"), ("Lockable", "trait_impl", "descendant"), ("Gate", "trait_impl", "descendant")}


def test_imports(spark):
    b = Builder(spark)
    b.symbol("lib/maps/atlas.rs", "Atlas", "struct", 3)
    b.symbol("lib/stars/atlas.rs", "Atlas", "trait", 4)
    b.symbol("lib/stars/sky.rs", "Sky", "struct", 5)
    b.imported("bin/a.rs", "Chart", "lib::stars::Atlas", "Chart", 1)
    b.imported("bin/a.rs", "Atlas", "elsewhere::Atlas", None, 2)
    b.imported("bin/b.rs", "Sky", "lib::moved", None, 3)
    b.imported("bin/b.rs", "lost", "lib::lost", None, 4)
    g = b.graph()
    found = {(r.source_file, r.line): (r.target_file, r.target_kind) for r in imports.resolve_import(g, "a", "bin").collect()}
    # all parts in one path; else the first by path
    assert found["/repo/bin/a.rs", 1] == ("/repo/lib/stars/atlas.rs", "trait")
    assert found["/repo/bin/a.rs", 2] == ("/repo/lib/maps/atlas.rs", "struct")
    (r,) = imports.resolve_import(g, "moved").collect()
    assert (r.target_symbol, r.target_file) == ("Sky", "/repo/lib/stars/sky.rs")
    assert col(imports.resolve_import(g, "lost"), "target_file") == [None]
    assert imports.find_imported_by(g, "LIB::", "bin/b").count() == 2 and imports.find_imported_by(g, "zzz").count() == 0


@pytest.mark.parametrize(
    ("path", "said", "covered"),
    [
        ("/shop/till/Receipt.qml", "open /shop/till/Receipt.qml then printTotal", True),
        ("/shop/till/Receipt.qml", "x till\\Receipt.qml printTotal()", True),
        ("/shop/till/Receipt.qml", "till/Receipt.qml only", False),
        ("/shop/till/Receipt.qml", "Receipt.qml printTotal", False),
        ("/shop/till/Receipt.qml", "till/Receipt.js printTotal", False),
        ("/shop/ui/caf\u00e9 au lait.qml", "'ui/caf\u00e9 au lait.qml' printTotal", True),
        ("/shop/ui/old.qml.qml", "ui/a.qml ui/old.qml.qml printTotal", True),
        ("/shop/ui/old.qml.qml", "ui/old.qml printTotal", False),
        ("/shop/ui/.qml", "ui/.qml printTotal", True),
    ],
)
def test_texts_of_tests_cover_qml_functions(spark, path, said, covered):
    b = Builder(spark)
    b.symbol(path, "printTotal", "function", 2, lang="qml")
    b.symbol("/shop/spec/till.ts", "checksTill", "function", 0, is_test=1, lang="typescript")
    b.source("/shop/spec/till.ts", said)
    g = b.graph()
    got = col(testing.covered_by_text(g, testing.untested_candidates(g)), "name")
    assert got == ["printTotal"] * covered
    assert col(testing.find_untested(g), "name") == ["printTotal"] * (not covered)


def test_lines_meet_symbols_of_any_length(spark):
    spans = [(i, 1 + i % 2, f"s{i}", a, a + n) for i, (a, n) in enumerate([(0, 0), (15, 1), (10, 15), (10, 16), (0, 255), (200, 256), (0, 70000), (65530, 20), (5, 1 << 40), (3, 3), (3, 3), (9, -1)])]
    lines = [(i, 1 + i % 2, line) for i, line in enumerate([0, 0, 15, 16, 26, 25, 255, 256, 456, 457, 65536, 65550, 70000, 70001, 1 << 41, 4, 4])]
    symbols = spark.createDataFrame(spans, "id long, file_id long, name string, line_start long, line_end long")
    got = {r.ref_id: r.id for r in link.enclosing(symbols, spark.createDataFrame(lines, "ref_id long, file_id long, line long")).collect()}
    wanted = {}
    for ref_id, file_id, line in lines:
        around = [(e - s, i) for i, f, _, s, e in spans if f == file_id and s <= line <= e]
        if around:
            wanted[ref_id] = min(around)[1]
    assert got == wanted


@given(st.text("ab:/.\u00e9", max_size=8), st.text("ab:/.\u00e9", max_size=8), st.text("ab:/.\u00e9", max_size=8))
@settings(max_examples=10, deadline=None)
def test_a_text_has_the_pieces_of_all_it_holds(spark, before, held, after):
    (r,) = spark.createDataFrame([(before + held + after, held)], "whole string, held string").select(pieces(F.col("whole")).alias("all"), needle_pieces(F.col("held")).alias("some")).collect()
    assert r.some and set(r.some) <= set(r.all)


def test_many_substrings_in_many_texts(spark, monkeypatch):
    from graphloom.functions import substring

    texts = [(1, "/a/bcd/efg.rs"), (2, ""), (3, None), (4, "bcd" * 4000 + "x"), (5, "caf\u00e9%_"), (6, "bcd")]
    needles = ["bcd", "", None, "x", "f\u00e9%", "bcd", "efg.rs/", "cdb", "%_", "a/bcd/efg"]
    want = {(n, i) for n in needles for i, t in texts if n is not None and t is not None and n in t}
    t, n = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(x,) for x in needles], "needle string")
    rows = [tuple(r) for r in holding(t, n).collect()]
    assert set(rows) == want and len(rows) == len(want)
    # with a stored index, and a text that is copied for a few pairs only
    monkeypatch.setattr(substring, "CHUNK", 2)
    assert {tuple(r) for r in holding(t, n, substring.index(t.where("text is not null"))).collect()} == want


def test_tests_and_reachability(spark):
    b = Builder(spark)
    t, a, c = b.symbol("t.rs", "check", "function", 1, is_test=1), b.symbol("a.rs", "a", "function", 1), b.symbol("a.rs", "c", "function", 5)
    b.symbol("a.rs", "lonely", "function", 9)
    b.ref("t.rs", "call", t, "a", 2)
    b.ref("a.rs", "call", a, "c", 2)
    b.ref("a.rs", "call", c, "a", 6)
    b.ref("t.rs", "call", t, "check", 2)
    g = b.graph()
    assert col(testing.find_tested_by(g, "c"), "name") == ["check"]
    assert col(testing.find_tested_by(g, "check"), "name") == ["check", "check"]
    assert sorted(col(testing.test_reachable(g), "name")) == ["a", "c", "check"]
    assert col(testing.find_untested(g), "name") == ["lonely"]


CASES = [
    # the rule, the qualifier, candidates (path, parent), the file of the call, the one that is meant
    ("d", "knots", [("rope/knots.rs", None), ("rope/loops.rs", None)], "demo/tie.rs", 0),
    ("d", "rope::loops", [("rope/knots.rs", None), ("rope/loops.rs", None)], "demo/tie.rs", 1),
    ("d", "Crane", [("yard/lift.rs", "Crane"), ("yard/dig.rs", "Shovel")], "demo/tie.rs", 0),
    ("c", "Shovel", [("yard/lift.rs", "Crane"), ("yard/dig.rs", "Shovel")], "yard/lift.rs", 0),
    ("ambiguous", None, [("yard/lift.rs", None), ("yard/dig.rs", None)], "demo/tie.rs", None),
    ("ambiguous", "::", [("yard/lift.rs", None), ("yard/dig.rs", None)], "demo/tie.rs", None),
    ("ambiguous", "yard", [("yard/lift.rs", None), ("yard/dig.rs", None)], "demo/tie.rs", None),
    ("b", "other", [("yard/lift.rs", None)], "demo/tie.rs", 0),
]


@pytest.mark.parametrize(("rule", "qualifier", "candidates", "source", "wanted"), CASES)
def test_resolution_rules(spark, rule, qualifier, candidates, source, wanted):
    b = Builder(spark)
    ids = [b.symbol(p, "pull", "function", 9, b.symbol(p, parent, "struct", 1) if parent else None) for p, parent in candidates]
    b.ref(source, "call", None, "pull", 3, qualifier)
    g = b.graph()
    rows = resolve.resolve(g)
    assert [(r.target_symbol_id, r.rule) for r in rows.collect()] == [(None if wanted is None else ids[wanted], rule)]
    if qualifier in ("knots", "yard"):
        assert resolve.resolve(g, resolve.of_name(g, "pull")).collect() == rows.collect()
        s = resolve.stats(rows).first()
        assert (s.total, s.resolved, s.ambiguous, s.unresolved) == (1, int(wanted is not None), int(wanted is None), 0)


def imports_and_refs(spark):
    b = Builder(spark)
    lamp = b.symbol("shop/lamp.rs", "Lamp", "struct", 1)
    b.imported("home.rs", "Light", "old::Torch", line=1)
    b.imported("home.rs", "Light", "shop::Lamp", line=2)
    b.ref("home.rs", "call", None, "Light", 3)
    near = b.symbol("east/wing.rs", "hall", "function", 1)
    b.symbol("west/wing.rs", "hall", "function", 1)
    b.imported("home.rs", "hall", "east/wing", line=3)
    b.ref("home.rs", "call", None, "hall", 4)
    b.ref("home.rs", "call", None, "nothing", 5)
    return b, lamp, near


def test_resolution_by_alias_and_import_path(spark):
    b, lamp, near = imports_and_refs(spark)
    g = b.graph()
    rows = {r.target_name: (r.target_symbol_id, r.rule) for r in resolve.resolve(g).collect()}
    assert rows == {"Light": (lamp, "a"), "hall": (near, "e"), "nothing": (None, "unresolved")}
    # what can mean Lamp has another name
    assert [(r.target_name, r.target_symbol_id) for r in resolve.resolve(g, resolve.of_name(g, "Lamp")).collect()] == [("Light", lamp)]


def test_a_change_resolves_only_what_it_touches(spark):
    b, lamp, near = imports_and_refs(spark)
    gone = len(b._refs)
    b.ref("home.rs", "call", None, "soon", 6)
    g = b.graph()
    before = resolve.resolve(g)
    symbols, refs, imported = g.symbols, g.refs, g.imports
    second = symbols.where("id = 1").withColumn("id", F.lit(99).cast("long"))  # another Lamp, so the alias means none
    new = refs.where(f"id = {gone + 1}").withColumn("id", F.lit(70).cast("long")).withColumn("target_name", F.lit("hall"))
    after = resolve.replace(g, symbols=symbols.unionByName(second), refs=refs.where(f"id <> {gone}").unionByName(new))
    none = resolve.Change(symbols.limit(0), symbols.limit(0), imported.limit(0), imported.limit(0), refs.limit(0), refs.limit(0))
    change = resolve.replace(none, symbols_added=second, refs_added=new, refs_removed=refs.where(f"id = {gone}"))
    rows = {r.id: (r.target_name, r.target_symbol_id, r.rule, r.anew) for r in resolve.update(before, after, change).collect()}
    assert rows == {1: ("Light", None, "unresolved", True), 2: ("hall", near, "e", False), gone + 1: ("soon", None, "unresolved", False), 70: ("hall", near, "e", True)}
    whole = {r.id: (r.target_symbol_id, r.rule) for r in resolve.resolve(after).collect()}
    assert {i: r[1:3] for i, r in rows.items()} == whole
    # nothing changed, nothing is resolved anew; an import that goes away is enough
    assert {r.anew for r in resolve.update(before, g, none).collect()} == {False}
    without = resolve.replace(g, imports=imported.where("local_name <> 'hall'"))
    rows = {r.target_name: (r.rule, r.anew) for r in resolve.update(before, without, resolve.replace(none, imports_removed=imported.where("local_name = 'hall'"))).collect()}
    assert rows["hall"] == ("ambiguous", True) and not rows["Light"][1]


def test_languages(spark):
    paths = {"a.rs": "rust", "/x.y/b.tsx": "typescript", "c.QML": None, "d": None, "/p.py/e": None, "f.jsx": "typescript", ".py": "python"}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path: r.lang for r in df.select("path", link.language_of(df.path).alias("lang")).collect()} == paths


def test_empty_graph(spark):
    g = empty_graph(spark)
    for df in (symbols.find_dead_code(g), symbols.list_symbols(g), calls.find_callers(g, "x", depth=5), calls.find_callees(g, "x"), references.find_references(g, "x"), hierarchy.find_hierarchy(g, "x"), imports.resolve_import(g, "x"), testing.find_untested(g), testing.find_tested_by(g, "x"), resolve.resolve(g)):
        assert df.count() == 0
    assert symbols.status(g).first().asDict() == {"files": 0, "symbols": 0, "references": 0}


def test_properties(derived):
    rows = lambda df: {tuple(r) for r in df.collect()}
    by_depth = [rows(calls.find_callers(derived, "main", depth=d)) for d in (1, 2, 3, 5)]
    assert all(a <= b for a, b in zip(by_depth, by_depth[1:]))
    called = {r.target_name for r in derived.refs.where("kind = 'call'").collect()}
    dead = set(col(symbols.find_dead_code(derived), "name"))
    assert len(dead) == 42 and not dead & called
    reached = set(col(testing.test_reachable(derived), "name"))
    assert len(reached) == 195 and not reached & set(col(testing.find_untested(derived), "name"))


def test_walks_beyond_the_unrolled_depth_agree(derived, monkeypatch):
    from graphloom.plans import traverse

    lazy = sorted(map(tuple, calls.find_callers(derived, "main", depth=3).collect()))
    monkeypatch.setattr(traverse, "UNROLLED", 0)
    assert sorted(map(tuple, calls.find_callers(derived, "main", depth=3).collect())) == lazy
