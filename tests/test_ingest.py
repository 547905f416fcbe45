"""Walks, snapshots, incremental ingest, watching, tools and the command line."""

import json
import os
import time

import pytest

from graphloom import cli, outline, projects, render
from graphloom.api import CodeTools
from graphloom.operators import calls, symbols
from graphloom.sources import ingest, walk
from graphloom.sources.store import Busy, Store
from graphloom.streaming import watch

LIB = "pub fn helper() {}\npub fn caller() {\n    helper();\n}\n"
TEST = "#[test]\nfn checks() {\n    crate::caller();\n}\n"


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "p"
    (root / "src").mkdir(parents=True)
    (root / "src/lib.rs").write_text(LIB)
    return root


@pytest.fixture
def store(spark, tree):
    return Store(spark, tree / projects.STORE_NAME)


def test_walk_skips_ignored_and_hidden(tree):
    for p, text in {"pkg/__init__.py": "", "_x.py": "", ".hidden.py": "", "build/out.js": "", "keep/a.log.py": "", "keep/b.py": "", "notes.txt": "", ".gitignore": "build/\n*.log.py\n/keep/*.py\n!keep/b.py\n# c\n"}.items():
        (tree / p).parent.mkdir(exist_ok=True)
        (tree / p).write_text(text)
    got = [os.path.relpath(p, tree) for p in walk.walk(tree)]
    assert got == ["_x.py", "keep/b.py", "pkg/__init__.py", "src/lib.rs"]
    assert list(walk.walk(tree / "src/lib.rs")) == [str(tree / "src/lib.rs")]


def test_incremental_index(spark, tree, store):
    s = ingest.index(store, str(tree))
    assert (s.indexed, s.skipped, s.errors) == (1, 0, 0)
    g = store.graph()
    assert sorted(r.name for r in g.symbols.collect()) == ["caller", "helper"]
    (r,) = g.refs.collect()
    assert r.resolved and r.target_symbol_id == g.symbols.where("name = 'helper'").first().id
    assert r.source_symbol_id == g.symbols.where("name = 'caller'").first().id
    assert ingest.index(store, str(tree)).skipped == 1
    ids = {r.name: r.id for r in g.symbols.collect()}
    os.utime(tree / "src/lib.rs", ns=(1, 1))
    s = ingest.index(store, str(tree))
    assert (s.indexed, s.skipped) == (0, 1) and store.graph().files.first().modified_ns == 1
    assert ingest.index(store, str(tree), full=True).indexed == 1
    assert {r.name: r.id for r in store.graph().symbols.collect()} == ids
    (tree / "src/lib.rs").write_text("fn other() {}\n")
    (tree / "src/t.rs").write_text(TEST)
    (tree / "src/bad.py").write_bytes(b"\xff\xfe")
    s = ingest.index(store, str(tree))
    assert (s.indexed, s.errors) == (2, 1)
    g = store.graph()
    assert sorted(r.name for r in g.symbols.collect()) == ["checks", "other"]
    assert [r.content for r in g.sources.collect()] == [TEST]
    (tree / "src/lib.rs").unlink()
    (tree / "src/bad.py").unlink()
    s = ingest.index(store, str(tree))
    assert (s.indexed, s.skipped, s.pruned, s.errors) == (0, 1, 1, 0)
    assert [r.name for r in store.graph().symbols.collect()] == ["checks"]


def test_readers_keep_their_snapshot(spark, tree, store):
    ingest.index(store, str(tree))
    old = store.graph()
    (tree / "src/lib.rs").write_text("fn other() {}\n")
    ingest.index(store, str(tree))
    assert old.symbols.count() == 2 and store.graph().symbols.count() == 1
    store.reset()
    assert store.graph().symbols.count() == 0


def test_changes_while_reading_are_retried(tree, store, monkeypatch):
    monkeypatch.setattr(ingest, "_current", lambda prepared: False)
    with pytest.raises(RuntimeError):
        ingest.index(store, str(tree))
    assert store.current() is None


def test_refresh_gate(tree, store):
    assert ingest.refresh_due(store, 5)
    assert ingest.refresh(store, str(tree), now=10_000).indexed == 1
    assert ingest.refresh(store, str(tree), now=13_599) is None
    assert ingest.refresh_due(store, 13_600)
    with store.lock():
        assert ingest.refresh(store, str(tree), now=99_999) is None
        with pytest.raises(Busy), store.lock(wait=False):
            pass
    assert store.meta()[ingest.LAST_REFRESH] == "10000"


def test_watch_batches(tree, store):
    lib = str(tree / "src/lib.rs")
    assert watch.changed_files([lib, lib, str(tree / "no.rs"), str(tree)]) == [lib]
    assert watch.handle_batch(store, [lib]).indexed == 1
    s = watch.handle_batch(store, [lib, lib])
    assert (s.indexed, s.skipped) == (0, 1)
    assert watch.handle_batch(store, [str(tree / "gone.rs"), "x.txt"]) == ingest.Stats()


def test_watch_stream(spark, tree, store, tmp_path):
    query = watch.watch(spark, store, str(tree), str(tmp_path / "ck"), "0 seconds")
    try:
        query.processAllAvailable()
        time.sleep(0.02)
        (tree / "src/new.rs").write_text("fn fresh() {}\n")
        end = time.time() + 60
        while time.time() < end and store.graph().symbols.where("name = 'fresh'").isEmpty():
            time.sleep(0.5)
    finally:
        query.stop()
    assert sorted(r.name for r in store.graph().symbols.collect()) == ["caller", "fresh", "helper"]


def test_tools(spark, tree):
    (tree / "src/t.rs").write_text(TEST)
    (tree / "src/s.py").write_text("import lib.helper\nclass A(B):\n    def m(self): pass\n")
    t = CodeTools(spark, tree)
    said = t.index()
    assert said.startswith("Indexed: 3, Skipped: 0, Pruned: 0, Errors: 0\nResolution: ")
    lib = tree / "src/lib.rs"
    assert t.symbol("helper") == f"pub function helper {lib}:0-0 | fn ()"
    assert t.callers("helper") == f"1 callers found:\n  caller in {lib}:2"
    assert t.callees("caller") == f"1 callees found:\n  helper in {lib}:2"
    assert t.references("helper") == f"  [call] caller in {lib}:2 [resolved]"
    assert t.tested_by("helper").startswith("1 test(s) found:\n  function checks in ")
    assert t.untested() == f"1 untested functions/methods:\n  method m in {tree / 'src/s.py'}:2"
    assert t.dead_code("lib.rs") == "No dead code found."
    assert t.hierarchy("A") == f"B (inherit) in {tree / 'src/s.py'} | ancestor"
    assert "→ function helper in" in t.resolve_import("helper") and t.imported_by("lib").startswith("1 importer(s)")
    assert t.list("struct") == "No symbols found." and t.status() == "Files: 3, Symbols: 5, References: 3"


def test_command_line(spark, tree, capsys, monkeypatch, tmp_path):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "config"))
    run = lambda *a: cli.run(cli.parser().parse_args(a), spark)
    where = ("--path", str(tree))
    assert run("index", str(tree)).startswith("Indexed: 1")
    assert run("status", *where) == "Files: 1, Symbols: 2, References: 1"
    (found,) = json.loads(run("symbol", "helper", *where))
    assert list(found) == ["id", "file_path", "name", "kind", "line_start", "line_end", "visibility", "signature"]
    assert json.loads(run("callers", "nobody", *where)) == [] and run("callers", "nobody", *where) == "[]"
    assert "pub function helper fn ()  L1-1" in run("callers", "helper", "--outline", *where)
    assert "\n" not in run("list", *where) and json.loads(run("dead-code", "--exclude", "caller", *where)) == []
    assert "fn helper" in run("outline", str(tree), "--show", "helper")
    assert run("outline", str(tree), "--digest").startswith("## src\n### lib.rs")
    assert run("project", "list") == "No projects registered."
    run("project", "add", "p", str(tree))
    assert run("project", "list") == f"p: {tree}"
    assert run("project", "remove", "p").startswith("Removed") and run("project", "remove", "p").startswith("No project")


def test_projects(tmp_path):
    config = tmp_path / "c.toml"
    for p in ("a", "a/b", "g/.git", "g/sub", "g/sub/.graphloom", "n/.graphloom", "n/m"):
        (tmp_path / p).mkdir(parents=True, exist_ok=True)
    projects.add("outer", tmp_path / "a", config)
    projects.add("inner \"x\"", tmp_path / "a/b", config)
    assert projects.registered_for(tmp_path / "a/b", config) == 'inner "x"'
    assert projects.registered_for(tmp_path, config) is None
    dir_ = lambda cwd, explicit=None: projects.resolve_dir(explicit, tmp_path / cwd, config)
    assert dir_("a") == tmp_path / "a" and dir_("g", str(tmp_path / "n")) == tmp_path / "n"
    assert dir_("n/m") == tmp_path / "n" and dir_("g/sub") == tmp_path / "g/sub"
    projects.add("all", tmp_path, config)
    assert dir_("g") == tmp_path / "g"  # a project outside the git root does not count
    assert projects.remove("all", config) and not projects.remove("all", config)


def test_empty_texts():
    assert render.symbols([]) == "No symbols found." and render.calls([], "callers") == "No callers found."
    assert render.references([]) == "No references found." and render.hierarchy([]) == "No inheritance found."
    assert render.resolved_imports([]) == "No imports found." and render.tested_by([]) == "No tests found for this symbol."
    assert render.untested([]) == "All functions/methods are tested." and render.imported_by([]) == "No importers found."
    assert render.dead_code([]) == "No dead code found."


def test_outline_options():
    text = "/// Doc.\n#[derive(Debug)]\npub struct A;\nimpl A {\n    fn _hid() {}\n    pub fn open() {}\n}\n"
    o = outline.parse("/p/a.rs", text, "rust")
    full = outline.render(o)
    assert full.splitlines()[1:4] == ["/// Doc.", "#[derive(Debug)]", "pub struct A  L3-3"]
    bare = outline.render(o, privates=False, docs=False, attrs=False, lines=False)
    assert "_hid" not in bare and "Doc" not in bare and "derive" not in bare and "L3" not in bare
    assert calls and symbols
