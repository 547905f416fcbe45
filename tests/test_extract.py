"""Extractors on small sources of each language: one source a rule, all rows compared."""

import textwrap

import pytest

from graphloom.sources.extract import extract_files, extract_text, php, python, qml, rust, typescript
from graphloom.sources.extract.lexer import RUST, tokens
from graphloom.sources.extract.rust import scan_calls, scan_functions


def code(text):
    return textwrap.dedent(text).lstrip("\n")


def calls(e):
    return [r.target_name for r in e.refs if r.kind == "call"]


def qualified(e, *kinds):
    return [(r.target_name, r.target_qualifier) for r in e.refs if r.kind in (kinds or ("call",))]


def shapes(e):
    return [(s.name, s.kind, s.parent_name) for s in e.symbols]


def symbol(e, name):
    return next(s for s in e.symbols if s.name == name)


def test_rust_items_and_their_parents():
    e = rust.extract(code("""
        mod ledger;
        pub(crate) struct Row(u64);
        enum Side { Debit, Credit }
        pub trait Posted { fn at(&self) -> u64; fn late(&self) -> bool { self.at() > limit() } }
        impl Row {
            pub fn open(amount: u64,
                        side: Side) -> Row { Row(amount) }
        }
        impl<K: Ord> Index<K> { fn find(&self) {} }
    """))
    assert shapes(e)[-5:] == [("Side", "enum", None), ("Posted", "trait", None), ("late", "function", None), ("open", "method", "Row"), ("find", "method", None)]
    row, opened = symbol(e, "Row"), symbol(e, "open")
    assert (row.kind, row.line_start) == ("struct", 1) and row.visibility.startswith("pub")
    assert (opened.visibility, opened.line_start, opened.line_end) == ("pub", 5, 6)
    assert calls(e) == ["at", "limit", "Row"]


def test_rust_tests_are_marked_by_attributes_above():
    e = rust.extract("#[test]\nfn adds() {}\n\n#[cfg(test)]\n// a note between\nfn fixture() {}\nfn posting() {}\n")
    assert [s.name for s in e.symbols if s.is_test] == ["adds", "fixture"]


def test_rust_uses_and_trait_impls():
    e = rust.extract("use bank::Row;\nuse bank::fees::Rate as Fee;\nuse io::{Read, Write};\nimpl Posted for Row {}\nimpl Into<Row> for u64 {}\n")
    assert [(i.local_name, i.full_path, i.line) for i in e.imports] == [("Row", "bank::Row", 0), ("Fee", "bank::fees::Rate as Fee", 1), ("{Read, Write}", "io::{Read, Write}", 2)]
    assert qualified(e, "trait_impl") == [("Posted", "Row")]


def test_rust_calls_by_form():
    e = rust.extract(code("""
        fn settle(rows: Vec<Row>) {
            audit(1);
            rows.sort();
            bank::fees::charge(2);
            log!("{}", 3);
            rows.iter().map::<u8, _>(narrow);
            if let Some(x) = first(rows) { keep(x) } else { drop_all() }
        }
    """))
    got = qualified(e)
    for wanted in [("audit", None), ("sort", None), ("charge", "bank::fees"), ("log!", None), ("iter", None), ("map", None), ("first", None), ("keep", None), ("drop_all", None)]:
        assert got.count(wanted) == 1, wanted
    assert "Some" not in calls(e)
    assert {r.source_symbol_name for r in e.refs} == {"settle"} and [r.line for r in e.refs if r.target_name == "charge"] == [3]


def test_rust_calls_inside_macros():
    e = rust.extract("fn t() {\n    assert!(fees::total(&rows) > 0 && book.closed(day));\n}\n")
    assert sorted(qualified(e), key=str) == [("assert!", None), ("closed", None), ("total", "fees")]


def test_rust_functions_given_for_registration():
    e = rust.extract("fn setup(app: &mut App) {\n    app.add_systems(Tick, (close_day, fees::accrue));\n}\nfn close_day() {}\nmod fees { pub fn accrue() {} }\n")
    assert ("close_day", None) in qualified(e) and ("accrue", "fees") in qualified(e) and "add_systems" in calls(e)


def test_rust_scanners_skip_texts_and_comments():
    scan = lambda f, text: [(n, q) for n, q, _ in f(tokens(text, RUST))]
    assert scan(scan_calls, '(/* undo(1) */ redo(), "erase(", r"drop(2)", while(x), Self::of(3))') == [("redo", None), ("of", "Self")]
    assert scan(scan_functions, "(Tick, (close_day, fees::accrue.after(open_day())))") == [("close_day", None), ("accrue", "fees")]


def test_python_definitions():
    e = python.extract(code("""
        class Till(Drawer, hw.Device, metaclass=Meta):
            def __init__(self, key: str = "):"):
                self.key = cut(key)
            @property
            def _coins(self): return self.box.count()
            def __shake(self):
                def inner(): ring()
        async def test_till(a, *rest): ...
    """))
    assert shapes(e) == [("Till", "class", None), ("__init__", "method", "Till"), ("_coins", "method", "Till"), ("__shake", "method", "Till"), ("inner", "method", "Till"), ("test_till", "function", None)]
    assert [s.visibility for s in e.symbols][1:4] == ["protected", "protected", "private"]
    assert symbol(e, "__init__").signature == 'def (self, key: str = "):")' and symbol(e, "test_till").signature == "def (a, *rest)"
    assert [s.name for s in e.symbols if s.is_test] == ["test_till"]
    assert qualified(e, "inherit") == [("Drawer", None), ("Device", "hw.Device")]
    assert [(r.target_name, r.source_symbol_name) for r in e.refs if r.kind == "call"] == [("cut", "__init__"), ("count", "_coins"), ("ring", "inner")]


def test_python_imports():
    e = python.extract("import hw, hw.coins\nimport paper as roll\nfrom bank import Row\nfrom bank.fees import rate as fee\nfrom . import drawer\n")
    assert [(i.local_name, i.full_path, i.alias, i.line) for i in e.imports] == [("hw", "hw", None, 0), ("coins", "hw.coins", None, 0), ("Row", "bank.Row", None, 2), ("fee", "bank.fees.rate", "fee", 3), ("drawer", "drawer", None, 4)]


def test_python_goes_on_after_broken_lines():
    e = python.extract("def count():\n    return add(1)\n\nclass Broken(:\n    y = = 1\n\ndef pay():\n    give()\n")
    assert {"count", "pay"} <= {s.name for s in e.symbols} and {"add", "give"} <= set(calls(e))


def test_php_types_and_members():
    e = php.extract(code(r"""
        <?php
        use Shop\Cart\Basket;
        use Shop\Http\Form as Input;
        abstract class CartTest extends Fixture implements Countable, Shop\Named {
            use Prices;
            public static function testSum(float $vat) { return Basket::sum($vat); }
            abstract protected function rows();
        }
        interface Named { public function name(); }
        trait Prices { private function net() {} }
        function pay() { round_up(5); $cart->close(); new Shop\Bill(); new Slip; Shop\ring(); $cart?->bag(); while (true) {} }
        ?><i>shown()</i>
    """))
    assert [(i.local_name, i.full_path, i.alias) for i in e.imports] == [("Basket", "Shop\\Cart\\Basket", None), ("Input", "Shop\\Http\\Form", "Input")]
    assert [(s.name, s.kind) for s in e.symbols if s.parent_name is None] == [("CartTest", "class"), ("Named", "interface"), ("Prices", "trait"), ("pay", "function")]
    t = symbol(e, "testSum")
    assert (t.kind, t.parent_name, t.visibility, t.is_test, t.signature) == ("method", "CartTest", "public", True, "function (float $vat)")
    assert symbol(e, "net").visibility == "private" and not symbol(e, "pay").is_test
    assert [(r.kind, r.target_name, r.source_symbol_name) for r in e.refs if r.kind != "call"] == [("inherit", "Fixture", "CartTest"), ("implement", "Countable", "CartTest"), ("implement", "Named", "CartTest")]
    assert qualified(e) == [("sum", "Basket"), ("round_up", None), ("close", None), ("Bill", "Shop\\Bill"), ("Slip", None), ("ring", "Shop\\ring"), ("bag", None)]


def test_typescript_types_and_members():
    e = typescript.extract(code("""
        abstract class Panel { protected abstract draw(): void; }
        interface Sized { width(): number; }
        enum Tone { Dark, Light }
        export class Chart extends Panel<Row> implements Sized, ns.Shown {
            private scale(): void {}
            public axis = axisOf();
            static async load(urls: string[]) { await Promise.race(urls.map(u => pull(u))); }
        }
        export function plot(at: Point): { x: number } { return mark(at); }
    """))
    assert [(s.name, s.kind, s.visibility) for s in e.symbols if s.parent_name is None and s.kind != "method"] == [("Panel", "class", "abstract"), ("Sized", "interface", None), ("Tone", "enum", None), ("Chart", "class", None), ("plot", "function", "export")]
    assert (symbol(e, "scale").kind, symbol(e, "scale").parent_name, symbol(e, "scale").visibility) == ("method", "Chart", "private")
    assert sorted(calls(e)) == ["axisOf", "map", "mark", "pull", "race"]
    assert [(r.kind, r.target_name) for r in e.refs if r.kind != "call"][:2] == [("inherit", "Panel"), ("implement", "Sized")]


def test_typescript_functions_in_variables():
    e = typescript.extract("const shade = (t: Tone) => { return t; };\nconst onDrag = function (e: Drag) { return snap(e); };\nconst size = 3;\nconst fit = v => crop(v.trim());\nconst chart = new viz.Chart();\nfunction testZoom() {}\n")
    assert [(s.name, s.signature) for s in e.symbols][:2] == [("shade", "const => (t: Tone)"), ("onDrag", "const function (e: Drag)")]
    assert [s.name for s in e.symbols] == ["shade", "onDrag", "fit", "testZoom"]
    assert [s.name for s in e.symbols if s.is_test] == ["testZoom"]
    assert sorted(calls(e)) == ["Chart", "crop", "snap", "trim"]


def test_typescript_callbacks_of_tests():
    e = typescript.extract("test.skip('zooms', async () => {\n    wheel(<Axis size={3} />);\n});\nit('pans', function () {\n    drag(`x${by(2)}`);\n});\n")
    tests = [s.name for s in e.symbols if s.is_test]
    assert tests == ["__ts_test_0_1", "__ts_test_3_2"]
    inside = {(r.target_name, r.source_symbol_name) for r in e.refs}
    assert {("wheel", tests[0]), ("Axis", tests[0]), ("drag", tests[1]), ("by", tests[1])} <= inside


def test_typescript_imports():
    e = typescript.extract("import viz, { scale as by, type Tone } from 'viz';\nimport * as all from './all';\nimport './style.css';\nconst later = import('./later');\n")
    assert [(i.local_name, i.full_path, i.alias) for i in e.imports] == [("by", "viz.scale", "by"), ("Tone", "viz.Tone", None), ("viz", "viz.default", None)]


def test_qml_declarations_and_nesting():
    e = qml.extract(code("""
        import QtQuick.Layouts
        Column {
            property int gap: { return 4 }
            signal chosen(string code)
            component Line: Row { property color ink; function fold() {} }
            model: Stack { Timer { function onTick() {} } function push() {} }
            function total(rows) {
                function one(r) { return r.price }
                return rows.map(one)
            }
        }
    """))
    assert shapes(e) == [("Column", "class", None), ("gap", "property", "Column"), ("chosen", "event", "Column"), ("Line", "class", "Column"), ("ink", "property", "Line"), ("fold", "function", "Line"), ("Stack", "class", "Column"), ("Timer", "class", "Stack"), ("onTick", "function", "Timer"), ("push", "function", "Stack"), ("total", "function", "Column"), ("one", "function", "total")]
    assert [(s.line_start, s.line_end) for s in e.symbols if s.name in ("Column", "total")] == [(2, 11), (7, 10)]
    assert not e.refs and not e.imports


@pytest.mark.parametrize("lang", ["php", "python", "qml", "rust", "typescript"])
@pytest.mark.parametrize("text", ["", "{{{{", "}}}} ))", "'", '"""', "/* open", "fn class def function (", "<?php class", "`${`${", "\x00﻿", "class A extends", "use ;", "import {", "a<b<c<", "match x { Some(", "r#\"", "@", "#["])
def test_broken_sources_give_something(lang, text):
    extract_text(lang, text)


def test_extract_files_reports_errors(spark):
    df = spark.createDataFrame([("a.py", "python", "def f(): g()"), ("b.xx", "none", "x")], "path string, lang string, content string")
    rows = {r.path: r for r in extract_files(df).collect()}
    assert [s.name for s in rows["a.py"].symbols] == ["f"] and rows["a.py"].refs[0].source_symbol_name == "f"
    assert rows["a.py"].error is None and "KeyError" in rows["b.xx"].error


def test_words_that_are_calls_where_they_follow_a_dot():
    assert calls(rust.extract("fn f() { a.union(&b); union(1); }")) == ["union", "union"]
    assert calls(typescript.extract("get(1); set(2); of(3);\nfor (const x of (ys)) {}\n")) == ["get", "set", "of"]


def test_python_rows_and_class_visibility():
    e = python.extract("from pkg import (\n    one,\n    two as deux,\n)\nclass _Hidden:\n    pass\n")
    assert [(i.local_name, i.line) for i in e.imports] == [("one", 1), ("deux", 2)]
    assert symbol(e, "_Hidden").visibility is None


def test_signatures_of_methods_callbacks_and_qml():
    e = typescript.extract("class Till {\n  testing(a) { open(); }\n}\nit('adds', () => {});\n")
    assert (symbol(e, "testing").signature, symbol(e, "testing").is_test) == ("method (a)", False)
    assert [(s.name, s.signature) for s in e.symbols if s.is_test] == [("__ts_test_3_1", "test callback")]
    e = qml.extract("Item {\n  property int size: 3\n  function grow(by) {\n  }\n}\n")
    assert [s.signature for s in e.symbols] == ["Item", "property int size", "function grow(by)"]
