"""What each sample source must give, written out by hand for the SQL checks."""

from __future__ import annotations

SYMBOLS = {"name": "VARCHAR", "kind": "VARCHAR", "line_start": "BIGINT", "line_end": "BIGINT", "parent_name": "VARCHAR", "visibility": "VARCHAR", "signature": "VARCHAR", "is_test": "BOOLEAN"}
REFS = {"kind": "VARCHAR", "target_name": "VARCHAR", "target_qualifier": "VARCHAR", "line": "BIGINT", "source_symbol_name": "VARCHAR"}
IMPORTS = {"local_name": "VARCHAR", "full_path": "VARCHAR", "alias": "VARCHAR", "line": "BIGINT"}

EXTRACTED = {
    "rust": (
        [("Kettle", "struct", 1, 3, None, "pub", None, False), ("pour", "method", 5, 5, "Write", None, "fn (&mut self)", False), ("fills", "function", 8, 11, None, None, "fn ()", True)],
        [("trait_impl", "Write", "Kettle", 4, None), ("call", "drain", None, 5, "pour"), ("call", "assert_eq!", None, 9, "fills"), ("call", "open", "crate::tap", 9, "fills"), ("call", "cold", "Kettle", 10, "fills")],
        [("Write", "std::io::Write", None, 0)],
    ),
    "python": (
        [("Poster", "class", 2, 5, None, None, None, False), ("roll", "method", 3, 4, "Poster", None, "def (self, width)", False), ("_glue", "method", 5, 5, "Poster", "protected", "def (self)", False), ("test_poster", "function", 6, 7, None, None, "def ()", True)],
        [("inherit", "Page", None, 2, "Poster"), ("inherit", "Hanging", "wall.Hanging", 2, "Poster"), ("call", "trim", None, 4, "roll"), ("call", "stick", None, 5, "_glue"), ("call", "half", None, 5, "_glue"), ("call", "_glue", None, 7, "test_poster"), ("call", "Poster", None, 7, "test_poster")],
        [("decoder", "json.decoder", None, 0), ("Page", "press.core.Sheet", "Page", 1)],
    ),
    "php": (
        [("UserTest", "class", 2, 7, None, None, None, False), ("testSave", "method", 3, 6, "UserTest", "public", "function (int $id)", True), ("boot", "function", 8, 8, None, None, "function ()", False)],
        [("inherit", "Base", None, 2, "UserTest"), ("implement", "Runs", None, 2, "UserTest"), ("call", "find", "User", 4, "testSave"), ("call", "save", None, 5, "testSave"), ("call", "Item", "App\\Item", 5, "testSave"), ("call", "start", None, 8, "boot")],
        [("User", "App\\Models\\User", None, 1)],
    ),
    "typescript": (
        [("View", "class", 1, 3, None, None, None, False), ("cache", "method", 2, 2, "View", "private", "method ()", False), ("add", "function", 4, 4, None, "export", "function (a: number)", False), ("twice", "function", 5, 5, None, None, "const => (x)", False), ("__ts_test_6_1", "function", 6, 8, None, None, "test callback", True)],
        [("inherit", "Base", None, 1, "View"), ("implement", "Shown", None, 1, "View"), ("call", "fill", None, 2, "cache"), ("call", "wrap", None, 4, "add"), ("call", "add", None, 5, "twice"), ("call", "add", None, 5, "twice"), ("call", "it", None, 6, "__ts_test_6_1"), ("call", "render", None, 7, "__ts_test_6_1"), ("call", "View", None, 7, "__ts_test_6_1")],
        [("st", "react.useState", "st", 0), ("React", "react.default", None, 0)],
    ),
    "qml": (
        [("Page", "class", 2, 9, None, None, "Page", False), ("zoom", "property", 3, 3, "Page", None, "property real zoom", False), ("panned", "event", 4, 4, "Page", None, "signal panned(real dx, real dy)", False), ("Tick", "class", 5, 5, "Page", None, "component Tick", False), ("major", "property", 5, 5, "Tick", None, "property bool major", False), ("fit", "function", 6, 8, "Page", None, "function fit(w, h)", False)],
        [],
        [],
    ),
}


def values(types: dict[str, str], rows: list[tuple]) -> str:
    """A SELECT of these rows with their positions."""
    text = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    columns = ", ".join(["CAST(pos AS INTEGER) AS pos", *(f"CAST({c} AS {t}) AS {c}" for c, t in types.items())])
    listed = ", ".join(f"({', '.join([str(i), *map(text, r)])})" for i, r in enumerate(rows)) or f"({', '.join(['NULL'] * (1 + len(types)))})"
    return f"SELECT {columns} FROM (VALUES {listed}) v(pos, {', '.join(types)})" + ("" if rows else " WHERE false")


def _symbols(after: str) -> list[tuple[str, str, str, bool]]:
    return [(path, s[0], s[1], s[7]) for lang, path in PATHS.items() if path != after for s in EXTRACTED[lang][0]]


PATHS = {"rust": "src/lib.rs", "python": "src/app.py", "php": "src/User.php", "typescript": "src/view.tsx", "qml": "ui/Main.qml"}
#: Every sample's symbols, but those of src/app.py after its edit.
INGESTED = [*_symbols("src/app.py"), ("src/app.py", "only", "function", False)]
#: Every sample's symbols and those of the file that came later.
WATCHED = [*_symbols(""), ("src/late.py", "late", "function", False)]


def rows_sql(columns: str, rows: list[tuple]) -> str:
    """A SELECT of rows (file, name, kind, is_test)."""
    listed = ", ".join(f"('{f}', '{n}', '{k}', {int(t)})" for f, n, k, t in rows)
    return f"SELECT {columns} FROM (VALUES {listed}) v(file, name, kind, is_test)"
