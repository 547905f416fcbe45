"""Small sources of each language, for extraction and ingest queries."""

from __future__ import annotations

import uuid
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.tables import durable, shared_dir
from graphloom.sources.extract import extract_files

SOURCES = {
    "src/lib.rs": ("rust", "use std::io::Write;\npub struct Kettle {\n    litres: u8,\n}\nimpl Write for Kettle {\n    fn pour(&mut self) -> u8 { drain(self.litres) }\n}\n#[test]\nfn fills() {\n    assert_eq!(crate::tap::open(2), 7);\n    let k = Kettle::cold();\n}\n"),
    "src/app.py": ("python", "import json.decoder\nfrom press.core import Sheet as Page\nclass Poster(Page, wall.Hanging):\n    def roll(self, width):\n        self.width = trim(width)\n    def _glue(self): stick(self.width.half())\ndef test_poster():\n    Poster(3)._glue()\n"),
    "src/User.php": ("php", "<?php\nuse App\\Models\\User;\nclass UserTest extends Base implements Runs {\n    public function testSave(int $id) {\n        User::find($id);\n        $this->save(new App\\Item());\n    }\n}\nfunction boot() { start(); }\n"),
    "src/view.tsx": ("typescript", "import React, { useState as st } from 'react';\nexport class View extends Base implements Shown {\n    private cache(): void { fill(); }\n}\nexport function add(a: number) { return wrap(a); }\nconst twice = (x) => add(add(x));\nit('renders', () => {\n    render(<View />);\n});\n"),
    "ui/Main.qml": ("qml", "import QtQuick.Controls\nPage {\n  property real zoom: 1.5\n  signal panned(real dx, real dy)\n  component Tick: Item { property bool major }\n  function fit(w, h) {\n    zoom = w / h\n  }\n}\n"),
}


def extracted(spark: SparkSession, lang: str) -> DataFrame:
    rows = [(p, kind, text) for p, (kind, text) in SOURCES.items() if kind == lang]
    return extract_files(spark.createDataFrame(rows, "path string, lang string, content string"))


def flat(found: DataFrame, column: str) -> DataFrame:
    """One row for each entry of an array, with its position."""
    return found.select(F.posexplode(column).alias("pos", "x")).select(F.col("pos").cast("int").alias("pos"), "x.*")


def tree(spark: SparkSession) -> str:
    """The samples as files of a new folder that all executors see."""
    root = Path(urlparse(shared_dir(spark)).path) / f"tree-{uuid.uuid4().hex}"
    for p, (_, text) in SOURCES.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(text)
    return str(root)


def ingested(spark: SparkSession) -> DataFrame:
    """Symbols of the samples after indexing twice and an edit in between."""
    from graphloom.sources import ingest
    from graphloom.sources.store import Store

    root = tree(spark)
    store = Store(spark, Path(root) / ".graphloom")
    ingest.index(store, root)
    (Path(root) / "src/app.py").write_text("def only():\n    pass\n")
    ingest.index(store, root)
    g = store.graph()
    return g.located_symbols().select(F.regexp_extract("file_path", r"([^/]*/[^/]*)$", 1).alias("file"), "name", "kind", "is_test")


def watched(spark: SparkSession) -> DataFrame:
    """Symbols after a watch stream saw a new file."""
    from graphloom.sources.store import Store
    from graphloom.streaming.watch import watch

    root = tree(spark)
    store = Store(spark, Path(root) / ".graphloom")
    (Path(root) / "src/late.py").write_text("def late():\n    pass\n")
    query = watch(spark, store, root, f"{root}/.checkpoint", "0 seconds")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return durable(store.graph().symbols.select("name", "kind"), "watched")
