"""Incremental ingest: metadata, then content hash, then extraction."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import link, resolve
from graphloom.plans.catalog import CodeGraph, empty_graph
from graphloom.plans.tables import durable
from graphloom.sources import walk
from graphloom.sources.extract import extract_files
from graphloom.sources.store import Busy, Store

ATTEMPTS = 3
REFRESH_S = 3600
LAST_REFRESH = "last_refresh"
SHIFT = 20  # a file's rows have ids file << SHIFT | position


@dataclass
class Stats:
    indexed: int = 0
    skipped: int = 0
    pruned: int = 0
    errors: int = 0

    @property
    def changed_graph(self) -> bool:
        return bool(self.indexed or self.pruned)

    def __str__(self) -> str:
        return f"Indexed: {self.indexed}, Skipped: {self.skipped}, Pruned: {self.pruned}, Errors: {self.errors}"


def classify(found: DataFrame, files: DataFrame) -> DataFrame:
    """found with id, old_hash and same (size and time as stored, so not read)."""
    old = files.select("path", "id", F.col("hash").alias("old_hash"), F.col("size").alias("_s"), F.col("modified_ns").alias("_m"))
    same = F.coalesce((F.col("size") == F.col("_s")) & (F.col("modified_ns") == F.col("_m")), F.lit(False))
    return found.join(old, "path", "left").withColumn("same", same).drop("_s", "_m")


def prepare(old: CodeGraph, found: DataFrame) -> DataFrame:
    """found with its action: skip, touch (content as before), parse or error."""
    placed = classify(found, old.files)
    read = walk.read_contents(placed.where("not same"))
    action = F.when(F.col("error").isNotNull(), "error").when(F.col("hash") == F.col("old_hash"), "touch").otherwise("parse")
    rest = placed.where("same").withColumns({"content": F.lit(None).cast("string"), "hash": F.col("old_hash"), "error": F.lit(None).cast("string"), "action": F.lit("skip")})
    return read.withColumn("action", action).unionByName(rest)


def tables_of(parsed: DataFrame) -> CodeGraph:
    """Tables of files (id, path, lang, content, hash, size, modified_ns)."""
    found = durable(parsed.join(extract_files(parsed), "path").drop("error"), "extract")
    key = lambda pos: F.shiftleft(F.col("id"), SHIFT).bitwiseOR(F.col(pos).cast("long"))
    rows = lambda column: found.select("id", F.posexplode(column).alias("pos", "x")).select(F.col("id").alias("file_id"), "pos", key("pos").alias("rid"), "x.*")
    symbols = rows("symbols").withColumnRenamed("rid", "id")
    up = link.parents(symbols.where("parent_name is not null").select("id", "file_id", "pos", "parent_name"), symbols.select("id", "file_id", "name", "pos"))
    refs = link.sources(rows("refs").withColumnRenamed("rid", "id"), symbols.select("id", "file_id", "name", "pos"))
    imports = rows("imports").withColumnRenamed("rid", "id")
    now = F.lit(int(time.time())).cast("long")
    return CodeGraph(
        found.select("id", "path", "hash", "lang", now.alias("indexed_at"), "size", "modified_ns"),
        symbols.join(up, "id", "left").select("id", "file_id", "name", "kind", "line_start", "line_end", "parent_id", "visibility", "signature", F.col("is_test").cast("int").alias("is_test")),
        refs.select("id", F.col("file_id").alias("source_file_id"), "source_symbol_id", F.lit(None).cast("long").alias("target_symbol_id"), "kind", "target_name", "target_qualifier", "line", F.lit(False).alias("resolved")),
        imports.select("id", "file_id", "local_name", "full_path", "alias", "line"),
        found.where(F.exists("symbols", lambda s: s.is_test)).select("path", "content"),
    )


def numbered(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """Files that are new get the ids after the largest stored one, by path."""
    most = files.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_most"))
    fresh = parsed.where("id is null").select("path", F.row_number().over(Window.orderBy("path")).cast("long").alias("_n")).withColumn("_one", F.lit(1))
    fresh = fresh.join(most.withColumn("_one", F.lit(1)), "_one").select("path", (F.col("_n") + F.col("_most")).alias("_new"))
    return parsed.join(fresh, "path", "left").withColumn("id", F.coalesce("id", "_new")).drop("_new")


def merge(old: CodeGraph, new: CodeGraph, gone: DataFrame, touched: DataFrame) -> CodeGraph:
    """old without the files of new and gone (id, path), with new, and with the
    sizes and times of touched (id, size, modified_ns) files."""
    out = new.files.select("id").unionByName(gone.select("id"))
    paths = new.files.select("path").unionByName(gone.select("path"))
    stay = lambda df, key: df.join(out.withColumnRenamed("id", key), key, "left_anti")
    times = touched.select("id", F.col("size").alias("_s"), F.col("modified_ns").alias("_m"))
    files = stay(old.files, "id").join(times, "id", "left").withColumns({"size": F.coalesce("_s", "size"), "modified_ns": F.coalesce("_m", "modified_ns")}).drop("_s", "_m")
    return CodeGraph(
        files.unionByName(new.files),
        stay(old.symbols, "file_id").unionByName(new.symbols),
        stay(old.refs, "source_file_id").unionByName(new.refs),
        stay(old.imports, "file_id").unionByName(new.imports),
        old.sources.join(paths, "path", "left_anti").unionByName(new.sources),
    )


def _current(prepared: DataFrame) -> bool:
    """Whether every prepared file is as it was when it was read."""
    return all(walk.state(r.path) == (r.size, r.modified_ns) for r in prepared.where("action in ('parse', 'touch')").select("path", "size", "modified_ns").toLocalIterator())


def index_paths(store: Store, paths: Sequence[str], full: bool = False, prune: bool = True) -> Stats:
    """Brings the store up to date for these files, and resolves anew on change.

    Files are read before the store is touched; if one changed meanwhile the
    reading starts over, at most ATTEMPTS times.
    """
    spark = store.spark
    old = empty_graph(spark) if full else store.graph()
    for _ in range(ATTEMPTS):
        prepared = durable(prepare(old, walk.states(spark, list(paths))), "prepared")
        if _current(prepared):
            break
    else:
        raise RuntimeError(f"files kept changing during {ATTEMPTS} attempts")
    counts = {r.action: r["count"] for r in prepared.groupBy("action").count().collect()}
    parsed = durable(numbered(prepared.where("action = 'parse'").drop("action", "error", "same", "old_hash"), old.files), "parsed")
    stored = old.files.select("id", "path")
    gone = durable(stored.join(walk.existing(stored), "id", "left_anti") if prune else stored.limit(0), "gone")
    stats = Stats(counts.get("parse", 0), counts.get("skip", 0) + counts.get("touch", 0), gone.count(), counts.get("error", 0))
    if stats.changed_graph or counts.get("touch") or full:
        graph = merge(old, tables_of(parsed), gone, prepared.where("action = 'touch'"))
        if stats.changed_graph:  # with no change, the old resolution still holds
            graph = resolve.apply(graph)
        store.commit(graph)
    return stats


def index(store: Store, root: str, full: bool = False) -> Stats:
    """Index a directory (or one file)."""
    with store.lock():
        return index_paths(store, list(walk.walk(root)), full)


def refresh_due(store: Store, now: int) -> bool:
    last = store.meta().get(LAST_REFRESH)
    return last is None or not last.isdigit() or max(0, now - int(last)) >= REFRESH_S


def refresh(store: Store, root: str, now: int | None = None) -> Stats | None:
    """Index if the last check is REFRESH_S old; a busy writer is left alone."""
    now = int(time.time()) if now is None else now
    if not refresh_due(store, now):
        return None
    try:
        with store.lock(wait=False):
            if not refresh_due(store, now):
                return None
            stats = index_paths(store, list(walk.walk(root)))
            store.set_meta(LAST_REFRESH, str(now))
            return stats
    except Busy:
        return None
