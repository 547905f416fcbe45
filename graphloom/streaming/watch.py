"""Watching a source tree with Structured Streaming.

The source is a data source whose offset is the largest modification time seen;
each micro-batch names the files changed since, and foreachBatch brings the
store up to date.  Reprocessing is harmless: equal contents are skipped.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from graphloom.sources import ingest, walk
from graphloom.sources.store import Store

SCHEMA = "path string, modified_ns long"


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, root: str) -> None:
        self.root = root

    def initialOffset(self) -> dict:
        return {"modified_ns": -1}

    def _since(self, start: int, end: int | None) -> list[tuple[str, int]]:
        found = [(p, s[1]) for p in walk.walk(self.root) if (s := walk.state(p))]
        return sorted((p, m) for p, m in found if m >= start and (end is None or m <= end))

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = self._since(start["modified_ns"], None)
        most = max((m for _, m in rows), default=start["modified_ns"])
        if most == start["modified_ns"]:  # nothing newer: the batch stays empty
            return iter(()), start
        return iter(rows), {"modified_ns": most}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._since(start["modified_ns"], end["modified_ns"]))


class SourceTree(DataSource):
    """spark.readStream.format("source_tree").option("path", root)"""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: ANN001
        return _Reader(self.options["path"])


def changed_files(paths: Sequence[str]) -> list[str]:
    """Regular files of a known language, each once, in order of appearance."""
    return [p for p in dict.fromkeys(paths) if os.path.isfile(p) and walk.language(p)]


def handle_batch(store: Store, paths: Sequence[str]) -> ingest.Stats:
    """One batch of changed files; deletions are left to the next index."""
    found = changed_files(paths)
    if not found:
        return ingest.Stats()
    with store.lock():
        return ingest.index_paths(store, found, prune=False)


def watch(spark: SparkSession, store: Store, root: str, checkpoint: str, interval: str = "1 second", once: bool = False) -> StreamingQuery:
    """Index and resolve, then follow changes until the query is stopped."""
    ingest.index(store, root)
    spark.dataSource.register(SourceTree)
    changes = spark.readStream.format("source_tree").option("path", root).load()

    def each(batch: DataFrame, _: int) -> None:
        # names of changed files only; contents are read by tasks
        handle_batch(store, [r.path for r in batch.select("path").toLocalIterator()])

    writer = changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
