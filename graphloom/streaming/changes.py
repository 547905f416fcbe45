"""Changes of keyed content as a stream: a key counts as changed if its content differs
from the last one seen for it, whatever number of batches and restarts lie between."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from graphloom.plans.tables import new_path

STATE = "last_hash long, last_at long, seen long, changed long"
OUTPUT = "key long, last_at long, seen long, changed long"


def keyed_changes(rows: DataFrame, late: str = "1 hour", idle: int = 10 * 365 * 86_400_000) -> DataFrame:
    """(key, last_at, seen, changed) of a stream of rows (key, at, id, hash).

    In each batch a key's rows are ordered by (at, id) and compared with the one before,
    the first with the state.  A row that is later than `late` behind the newest one is
    dropped by the watermark; a key that is idle for `idle` milliseconds leaves the state.
    The state is four numbers a key.  Update mode: a row for each key of a batch.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, at, seen, changed = state.get if state.exists else (None, None, 0, 0)
        own = pd.concat(batches).sort_values(["at", "id"])
        for h in own["hash"]:
            changed += last is None or int(h) != last
            last = int(h)
        newest = int(own["at"].iloc[-1].value // 1000)
        at, seen = newest if at is None else max(at, newest), seen + len(own)
        state.update((last, at, seen, changed))
        state.setTimeoutTimestamp(max(at // 1000, state.getCurrentWatermarkMs() + 1) + idle)
        yield pd.DataFrame({"key": [key[0]], "last_at": [at], "seen": [seen], "changed": [changed]})

    known = rows.where("key is not null and at is not null").withWatermark("at", late)
    return known.groupBy("key").applyInPandasWithState(step, OUTPUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def follow(spark: SparkSession, source: str, schema, shape, state: str, target: str, late: str = "1 hour") -> None:
    """Work off what has arrived in a folder of Parquet files, then stop.  Called again
    with the same `state` (checkpoint) it goes on where it stopped; `shape` makes
    (key, at, id, hash) of the source's rows.  Each batch is one folder of `target`,
    written over if it is repeated, so a lost driver counts nothing twice."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    rows = shape(spark.readStream.schema(schema).parquet(source))
    query = keyed_changes(rows, late).writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The newest row of each key."""
    rows = spark.read.option("basePath", target).parquet(target)
    return rows.groupBy("key").agg(F.max_by(F.struct("last_at", "seen", "changed"), "batch").alias("r")).select("key", "r.*")


def event_changes(spark: SparkSession, events: DataFrame, slices: int = 3) -> DataFrame:
    """Changes of each user's content in events, arriving in slices by time, with a restart
    of the stream before each slice."""
    held = events.select("event_id", "ts", "user_id", "event_type", "value", "props")
    arrived, state, target = (new_path(spark, n) for n in ("arrived", "state", "changed"))
    ends = held.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    shape = lambda df: df.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("id"), F.xxhash64("event_type", "value", "props").alias("hash"))
    if ends.a is None:
        return spark.createDataFrame([], OUTPUT)
    width = (ends.b - ends.a) / slices
    for k in range(slices):
        low, high = ends.a + k * width, ends.a + (k + 1) * width
        part = held.where((F.col("ts") >= low) & ((F.col("ts") < high) if k < slices - 1 else F.lit(True)))
        part.write.mode("append").parquet(arrived)
        follow(spark, arrived, held.schema, shape, state, target)
    return latest(spark, target)
