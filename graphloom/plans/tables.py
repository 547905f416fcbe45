"""Durable intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []
#: Where each table lies, for as long as its DataFrame lives, and all paths of this process.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_WRITTEN: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a local folder where it is unset and the
    session runs on this machine alone."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all hosts of the cluster share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="graphloom-"))
    return Path(_LOCAL[0]).as_uri()


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.add(path)
    return path


def growing(df: DataFrame) -> DataFrame:
    """The same rows, as a side of joins that is sorted and merged, not broadcast.

    Spark takes a table for as large as its compressed files, and a side read from them
    alone is broadcast by that: rows of 10 MB of Parquet can take hundreds in the driver.
    For sides that grow with the tables; the hint holds up to the first join.
    """
    return df.hint("merge")


def durable(df: DataFrame, name: str = "step") -> DataFrame:
    """Written as Parquet and reread: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def durable_counted(df: DataFrame, name: str = "step") -> tuple[DataFrame, int]:
    """durable(df) and its number of rows, counted while it is written."""
    seen = Observation()
    out = durable(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, int(seen.get["n"])


def bucketed(df: DataFrame, key: str, buckets: int | None = None, bloom: tuple[str, ...] = (), name: str = "bucketed") -> DataFrame:
    """Written in buckets of `key`, sorted by it: an equal key reads one bucket, and joins
    and aggregates on it need no shuffle.  The columns of `bloom` get Parquet's bloom filters.

    A key with a third of all rows makes one bucket long, but no task waits for it alone
    unless it asks for that key: its file is read in splits by scans that do not join.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    write = df.repartition(n, key).write.format("parquet").option("path", path).bucketBy(n, key).sortBy(key)
    for column in bloom:
        write = write.option(f"parquet.bloom.filter.enabled#{column}", "true")
    write.saveAsTable(table)
    out = spark.table(table)
    _PATHS[out] = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    spark.sql(f"DROP TABLE IF EXISTS `{path.rsplit('/', 1)[1].replace('-', '_')}`")
    _WRITTEN.discard(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of this module that no later step reads."""
    for df in tables:
        path = _PATHS.pop(df, None)
        if path:
            _delete(df.sparkSession, path)


def sweep(spark: SparkSession) -> int:
    """Delete every table that this process has written and not deleted; results that
    still read them are lost.  For the end of a session's work."""
    left = list(_WRITTEN)
    for path in left:
        _delete(spark, path)
    return len(left)
