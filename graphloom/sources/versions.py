"""What changed between two versions of a table of files: the incremental index as a join.

The stored version has each file's metadata and the hash of its content; the new one has
metadata and content.  Metadata are compared first, in a full outer join that reads no
content; only files whose metadata differ are read and hashed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKIP, TOUCH, PARSE, GONE = "skip", "touch", "parse", "gone"


def content_hash(column: str):
    return F.sha2(F.coalesce(F.col(column), F.lit("")).cast("binary"), 256)


def snapshot(files: DataFrame) -> DataFrame:
    """(key, size, modified, hash) of files (key, size, modified, content), to be stored."""
    return files.select("key", "size", "modified", content_hash("content").alias("hash"))


def changes(before: DataFrame, after: DataFrame, full: bool = False) -> DataFrame:
    """(key, action, hash): one row for each key of either version.

    skip: size and modified are as they were (null equals null only if known before:
    a file stored without metadata is read); touch: they differ, the content is the
    same; parse: new content or a new file; gone: no longer there.  With `full` every
    file that is there is parsed.  Keys are unique in each version; null keys are left out.
    """
    old = before.where("key is not null").select("key", F.col("size").alias("old_size"), F.col("modified").alias("old_modified"), F.col("hash").alias("old_hash"), F.lit(True).alias("was"))
    meta = after.where("key is not null").select("key", "size", "modified", F.lit(True).alias("now"))
    both = meta.join(old, "key", "full_outer")
    same = F.coalesce((F.col("size") == F.col("old_size")) & (F.col("modified") == F.col("old_modified")), F.lit(False)) & F.lit(not full)
    seen = both.withColumn("same", same)
    left = seen.where("now is null or same").select("key", F.when(F.col("now").isNull(), GONE).otherwise(SKIP).alias("action"), F.col("old_hash").alias("hash"))
    asked = seen.where("now and not same").select("key", "old_hash")
    read = after.select("key", content_hash("content").alias("hash")).join(asked, "key")
    again = F.lit(not full) & F.coalesce(F.col("hash") == F.col("old_hash"), F.lit(False))
    return left.unionByName(read.select("key", F.when(again, TOUCH).otherwise(PARSE).alias("action"), "hash"))
