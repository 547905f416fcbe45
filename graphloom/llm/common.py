"""Helpers shared by the operators: bounded Arrow batches, durable tables, splits."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.tables import discard, durable, shared_dir  # noqa: F401

BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches small enough that a batch of long texts fits in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def remainder_is_two(column: str, modulus: int) -> Column:
    """crc32 of the id as text leaves 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus == 2, F.lit(False))


def fresh(columns: list[str], *names: str) -> list[str]:
    """These names with as many underscores in front as keep them apart from columns."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def named(columns: list[str]) -> list[Column]:
    """Columns by their exact names, dots and backticks included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def without(columns: list[str], added: tuple[str, ...]) -> list[str]:
    """The columns that an operator's own ones do not replace."""
    return [c for c in columns if c.lower() not in added]


def positional(df: DataFrame) -> DataFrame:
    """The same columns named by their place, for mapInArrow, which cannot take every name."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def plain_names(docs: DataFrame, used: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with every column but the used ones under a name of its own, so that no added
    column can meet one of the caller's; and what gives the old columns back."""
    inside = [c if c in used else f"_c{k}" for k, c in enumerate(docs.columns)]
    return docs.toDF(*inside), lambda out: out.select(*[F.col(i).alias(c) for i, c in zip(inside, docs.columns)])


def small_table(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A table of a few rows that stand in the plan itself; columns as in `a int, b string`."""
    names = [c.split()[0] for c in columns.split(",")]
    kind = ",".join(c.strip().replace(" ", ":", 1) for c in columns.split(","))
    text = json.dumps([dict(zip(names, r)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{kind}>>")))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
