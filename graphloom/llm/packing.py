"""Packing into optimal length buckets.

A text's length is its number of words (runs of non-space characters) plus one
end token.  The global histogram of exact lengths goes through a dynamic
programme that picks at most `buckets` upper bounds with the least total padding;
inside a bucket, batches of budget // bound texts follow each other in order of a
hash of the id, and only a bucket's last batch may be smaller.

A text longer than the budget fits no batch: it takes no part in the programme,
gets a batch of its own with its own length as the bound, and `over_budget` says so.

The histogram has a row for each distinct length, at most the square root of twice
the number of tokens; nothing else reaches the driver.

Defined cases: null or empty text has length one.  Null ids hash as null; ties
are broken by the text's hash.  Repeated rows take a place each.  Texts are
counted whole, whatever their length.  No rows give no rows.  Columns of docs named
like an added one are replaced, all others are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import bytesops as B
from graphloom.llm.common import bounded_batches, durable, fresh, named, positional, without

GROUP_ROWS = 50_000
ADDED = ("n_tokens", "bucket", "batch_id", "padding", "over_budget")


def with_length(docs: DataFrame, kept: list[str]) -> DataFrame:
    """The kept columns of docs and n_tokens."""
    bounded_batches(docs.sparkSession)
    (source,) = fresh(kept, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = B.word_counts(*B.text_bytes(batch.column(len(kept)))) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(n)], names=[*kept, "n_tokens"])

    fields = [docs.schema[c] for c in kept]
    return positional(docs.select(*named(kept), F.col("text").alias(source))).mapInArrow(run, T.StructType([*fields, T.StructField("n_tokens", T.LongType())]))


def _best_starts(best: np.ndarray, x: np.ndarray, n: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each end j the least best[i - 1] + cost(i, j) over starts 1 <= i <= j, and
    the first such i.  Best starts never fall as j grows, so the ends are solved
    middle first, each between the starts of its solved neighbours."""
    u = len(x)
    least, start = np.full(u, np.inf), np.full(u, -1, np.int64)
    lo, hi, first, last = np.array([1]), np.array([u]), np.array([1]), np.array([u - 1])
    while len(lo):
        mid = (lo + hi) // 2
        size = np.minimum(mid, last) - first + 1
        begin = np.concatenate(([0], np.cumsum(size)[:-1]))
        i = np.arange(size.sum()) - np.repeat(begin, size) + np.repeat(first, size)
        j = np.repeat(mid, size)
        total = best[i - 1] + x[j] * (n[j + 1] - n[i]) - (tokens[j + 1] - tokens[i])
        low = np.minimum.reduceat(total, begin)
        hit = np.flatnonzero(total == np.repeat(low, size))
        at = i[hit[np.searchsorted(hit, begin)]]
        least[mid], start[mid] = low, at
        left, right = lo < mid, mid + 1 < hi
        lo, hi, first, last = (np.concatenate(p) for p in ((lo[left], mid[right] + 1), (mid[left], hi[right]), (first[left], at[right]), (at[left], last[right])))
    return least, start


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds (ascending, last = longest) that minimise sum of bound - length.

    cost(i, j) = lengths[j] * n(i..j) - tokens(i..j), one layer for each further
    bucket.  With ties the fewest buckets, then the earliest start, win.
    """
    u = len(lengths)
    if not u:
        return []
    order = np.argsort(lengths)
    x, c = lengths[order].astype(float), counts[order].astype(float)
    n, tokens = np.concatenate(([0], np.cumsum(c))), np.concatenate(([0], np.cumsum(c * x)))
    best = x * n[1:] - tokens[1:]  # one bucket
    starts = [np.zeros(u, np.int64)]
    for _ in range(1, min(buckets, u)):
        new, start = _best_starts(best, x, n, tokens)
        start[new >= best] = -1  # fewer buckets do as well
        new = np.minimum(new, best)
        if new[-1] >= best[-1]:
            break
        starts.append(start)
        best = new
    bounds, end = [], u - 1
    for start in reversed(starts):
        if start[end] < 0:
            continue
        bounds.append(int(x[end]))
        end = int(start[end]) - 1
        if end < 0:
            break
    return bounds[::-1]


def pack(docs: DataFrame, buckets: int = 16, budget: int = 16384, kept: list[str] | None = None) -> DataFrame:
    """The kept columns (all) of docs, with n_tokens, bucket, batch_id, padding, over_budget."""
    kept = without(docs.columns if kept is None else kept, ADDED)
    h, group, before, at = fresh([*docs.columns, *kept, *ADDED], "h", "group", "before", "at")
    # texts are read once: the rest works on what is kept and the length
    sized = durable(with_length(docs.withColumn(h, F.xxhash64("doc_id", "text")), [*kept, h]), "lengths")
    within = F.col("n_tokens") <= budget
    histogram = sized.where(within).groupBy("n_tokens").agg(F.count("*").alias("n")).toPandas()
    bounds = best_bounds(histogram["n_tokens"].to_numpy(), histogram["n"].to_numpy(), buckets)
    tops = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")
    # a bucket's rows are numbered in groups of about GROUP_ROWS, whose offsets come from counts
    groups = sized.count() // GROUP_ROWS + 1
    bucket = F.when(within, F.get(F.filter(tops, lambda t: t >= F.col("n_tokens")), F.lit(0))).otherwise(F.col("n_tokens"))
    placed = sized.withColumns({"bucket": bucket, group: F.pmod(h, F.lit(groups))})
    sizes = placed.groupBy("bucket", group).agg(F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("bucket", group, earlier.alias(before))
    order = Window.partitionBy("bucket", group).orderBy(h, "n_tokens")
    numbered = placed.withColumn(at, F.row_number().over(order)).join(offsets, ["bucket", group])
    each = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket")))
    batch = F.floor((F.col(before) + F.col(at) - 1) / each).cast("long")
    return numbered.select(*named(kept), "n_tokens", "bucket", F.concat_ws("-", "bucket", batch).alias("batch_id"), (F.col("bucket") - F.col("n_tokens")).alias("padding"), (~within).alias("over_budget"))
