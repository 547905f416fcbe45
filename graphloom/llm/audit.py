"""Filter interaction audit: what each filter removes at each place of each order.

A text's failed filters are a mask.  Every mask maps to one big integer with a
field of 64 bits for each outcome (kept, removed, redundant, ...) of each step of
each order: 120 orders of five filters make 600 steps.  Masks are counted by part
with Spark's partial aggregation, so at most 2**5 masks and four label states of a
part meet in one task, whatever its rows; there count * integer is summed and the
sum unpacked.  No field can run into the next one below 2**64 / 120 rows a part.

The filters (words are maximal runs outside space and \\t-\\r, case-sensitive):
A under 200 words; B 100 * distinct words < 50 * words; C 100 * [A-Z] > 2 * code
points; D holds any of #$%&*|; E equals the text of a smaller doc_id anywhere.

Defined cases: null text is empty (so it fails A, and E if a smaller id is empty
too), null source is the part ''.  A null doc_id is smaller than none and greater
than none, and has no labels.  Repeated rows count each; they are not smaller than
each other.  A doc_id with several label rows is good or toxic if any says so.
Texts are read whole, long ones in pieces of words, so that only their distinct
words are held.  No rows give no rows.  Other columns of both tables are not read,
whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import bounded_batches, durable

FILTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
PIECE = 1 << 20
_UPPER = bytes(range(65, 91))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_MARKS = re.compile(rb"[#$%&*|]")


def word_counts(text: bytes) -> tuple[int, int]:
    """(words, distinct words), a piece at a time."""
    n, seen, at = 0, set(), 0
    while at < len(text):
        cut = _SPACE.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        words = text[at:end].split()  # bytes split at exactly these six characters
        n += len(words)
        seen.update(words)
        at = end
    return n, len(seen)


def failed(text: str) -> int:
    """The mask of the filters A to D that a text fails."""
    raw = text.encode()
    n, distinct = word_counts(raw)
    upper = len(raw) - len(raw.translate(None, _UPPER))
    return (n < 200) | (100 * distinct < 50 * n) << 1 | (100 * upper > 2 * len(text)) << 2 | (_MARKS.search(raw) is not None) << 3


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, digest): a row for each document, from one pass over the texts."""
    bounded_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("part", T.StringType()), T.StructField("mask", T.IntegerType()), T.StructField("digest", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            masks, digests = np.empty(len(texts), np.int32), []
            for k, value in enumerate(texts):
                text = value.as_py()
                masks[k] = failed(text)
                digests.append(hashlib.sha256(text.encode()).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks), pa.array(digests, pa.binary())], names=schema.names)

    empty = F.lit("")
    return docs.select("doc_id", F.coalesce("source", empty).alias("part"), F.coalesce("text", empty).alias("text")).mapInArrow(run, schema)


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): documents by the filters they fail and their labels."""
    rows = durable(judged(docs), "judged")
    # one row a repeated text: the join's other side is unique, so a text of many copies can be split
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    known = rows.join(first, "digest", "left").join(said, "doc_id", "left")
    copy = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    mask = F.col("mask") + F.when(copy, 1 << 4).otherwise(0)
    no = F.lit(False)
    return known.groupBy("part", mask.alias("mask"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")).agg(F.count("*").alias("n"))


@cache
def steps(filters: str) -> list[tuple[str, int]]:
    """(order, place of the step from 0), in the order of the fields."""
    return [("".join(order), k) for order in permutations(filters) for k in range(len(filters))]


@cache
def packed(filters: str, mask: int, good: bool, toxic: bool) -> int:
    """One document's outcomes at all steps, a 64-bit field for each."""
    out = np.zeros((len(steps(filters)), len(COUNTS)), "<u8")
    fails = {f for k, f in enumerate(filters) if mask >> k & 1}
    first = [next((f for f in order if f in fails), "") for order, k in steps(filters)]
    for at, (order, k) in enumerate(steps(filters)):
        here = order[k]
        earlier = any(f in fails for f in order[:k])
        removed = here in fails and not earlier
        out[at] = (not earlier and here not in fails, removed, here in fails and earlier, fails == {here}, removed and good, removed and toxic, sum(f == here for f in first) // len(filters))
    return int.from_bytes(out.tobytes(), "little")


def unpacked(total: int, filters: str) -> np.ndarray:
    """Steps x COUNTS of a sum of packed integers."""
    size = len(steps(filters)) * len(COUNTS)
    return np.frombuffer(total.to_bytes(size * 8, "little"), "<u8").reshape(-1, len(COUNTS)).astype(np.int64)


def outcomes(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, COUNTS) for every order of the filters; counted has
    a row for each (part, mask, good, toxic), bit k of a mask being filters[k]."""

    def expand(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(int(n) * packed(filters, int(m), bool(g), bool(t)) for m, g, t, n in zip(rows["mask"], rows["good"], rows["toxic"], rows["n"]))
        out = pd.DataFrame(unpacked(total, filters), columns=list(COUNTS))
        out.insert(0, "part", key[0])
        out.insert(1, "filter_order", [order for order, _ in steps(filters)])
        out.insert(2, "step", np.array([k + 1 for _, k in steps(filters)], np.int32))
        return out

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
    return counted.groupBy("part").applyInPandas(expand, schema)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcomes of the five filters by part (source); see the module."""
    return outcomes(masked(docs, labels))
