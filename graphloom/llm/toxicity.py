"""Toxicity by a factorization machine over hashed terms.

Terms of a text: every word and its first 4, 5 and 6 bytes (A-Z lowered), present
or absent, all hashed to 2**BITS buckets.  score = sigmoid(b + sum w_i x_i +
sum <v_i, v_j> x_i x_j over pairs of present buckets), so that pairs add what
single weights miss.

No bucket is left out: x_i = 3 / sqrt(buckets of the text) + evidence_i, where the
evidence grows with the z-score of the bucket's log odds in the sample.  So a term
that says nothing by itself still takes part, in pairs above all, and all terms
without evidence together weigh the same in a short and in a long text.

Fit on a bounded sample: the `sample` labelled training rows of lowest
xxhash64(doc_id), one row for each id.  A bucket that fewer than `min_docs` of
them hold has nothing learned, and weight zero.  The machine has a fixed size;
scoring covers every row and every whole text.

Defined cases: null or empty text: sigmoid(b).  No usable label, or one class
only: b is the log odds of (positives + 0.5) / (rows + 1) and no term has a
weight.  Null labels or ids are not learned from; an id with several labels has
the largest, one with several texts that of the least hash.  Repeated rows each
get a row, no rows give none.  Texts above a megabyte are read in pieces cut
between words and then counted as one.  Columns of docs named like an added one
are replaced, all others kept; those of `labels` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import bytesops as B
from graphloom.llm.common import bounded_batches, fresh, named, positional, without

PREFIXES = (4, 5, 6)
BITS = 20
ADDED = ("score", "predicted")


def present(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, bucket), distinct and sorted; a document's all at once."""
    held = np.zeros(0, np.int64)
    for part, bounds, docs, ends, _ in B.pieces(data, offsets):
        words = B.Words(part, bounds)
        doc = docs[words.segment] << BITS
        found = [doc | (words.hashes(upto) >> np.uint64(64 - BITS)).astype(np.int64) for upto in (None, *PREFIXES)]
        held = np.unique(np.concatenate([held, *found]))
        if ends:
            yield held >> BITS, held & ((1 << BITS) - 1)
            held = held[:0]


@dataclass
class Machine:
    bias: float
    evidence: np.ndarray  # of each bucket; nan: nothing learned
    w: np.ndarray
    v: np.ndarray

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        total = np.full(n, self.bias)
        for doc, bucket in present(data, offsets):
            sizes = np.bincount(doc, minlength=n)
            known = ~np.isnan(self.evidence[bucket])
            doc, bucket = doc[known], bucket[known]
            total += margin(doc, inputs(self.evidence[bucket], sizes[doc]), self.w[bucket], self.v[bucket], n)
        return _sigmoid(total)


def inputs(evidence: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.float32(3) / np.sqrt(size, dtype=np.float32) + evidence


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def margin(doc: np.ndarray, x: np.ndarray, w: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """sum w_i x_i + sum <v_i, v_j> x_i x_j of each of n documents."""
    out = np.bincount(doc, w * x, n).astype(float)
    for k in range(v.shape[1]):
        a = v[:, k] * x
        sums = np.bincount(doc, a, n)
        out += 0.5 * (sums * sums - np.bincount(doc, a * a, n))
    return out


def fit_rows(doc: np.ndarray, term: np.ndarray, x: np.ndarray, y: np.ndarray, n_terms: int, rank: int = 4, steps: int = 400, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, w, v) by AdaGrad on the logistic loss, in at least `steps` batches of
    128 rows, whole epochs; `doc` is sorted."""
    rng = np.random.default_rng(seed)
    w, v = np.zeros(n_terms), rng.normal(0, 0.02, (rank, n_terms))
    gw, gv, gb = np.full(n_terms, 1e-6), np.full((rank, n_terms), 1e-6), 1e-6
    bias = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    if y.min(initial=1) == y.max(initial=0) or not n_terms:
        return bias, w, v.T * 0
    begin = np.searchsorted(doc, np.arange(len(y) + 1))
    for _ in range(-(-steps // -(-len(y) // 128))):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), 128):
            part = order[lo : lo + 128]
            m = len(part)
            sizes = begin[part + 1] - begin[part]
            at = np.arange(sizes.sum()) + np.repeat(begin[part] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
            of, t, z = np.repeat(np.arange(m), sizes), term[at], x[at]
            a = v[:, t] * z
            sums = np.stack([np.bincount(of, a[k], m) for k in range(rank)])
            squares = np.bincount(of, (a * a).sum(0), m)
            miss = _sigmoid(bias + np.bincount(of, w[t] * z, m) + 0.5 * ((sums * sums).sum(0) - squares)) - y[part]
            pull = miss[of] * z / m
            dw = np.bincount(t, pull, n_terms) + decay * w
            gw += dw * dw
            w -= rate * dw / np.sqrt(gw)
            for k in range(rank):
                dv = np.bincount(t, pull * (sums[k][of] - a[k]), n_terms) + decay * v[k]
                gv[k] += dv * dv
                v[k] -= rate / 4 * dv / np.sqrt(gv[k])
            db = float(miss.mean())
            gb += db * db
            bias -= rate * db / gb**0.5
    return bias, w, v.T


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, sample: int = 8000, min_docs: int = 3) -> Machine:
    spark = docs.sparkSession
    bounded_batches(spark)
    usable = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    chosen = usable.where(~held_out).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    blank = Machine(0.0, np.full(1 << BITS, np.nan, np.float32), np.zeros(1 << BITS, np.float32), np.zeros((1 << BITS, 1), np.float32))
    if not chosen:
        return blank
    picked = spark.createDataFrame([tuple(r) for r in chosen], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic int")
    # at most `sample` ids: safe to send to every executor
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(present(*B.text_bytes(batch.column("text"))))
            doc, bucket = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            cut = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(batch))))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.ListArray.from_arrays(pa.array(cut), pa.array(bucket.astype(np.int32)))], names=["doc_id", "toxic", "terms"])

    found = rows.select("doc_id", "toxic", "text").mapInArrow(terms, T.StructType([*picked.schema.fields, T.StructField("terms", T.ArrayType(T.IntegerType()))]))
    # one row for each of the at most `sample` ids, of at most 2**BITS buckets each
    got = found.groupBy("doc_id", "toxic").agg(F.min_by("terms", F.xxhash64("terms")).alias("terms")).orderBy("doc_id").toArrow()
    if not len(got):
        return blank
    y = got.column("toxic").to_numpy().astype(float)
    lists = got.column("terms").chunks
    del got
    size = np.concatenate([c.value_lengths().to_numpy(zero_copy_only=False) for c in lists])
    bucket = np.concatenate([c.flatten().to_numpy() for c in lists])
    del lists
    doc = np.repeat(np.arange(len(y), dtype=np.int32), size)
    n, ones = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for lo in range(0, len(bucket), 1 << 20):  # in parts: the sample's terms are many
        part = slice(lo, lo + (1 << 20))
        n += np.bincount(bucket[part], minlength=1 << BITS)
        ones += np.bincount(bucket[part], y[doc[part]], 1 << BITS)
    a, b, p = ones + 0.5, n - ones + 0.5, y.sum()
    odds = np.log(a / (p + 1 - a)) - np.log(b / (len(y) - p + 1 - b))
    z = np.abs(odds) / np.sqrt(1 / a + 1 / b)
    evidence = np.where(n >= min_docs, np.minimum(np.maximum(z - 1, 0) / 3, 2), np.nan).astype(np.float32)
    known = np.flatnonzero(n >= min_docs)
    place = np.zeros(1 << BITS, np.int32)
    place[known] = np.arange(len(known))
    kept = n[bucket] >= min_docs
    doc, bucket = doc[kept], bucket[kept]
    x = inputs(evidence[bucket], size.astype(np.float32)[doc])
    term = place[bucket]
    del kept, bucket
    bias, w, v = fit_rows(doc, term, x, y, len(known))
    out = Machine(bias, evidence, np.zeros(1 << BITS, np.float32), np.zeros((1 << BITS, v.shape[1]), np.float32))
    out.w[known], out.v[known] = w, v
    return out


def score(docs: DataFrame, machine: Machine, threshold: float = 0.3, kept: list[str] | None = None) -> DataFrame:
    """The kept columns (all) of docs, with score and predicted (score >= threshold)."""
    bounded_batches(docs.sparkSession)
    kept = without(docs.columns if kept is None else kept, ADDED)
    (source,) = fresh(kept, "text")
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            s = model.scores(*B.text_bytes(batch.column(len(kept))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*kept, *ADDED])

    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return positional(docs.select(*named(kept), F.col("text").alias(source))).mapInArrow(run, schema)
