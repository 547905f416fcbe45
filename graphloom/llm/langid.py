"""Language ID by nearest centroid.

Letters of a text (A-Z lowered; ASCII non-letters count as one space) give byte
2- and 3-grams hashed to DIMS terms; a text's vector is (1 + log tf) * idf,
L2-normalised.  Each language has up to `centroids` unit centroids from
spherical k-means.  The language of the centroid with the largest cosine wins
(ties: the first in sorted order of languages); score is that cosine.

A text is rejected by distance.  Short texts reach smaller cosines than long ones,
so each language has a line through its sample's log cosines over the log number of
distinct terms; a text is rejected below `slack` times the line, lowered to the
0.5 % quantile of the sample's own distances from it.

idf counts all training rows with letters.  Every language of them is learned,
its centroids from a bounded sample: its `sample` rows of lowest
xxhash64(doc_id).  Whole texts are used everywhere.
Centroids are made per language on the executors; the driver gets only them
(32 KB each, `centroids` a language at most), never texts.

Defined cases: null, empty or letterless text: `und`, score 0, rejected.  No
training rows: `und` for all.  Repeated rows each get a row, no rows give none.
Texts above a megabyte are read in pieces that overlap by two bytes, so no gram is
lost.  Columns of docs named like an added one are replaced, all others kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import bytesops as B
from graphloom.llm.common import bounded_batches, durable, fresh, named, positional, without

DIMS = 1 << 13
ADDED = ("lang_pred", "score", "rejected")
_MAP = np.full(256, 32, np.uint8)
_MAP[65:91] = np.arange(97, 123)
_MAP[97:123] = np.arange(97, 123)
_MAP[128:] = np.arange(128, 256)


def counts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first document, matrix of term counts) for blocks of at most 64 documents."""
    n = len(offsets) - 1
    block, first = np.zeros((64, DIMS), np.float32), 0
    for part, bounds, docs, _, before in B.pieces(data, offsets, reach=2):
        x = _MAP[np.concatenate([before, part])].astype(np.uint32)
        grams = []
        for width in (2, 3):
            h = np.zeros(max(0, len(x) - width + 1), np.uint32)
            for j in range(width):
                h = h * np.uint32(257) + x[j : len(x) - width + 1 + j]
            h = (h * np.uint32(2654435761)) >> np.uint32(19)
            blank = (x[: len(h)] == 32) & (x[1 : len(h) + 1] == 32)
            h[blank] = DIMS  # runs of spaces say nothing
            grams.append(h)
        for k, doc in enumerate(docs):
            while doc - first >= 64:
                yield first, block
                block, first = np.zeros((64, DIMS), np.float32), first + 64
            for width, h in zip((2, 3), grams):
                # grams that end in this piece
                lo = max(0, bounds[k] + len(before) - width + 1 if len(before) else bounds[k])
                hi = max(lo, bounds[k + 1] + len(before) - width + 1)
                block[doc - first] += np.bincount(h[lo:hi], minlength=DIMS + 1)[:DIMS]
    while first < n:
        yield first, block[: n - first]
        block, first = np.zeros((64, DIMS), np.float32), first + 64


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Centroids:
    langs: list[str]  # of each centroid
    idf: np.ndarray
    matrix: np.ndarray
    line: np.ndarray  # slope and intercept of the least accepted log cosine of each centroid's language

    def best(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nearest centroid, cosine, whether it is near enough) of each document."""
        at, cosine, size = [], [], []
        for _, tf in counts(data, offsets):
            c = vectors(tf, self.idf) @ self.matrix.T
            at.append(c.argmax(1))
            cosine.append(c.max(1))
            size.append((tf > 0).sum(1))
        where, c = np.concatenate(at), np.clip(np.concatenate(cosine), 0, 1).astype(float)
        line = self.line[where]
        return where, c, c >= np.exp(line[:, 0] * np.log(np.maximum(np.concatenate(size), 1)) + line[:, 1])


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        c = np.stack([x[at == j].sum(0) if (at == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _line(size: np.ndarray, cosine: np.ndarray, slack: float) -> tuple[float, float]:
    """Slope and intercept of the least accepted log cosine over the log size."""
    x, y = np.log(np.maximum(size, 1)), np.log(np.maximum(cosine, 1e-6))
    spread = ((x - x.mean()) ** 2).sum()
    slope = float(np.clip(((x - x.mean()) * (y - y.mean())).sum() / spread, 0, 0.5)) if spread > 1e-9 else 0.25
    return slope, float(np.quantile(y - slope * x, 0.005) + np.log(slack))


def _frequencies(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows, and of those that hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(DIMS + 1, np.int64)  # the last counts rows
        for batch in batches:
            seen[DIMS] += len(batch)
            for _, tf in counts(*B.text_bytes(batch.column("text"))):
                seen[:DIMS] += (tf > 0).sum(0)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["term", "n"])

    seen = np.zeros(DIMS + 1, np.int64)
    for r in rows.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        seen[r.term] = r.n
    return int(seen[DIMS]), seen[:DIMS]


def fit(docs: DataFrame, held_out: Column, sample: int = 400, centroids: int = 4, slack: float = 0.6) -> Centroids | None:
    bounded_batches(docs.sparkSession)
    training = docs.where(~held_out & F.col("lang").isNotNull())
    rows = training.where(F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    # thin out by hash before ranking, so that no language's rows meet in one task;
    # only languages of more than 3 * sample rows need a share
    sizes = training.groupBy("lang").count().where(F.col("count") > 3 * sample).select("lang", (F.lit(3.0 * sample) / F.col("count")).alias("_share"))
    thin = rows.join(F.broadcast(sizes), "lang", "left").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.coalesce("_share", F.lit(1.0)) * (1 << 20))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text"))
    got = durable(thin.withColumn("_rank", rank).where(F.col("_rank") <= sample).select("doc_id", "lang", "text"), "language_rows")
    n, seen = _frequencies(rows)
    if not n:
        return None
    idf = (np.log((1 + n) / (1 + seen)) + 1).astype(np.float32)

    def one(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        x, size = (np.concatenate(p) for p in zip(*((vectors(tf, idf), (tf > 0).sum(1)) for _, tf in counts(*B.text_bytes(group.column("text"))))))
        c = _kmeans(x, centroids, 11)
        slope, start = _line(size, (x @ c.T).max(1), slack)
        return pa.table({"lang": pa.array([key[0].as_py()] * len(c), pa.string()), "c": pa.array([row.astype(np.float32).tobytes() for row in c], pa.binary()), "slope": pa.array([slope] * len(c)), "start": pa.array([start] * len(c))})

    # stable: a language's centroids stay in their order
    made = sorted(got.groupBy("lang").applyInArrow(one, "lang string, c binary, slope double, start double").collect(), key=lambda r: r.lang)
    if not made:
        return None
    return Centroids([r.lang for r in made], idf, np.stack([np.frombuffer(r.c, np.float32) for r in made]), np.array([(r.slope, r.start) for r in made]))


def predict(docs: DataFrame, model: Centroids | None, kept: list[str] | None = None) -> DataFrame:
    """The kept columns (all) of docs, with lang_pred, score and rejected."""
    bounded_batches(docs.sparkSession)
    kept = without(docs.columns if kept is None else kept, ADDED)
    source, lettered = fresh(kept, "text", "letters")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            n = len(batch)
            letters = batch.column(len(kept) + 1).to_numpy(zero_copy_only=False)
            if m is None or not n:
                lang, s, no = np.full(n, "und"), np.zeros(n), np.ones(n, bool)
            else:
                at, s, near = m.best(*B.text_bytes(batch.column(len(kept))))
                lang, s = np.where(letters, np.array(m.langs)[at], "und"), np.where(letters, s, 0.0)
                no = ~letters | ~near
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(lang.tolist(), pa.string()), pa.array(s), pa.array(no)], names=[*kept, *ADDED])

    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return positional(docs.select(*named(kept), F.col("text").alias(source), letters.alias(lettered))).mapInArrow(run, schema)
