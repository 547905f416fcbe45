"""Approximate nearest neighbours by additive quantisation.

Vectors are scaled to length one.  BOOKS codebooks of WORDS full-dimensional
codewords start as residual k-means and are then refitted by least squares over
all of them, one book at a time; a vector's code is the best of a beam search of width BEAM over its
residuals, and its quantised norm is stored.  A query's table of products with
all codewords scores every code by lookups over the stored norm; the `rerank`
best of each query over all slots then get their exact cosine, in double precision,
on the original vectors.

Codebooks are fitted on a bounded sample: the `sample` vectors of lowest
xxhash64(id).  Nothing else comes from a sample: every vector is encoded and scored
against every query.  Queries and candidates meet in blocks (QUERIES queries by SLOT
candidates); a task holds one block of queries and streams codes.  Several slots are
scanned twice.  First each gives, of its `rerank` best scores for a query, those at
places that grow by GROWTH; a place tells how many codes of its slot reach that score
at least, so these sum to a score that `rerank` of all codes reach for certain, and
seldom a quarter more (equal scores apart).  Then each slot sends its codes that reach it.  So the codes that are merged grow with the queries, not with
queries times slots, and are the same as those of a single slot.

Defined cases: vectors that are null, of zero length, hold null or non-finite
components, or differ in dimension from the most frequent one take no part, nor
do null ids.  Of rows of one id the smallest vector counts.  Ties go to the
smaller id; fewer candidates than k give them all; no rows give none.  Other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import bounded_batches, durable

BOOKS, WORDS, BEAM = 16, 256, 4
QUERIES, SLOT, GROWTH = 512, 16384, 1.25
#: Scores of two scans are taken as equal within this, should machines round differently.
SLACK = 1e-5


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1) - 2 * (x @ c.T)).argmin(1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


@dataclass
class Codebooks:
    words: np.ndarray  # BOOKS x WORDS x dims, float32

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(codes, norms of the quantised vectors)."""
        n, books = len(x), len(self.words)
        rest, codes = x[:, None, :], np.zeros((n, 1, 0), np.uint8)
        for book in self.words:
            width, k = rest.shape[1], len(book)
            left = (rest**2).sum(2)[:, :, None] + (book * book).sum(1) - 2 * (rest.reshape(-1, x.shape[1]) @ book.T).reshape(n, width, k)
            flat = left.reshape(n, width * k)
            keep = min(beam, width * k)
            top = np.argpartition(flat, keep - 1, 1)[:, :keep] if keep < width * k else np.tile(np.arange(width * k), (n, 1))
            came, word = top // k, top % k
            row = np.arange(n)[:, None]
            rest = rest[row, came] - book[word]
            codes = np.concatenate([codes[row, came], word[:, :, None].astype(np.uint8)], 2)
        best = (rest**2).sum(2).argmin(1)
        row = np.arange(n)
        return codes[row, best], np.linalg.norm(x - rest[row, best], axis=1).astype(np.float32)

    def table(self, q: np.ndarray) -> np.ndarray:
        """Products of each query with each codeword: n x BOOKS x WORDS."""
        return np.einsum("qd,bwd->qbw", q, self.words, optimize=True)


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, refits: int = 2, sweeps: int = 5, pull: float = 0.5, seed: int = 3) -> Codebooks:
    rng, rest, out = np.random.default_rng(seed), x.copy(), []
    for _ in range(books):
        c = _kmeans(rest, words, rng)
        rest -= c[_nearest(rest, c)]
        out.append(c)
    made = Codebooks(np.stack(out).astype(np.float32))
    for _ in range(refits):
        codes, _ = made.encode(x)
        new = made.words.astype(np.float64)
        total = sum(new[b][codes[:, b]] for b in range(books))
        for _ in range(sweeps):  # least squares over all codebooks, one at a time
            for b in range(books):
                at = codes[:, b]
                rest = x - total + new[b][at]
                n = np.bincount(at, minlength=words)
                mean = np.stack([np.bincount(at, rest[:, d], words) for d in range(x.shape[1])], 1)
                # codewords of few vectors stay near where they were
                fresh = (mean + pull * new[b]) / (n + pull)[:, None]
                total += fresh[at] - new[b][at]
                new[b] = fresh
        made = Codebooks(new.astype(np.float32))
    return made


def usable(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v (array<double>): one row for each id that takes part."""
    v = F.col(vector).cast("array<double>")
    good = rows.where(F.col(id_column).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    good = good.where(F.coalesce(fine, F.lit(False)))
    size = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.where(F.size("v") == (size.n if size else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _places(limit: int) -> np.ndarray:
    """1, 2, 3, ..., then growing by GROWTH, up to limit."""
    at = [1]
    while at[-1] < limit:
        at.append(min(limit, max(at[-1] + 1, int(at[-1] * GROWTH))))
    return np.array(at)


def search(rows: DataFrame, queries: DataFrame, k: int = 5, rerank: int = 600, sample: int = 8192, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest cosines but its own."""
    spark = rows.sparkSession
    bounded_batches(spark)
    base = durable(usable(rows, id_column, vector), "vectors")
    asked = base.join(queries.select(F.col(id_column).cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n, first = base.count(), base.select(F.size("v")).first()
    if first is None:
        return empty
    dims, n_queries = first[0], asked.count()
    picked = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec_id", "v").toPandas().sort_values("vec_id")
    books = spark.sparkContext.broadcast(fit(_unit(np.stack(picked["v"].to_numpy())), words=min(WORDS, max(2, len(picked) // 8))))
    slots, blocks = -(-n // SLOT), max(1, -(-n_queries // QUERIES))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                ids = batch.column("vec_id").to_numpy()
                codes, norms = books.value.encode(_unit(_matrix(batch.column("v"), dims)))
                # by a hash of the batch's ids, so that no spacing of ids favours a slot
                slot = zlib.crc32(ids.tobytes()) % slots
                yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), pa.array([ids.tobytes()]), pa.array([codes.tobytes()]), pa.array([norms.tobytes()])], names=["slot", "ids", "codes", "norms"])

    def scanned(counts: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The `rerank` best codes of each query and slot; counts: scores at some places instead, with the codes since the last place."""
        group, q, table, best, places = None, [], None, [], _places(rerank)

        def out() -> pa.RecordBatch:
            kept = [(qid, *best[i]) for i, (qid, _, _) in enumerate(q) if best]
            if counts:
                at = [places[places <= len(s)] for _, _, s in kept]
                kept = [(qid, np.diff(p, prepend=0), np.sort(s)[::-1][p - 1]) for (qid, _, s), p in zip(kept, at)]
            a = np.repeat(np.array([qid for qid, _, _ in kept], np.int64), [len(c) for _, c, _ in kept])
            b, s = (np.concatenate([r[k] for r in kept]) if kept else np.zeros(0) for k in (1, 2))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float32())], names=["query_id", "codes" if counts else "vec_id", "near"])

        for batch in batches:
            for r in batch.to_pylist():
                if (r["slot"], r["block"]) != group:
                    if group is not None:
                        yield out()
                    group, q, table, best = (r["slot"], r["block"]), [], None, []
                if r["v"] is not None:
                    q.append((r["query_id"], r["v"], r["least"]))
                    continue
                if not q:
                    continue
                if table is None:
                    table = books.value.table(_unit(np.array([v for _, v, _ in q])))
                    best = [(np.zeros(0, np.int64), np.zeros(0, np.float32)) for _ in q]
                    low = np.array([least for _, _, least in q], np.float32)
                ids, norms = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["norms"], np.float32)
                codes = np.frombuffer(r["codes"], np.uint8).reshape(len(ids), -1)
                total = np.zeros((len(q), len(ids)), np.float32)
                for b in range(codes.shape[1]):
                    total += table[:, b, codes[:, b]]
                total /= np.maximum(norms, 1e-6)
                hit = total >= low[:, None]
                for i in np.flatnonzero(hit.any(1)):
                    other = hit[i] & (ids != q[i][0])
                    s, c = np.concatenate([best[i][1], total[i][other]]), np.concatenate([best[i][0], ids[other]])
                    if len(s) > rerank:
                        low[i] = np.partition(s, -rerank)[-rerank]
                        top = np.flatnonzero(s >= low[i])
                        if len(top) > rerank:  # of equal scores the smaller ids
                            top = top[np.lexsort((c[top], -s[top]))[:rerank]]
                        s, c = s[top], c[top]
                    best[i] = (c, s)
        if group is not None:
            yield out()

    spread = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))

    # both scans see the same codes
    codes = durable(base.mapInArrow(encoded, "slot long, ids binary, codes binary, norms binary"), "codes")

    def scan(queries: DataFrame, counts: bool) -> DataFrame:
        left = queries.select(F.col("vec_id").alias("query_id"), "v", "least", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")).withColumn("slot", spread(slots))
        right = codes.withColumn("block", spread(blocks))
        both = left.select("slot", "block", "query_id", "v", "least", *[F.lit(None).cast("binary").alias(c) for c in ("ids", "codes", "norms")])
        both = both.unionByName(right, allowMissingColumns=True)
        placed = both.repartition("slot", "block").sortWithinPartitions("slot", "block", F.col("query_id").asc_nulls_last())
        return placed.mapInArrow(partial(scanned, counts), f"query_id long, {'codes' if counts else 'vec_id'} long, near float")

    asked_from = asked.withColumn("least", F.lit(float("-inf")).cast("float"))
    if slots > 1:
        so_far = F.sum("codes").over(Window.partitionBy("query_id").orderBy(F.desc("near")).rowsBetween(Window.unboundedPreceding, 0))
        # a query with fewer than `rerank` codes in all keeps all
        least = scan(asked_from, True).withColumn("n", so_far).where(F.col("n") >= rerank).groupBy("query_id").agg(F.max("near").alias("at"))
        least = durable(least.select(F.col("query_id").alias("vec_id"), (F.col("at") - SLACK * F.greatest(F.abs("at"), F.lit(1.0))).cast("float").alias("least")), "least")
        asked_from = asked.join(least, "vec_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")).cast("float")))
    # of all slots' best only the best of all meet their vectors
    near = Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id")
    found = scan(asked_from, False).withColumn("at", F.row_number().over(near)).where(F.col("at") <= rerank).select("query_id", "vec_id")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_matrix(batch.column(c), dims) for c in ("q", "v"))
            a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
            s = (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), pa.array(s)], names=["query_id", "vec_id", "score"])

    pairs = found.join(base, "vec_id").join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    scored = pairs.select("query_id", "vec_id", "q", "v").mapInArrow(exact, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
