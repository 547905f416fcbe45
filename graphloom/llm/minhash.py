"""Near-duplicate classes by ProbMinHash, banding and exact verification.

Shingles are five words (A-Z lowered), weighted by their count; two texts are
near if their probability Jaccard similarity is at least 0.8.  A text of one to
four words is one shingle; a text without words is near only to equal texts.

Signature: each distinct shingle starts a Poisson process of rate its count;
every arrival falls into one of BANDS * ROWS registers, which keeps the first.
A shingle stops once its next arrival is later than every register's, so most
stop after one or two.  Two registers agree with the probability Jaccard
similarity, and BANDS bands of ROWS registers make candidates.

Links: equal texts form one text by md5.  In each bucket every text is checked
against the bucket's least id; what these links leave in different components
is then checked pair by pair, in blocks of at most LEFT by RIGHT texts, never
emitting pairs that are already connected.  So each candidate pair is either
verified or known to be connected, whatever the size of its bucket.

Buckets of more than HOT texts are few (at most texts * BANDS / HOT) and are joined
apart from the others, by broadcasts of about HOT_BUCKETS of them each, so that a
bucket's texts never meet in one task.

Defined cases: null text counts as empty.  A null id is replaced by
xxhash64(text).  Rows that share an id are one document, so their classes join.
No rows give none.  Texts of any length count whole.  Other columns are not read,
and one_of_each() keeps them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import bytesops as B
from graphloom.llm.common import bounded_batches, discard, durable, plain_names
from graphloom.llm.components import components

BANDS, ROWS = 20, 4
THRESHOLD = 0.8
LEFT, RIGHT = 256, 1024
HOT, HOT_BUCKETS = 1024, 1 << 17
FILTER_BITS = 1 << 25
U = np.uint64


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, size: int = BANDS * ROWS) -> np.ndarray:
    """n x size registers: the shingle of the first arrival (0: no shingles)."""
    first = np.full(n * size, np.inf)
    kept = np.zeros(n * size, U)
    active, now, turn = np.arange(len(doc)), np.zeros(len(doc)), 0
    while len(active):
        turn += 1
        h = B.mix(shingle[active], turn)
        u = ((h >> U(11)).astype(float) + 0.5) / (1 << 53)
        now[active] -= np.log(u) / weight[active]
        place = doc[active] * size + (B.mix(h, 999) % U(size)).astype(np.int64)
        np.minimum.at(first, place, now[active])
        won = first[place] == now[active]
        kept[place[won]] = shingle[active[won]]
        limit = first.reshape(n, size).max(1)
        active = active[now[active] < limit[doc[active]]]
    return kept.reshape(n, size)


def band_hashes(registers: np.ndarray) -> np.ndarray:
    n = len(registers)
    out = np.zeros((n, BANDS), U)
    for r in range(ROWS):
        out = B.mix(out + registers.reshape(n, BANDS, ROWS)[:, :, r], r + 1)
    return B.mix(out + np.arange(BANDS, dtype=U), 77)


def similarity(a: np.ndarray, ca: np.ndarray, b: np.ndarray, cb: np.ndarray) -> float:
    """Probability Jaccard: sum over common i of 1 / sum_j max(x_j/x_i, y_j/y_i)."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    x, y = ca[i].astype(float), cb[j].astype(float)
    only_a, only_b = ca.sum() - x.sum(), cb.sum() - y.sum()
    ratio = x / y
    total = 0.0
    for r in np.unique(ratio):
        total += x[ratio == r].sum() / (only_a + r * only_b + np.maximum(x, r * y).sum())
    return total


class _Block:
    """The left texts of a group, indexed by shingle."""

    def __init__(self, ids: list[int], comps: list[int], sets: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.ids, self.sets = ids, sets
        self.comps = list(comps)
        self.root: dict[int, int] = {}
        shingle = np.concatenate([s for s, _ in sets]) if sets else np.zeros(0, U)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s, _ in sets])
        part = np.concatenate([c / c.sum() for _, c in sets]) if sets else np.zeros(0)
        order = np.argsort(shingle, kind="stable")
        self.shingle, self.owner, self.part = shingle[order], owner[order], part[order]

    def find(self, c: int) -> int:
        while c in self.root:
            c = self.root[c]
        return c

    def links(self, tid: int, comp: int, skip: int, s: np.ndarray, c: np.ndarray) -> Iterator[tuple[int, int]]:
        lo, hi = np.searchsorted(self.shingle, s, "left"), np.searchsorted(self.shingle, s, "right")
        times = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())
        bound = np.bincount(self.owner[at], np.minimum(self.part[at], np.repeat(c / c.sum(), times)), len(self.ids))
        for k in np.flatnonzero(bound >= THRESHOLD - 1e-9):  # the similarity is at most this sum
            other = self.ids[k]
            if other == tid or skip in (other, tid):
                continue
            x, y = self.find(self.comps[k]), self.find(comp)
            if x != y and similarity(*self.sets[k], s, c) >= THRESHOLD - 1e-9:
                self.root[max(x, y)] = min(x, y)
                yield other, tid


def _verified(rows: DataFrame) -> DataFrame:
    """Links among rows (grp, side 0 or 1, tid, comp, skip, text): left texts of a
    group against its right ones.  Rows stream; only the left block is held."""
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, block, left = None, None, []
        for batch in batches:
            doc, s, c = B.shingles(*B.text_bytes(batch.column("text")))
            cut = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(batch)))))
            grp, side, tid, comp, skip = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("grp", "side", "tid", "comp", "skip"))
            a, b = [], []
            for i in range(len(batch)):
                if grp[i] != group:
                    group, block, left = grp[i], None, []
                own = (s[cut[i] : cut[i + 1]], c[cut[i] : cut[i + 1]])
                if not len(own[0]):
                    continue
                if side[i] == 0:
                    left.append((int(tid[i]), int(comp[i]), (own[0].copy(), own[1].copy())))
                    continue
                if block is None:
                    block = _Block(*(list(x) for x in zip(*left))) if left else _Block([], [], [])
                for x, y in block.links(int(tid[i]), int(comp[i]), int(skip[i]), *own) if left else ():
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    placed = rows.repartition("grp").sortWithinPartitions("grp", "side")
    return placed.select("grp", "side", "tid", "comp", "skip", "text").mapInArrow(run, "a long, b long")


def _identified(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"_tid": F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)), "_key": F.unhex(F.md5(text))})


def _perhaps(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """rows (_tid, _key, text) whose _tid may be among asked (tid): a bitmap of
    FILTER_BITS hashed ids keeps most other texts out of the shuffle that decides."""
    place = lambda c: F.xxhash64(c).bitwiseAND(F.lit(FILTER_BITS - 1))
    word = asked.select(place("tid").alias("p")).groupBy(F.shiftright("p", 6).alias("w"))
    found = word.agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toPandas()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[found["w"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    sent = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("p").to_numpy()
            kept = (sent.value[p >> 6] >> (p & 63)) & 1
            yield batch.select(["_tid", "_key", "text"]).filter(pa.array(kept.astype(bool)))

    return rows.select("_tid", "_key", "text", place("_tid").alias("p")).mapInArrow(run, "_tid long, _key binary, text string")


def _by_band(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """rows joined with facts (one row for each band, with n, its texts) by band;
    hot bands' rows stay where they are."""
    hot = facts.where(F.col("n") > HOT)
    # slices of hot bands, each small enough to be sent to every executor
    slices = hot.count() // HOT_BUCKETS + 1
    cold, out = rows, None
    for k in range(slices):
        part = F.broadcast(hot if slices == 1 else hot.where(F.pmod(F.xxhash64("band", F.lit(7)), F.lit(slices)) == k))
        cold = cold.join(part.select("band"), "band", "left_anti")
        some = rows.join(part, "band")
        out = some if out is None else out.unionByName(some)
    return cold.join(facts.where(F.col("n") <= HOT), "band").unionByName(out)


def text_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts: _key, tid, rows of that tid, class_id), (rows: doc_id, _tid, _key)."""
    spark = docs.sparkSession
    bounded_batches(spark)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, s, c = B.shingles(*B.text_bytes(batch.column("text")))
            n = len(batch)
            bands = band_hashes(signatures(doc, s, c, n)).view(np.int64)
            has = np.bincount(doc, minlength=n) > 0
            cut = np.concatenate(([0], np.cumsum(has * BANDS))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(bands[has].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_tid"), batch.column("_key"), lists], names=["doc_id", "_tid", "_key", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sigs = durable(_identified(docs.select("doc_id", "text")).mapInArrow(sketch, f"doc_id {kind}, _tid long, _key binary, bands array<long>"), "sketch")
    each = sigs.groupBy("_key", "_tid").agg(F.count("*").alias("rows"))
    texts = durable(each.groupBy("_key").agg(F.min("_tid").alias("tid"), F.min_by("rows", "_tid").alias("rows")), "texts")
    # one sketch for each text: that of its least id
    own = sigs.join(texts.select("_key", F.col("tid").alias("_tid"), "rows"), ["_key", "_tid"])
    own = own.where("rows = 1").unionByName(own.where("rows > 1").dropDuplicates(["_key", "_tid"]))
    banded = durable(own.select(F.col("_tid").alias("tid"), F.explode("bands").alias("band")), "banded")
    buckets = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("tid").alias("rep"), F.bit_xor(F.xxhash64("tid")).alias("who")).where("n > 1")
    # bands that gather the same texts ask the same questions: one of them stays
    buckets = buckets.groupBy("who", "n", "rep").agg(F.min("band").alias("band"))
    buckets = durable(buckets.select("band", "n", "rep"), "buckets")
    members = durable(_by_band(banded, buckets), "members")
    discard(banded)
    asked = members.select("tid").distinct()
    bodies = _perhaps(_identified(docs.select("doc_id", "text")), asked).select(F.col("_tid").alias("tid"), "_key", "text")
    bodies = bodies.join(asked, "tid", "left_semi").join(texts.select("_key", "tid"), ["_key", "tid"], "left_semi")
    bodies = durable(bodies.dropDuplicates(["tid", "_key"]).select("tid", "text"), "bodies")

    star = members.where("tid <> rep").groupBy("rep", "tid").agg(F.max("n").alias("n"))
    star = star.withColumn("parts", F.ceil(F.col("n") / RIGHT)).withColumn("part", F.pmod(F.xxhash64("tid"), "parts"))
    key = F.xxhash64("rep", "parts", "part").alias("grp")
    right = star.select(key, F.lit(1).alias("side"), "tid", F.col("tid").alias("comp"))
    left = star.select(key, F.lit(0).alias("side"), F.col("rep").alias("tid"), F.col("rep").alias("comp")).distinct()
    found = durable(_verified(left.unionByName(right).withColumn("skip", F.lit(-1 << 63)).join(bodies, "tid")), "links")
    joined = durable(components(found), "joined")

    placed = members.where("n > 2").join(joined, members.tid == joined.id, "left").select("band", "n", "rep", "tid", F.coalesce("component", "tid").alias("comp"))
    placed = durable(placed, "placed")
    open_ = placed.groupBy("band", "n").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band", "n")
    placed_open = durable(_by_band(placed.drop("n"), durable(open_, "bands")), "open")
    sizes = placed_open.groupBy("band", "n", "comp").agg(F.count("*").alias("c"))
    main = sizes.groupBy("band", "n").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.sum("c").alias("all"), F.max("c").alias("most"))
    main = main.select("band", "n", "main", F.ceil((F.col("all") - F.col("most")) / LEFT).alias("lefts"), F.ceil(F.col("all") / RIGHT).alias("rights"))
    cross = _by_band(placed_open.drop("n"), durable(main, "mains"))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = cross.where("comp <> main").withColumn("l", F.pmod(F.xxhash64("tid"), "lefts")).withColumn("r", spread("rights")).withColumn("side", F.lit(0))
    right = cross.withColumn("r", F.pmod(F.xxhash64("tid"), "rights")).withColumn("l", spread("lefts")).withColumn("side", F.lit(1))
    both = left.unionByName(right).select(F.xxhash64("band", "l", "r").alias("grp"), "side", "tid", "comp", F.col("rep").alias("skip"))
    more = durable(_verified(both.join(bodies, "tid")), "links")

    # rows of one id are one document: their texts join too
    shared = sigs.select("_tid", "_key").distinct().groupBy("_tid").agg(F.count("*").alias("k")).where("k > 1").select("_tid")
    same = sigs.join(shared, "_tid", "left_semi").join(texts, "_key").select(F.col("_tid").alias("a"), F.col("tid").alias("b"))
    final = components(joined.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more).unionByName(same))
    out = texts.join(final, texts.tid == final.id, "left").select("_key", "tid", "rows", F.coalesce("component", "tid").alias("class_id"))
    out = durable(out, "classes")
    for done in (buckets, members, bodies, found, joined, placed, placed_open, more, texts):
        discard(done)
    return out, sigs.select("doc_id", "_tid", "_key")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (least id of the class), class_size for every row of docs."""
    texts, rows = text_classes(docs)
    sizes = rows.groupBy("_key").agg(F.count("*").alias("n")).join(texts, "_key")
    total = sizes.groupBy("class_id").agg(F.sum("n").alias("class_size"))
    named = texts.join(total, "class_id").select("_key", "class_id", "class_size")
    return rows.join(named, "_key").select("doc_id", "class_id", "class_size")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs with the least id of their class, one row for each class."""
    texts, _ = text_classes(docs)
    kept = texts.where("tid = class_id").groupBy(F.col("tid").alias("_tid")).agg(F.min(F.struct("_key", "rows")).alias("k")).select("_tid", "k._key", "k.rows")
    plain, back = plain_names(docs, ("doc_id", "text"))
    found = _identified(plain).join(kept, ["_key", "_tid"])
    return back(found.where("rows = 1")).unionByName(back(found.where("rows > 1").dropDuplicates(["_key", "_tid"])))
