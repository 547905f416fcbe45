"""Source divergence audit: how far a source's words are from other sources of its language.

Terms are maximal runs of ASCII letters and non-ASCII characters, A-Z lowered.  They
are counted in numpy, a block of texts at a time, by length: a term of at most 8
bytes is one big-endian uint64, of at most 16 bytes two; blocks of these are sorted
by radix (stable passes over 16-bit digits) and their runs counted.  Longer terms
lie in buckets by the power of two above their length, each sorted as bytes.  A
block gives a row for each (language, source, term); Spark sums the rows, with
partial sums before the shuffle.

A language keeps the terms that `min_docs` of its documents hold.  With V of them, a
group's (or the whole language's) share of a term with `count` occurrences is
1 + floor(10**9 * (count + 5) / (N + 5 * V)), N being the sum of its counts.

* `pair`: for each two sources of a language the sum of |p - q| over all kept terms.
  Terms that neither source has all differ by the same amount, so only the others
  are visited.  Sources are cut into tiles and terms into buckets; a task compares
  two tiles in one bucket as dense matrices, and Spark adds what the buckets give.
* `term`: a group's `top` terms by how far its share is above its language's.

All arithmetic is on whole numbers (64-bit sums, 38-digit products).

Defined cases: null text, lang and source are ''.  A group without terms takes part
with counts of zero.  A language without kept terms has pairs of value 0 and no
terms.  A language of one source has no pairs.  Repeated rows are documents each.
Ties go to the lesser item by UTF-8.  Texts are read whole; a block is a text at
least.  No rows give no rows.  Other columns of docs are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import bytesops as B
from graphloom.llm.common import bounded_batches, durable

BLOCK_BYTES = 16 << 20
TILE_SOURCES = 64
BUCKET_TERMS = 4096
SCALE = 10**9

_TERM = np.zeros(256, bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
#: The first k bytes of a big-endian word.
_FIRST = np.array([0, *((0xFFFFFFFFFFFFFFFF << (8 * (8 - k))) & 0xFFFFFFFFFFFFFFFF for k in range(1, 9))], np.uint64)


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, text) of every term of the texts, in order."""
    inside = _TERM[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[1:-1][offsets[1:-1] < len(data)]
    begins[cuts] = inside[cuts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = cuts[cuts > 0] - 1
    ends[cuts] = inside[cuts]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1 - start, np.searchsorted(offsets, start, "right") - 1


def radix_order(words: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """The order by words (first one first), stable on the order that is given."""
    for word in reversed(words):
        for shift in (0, 16, 32, 48):
            digit = ((word >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)[order]
            if digit.size and (digit != digit[0]).any():
                order = order[np.argsort(digit, kind="stable")]  # numpy sorts 16-bit keys by radix
    return order


def runs(changes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, length, distinct texts) of the runs that begin at `changes`; text is ascending in each."""
    at = np.flatnonzero(changes)
    new = changes.copy()
    new[1:] |= text[1:] != text[:-1]
    return at, np.diff(np.append(at, len(text))), np.add.reduceat(new.astype(np.int64), at)


def counted(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]]:
    """(group, term, occurrences, texts that hold it) of the texts' terms; group has a
    small number for each text."""
    data = B.LOWER[data]
    start, length, text = spans(data, offsets)
    of = group[text]
    padded = np.concatenate((data, np.zeros(16, np.uint8)))
    word = np.ndarray((len(data) + 8,), ">u8", padded, 0, (1,))  # the eight bytes from each place
    width = np.where(length <= 8, 8, np.where(length <= 16, 16, 1 << np.ceil(np.log2(np.maximum(length, 2))).astype(np.int64)))
    for size in np.unique(width):
        pick = np.flatnonzero(width == size)
        s, n, t, g = start[pick], length[pick], text[pick], of[pick]
        # equal terms are ordered by group, then by text
        order = np.argsort(g.astype(np.uint16), kind="stable")
        if size <= 16:
            words = [word[s].astype(np.uint64) & _FIRST[np.minimum(n, 8)]]
            if size == 16:
                words.append(word[s + 8].astype(np.uint64) & _FIRST[n - 8])
            order = radix_order(words, order)
            keys = [w[order] for w in words]
        else:
            raw = data.tobytes()
            each = np.array([raw[a : a + k] for a, k in zip(s.tolist(), n.tolist())], f"S{size}")
            order = order[np.argsort(each[order], kind="stable")]
            keys = [each[order]]
        g, t = g[order], t[order]
        changes = np.ones(len(g), bool)
        changes[1:] = g[1:] != g[:-1]
        for key in keys:
            changes[1:] |= key[1:] != key[:-1]
        first, many, texts = runs(changes, t)
        s, n = s[order][first], n[order][first]
        yield g[first], [bytes(data[a : a + k]) for a, k in zip(s.tolist(), n.tolist())], many, texts


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together up to BLOCK_BYTES."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= BLOCK_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, texts); every (lang, source) also has a row of term '' and zeros."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches):
            seen: dict[tuple[str, str], int] = {}
            pairs = zip(table.column("lang").to_pylist(), table.column("source").to_pylist())
            group = np.array([seen.setdefault(pair, len(seen)) for pair in pairs], np.int64)
            langs, sources = (pa.array([k[i] for k in seen]) for i in (0, 1))

            def rows(g: np.ndarray, terms: list[bytes], n: np.ndarray, texts: np.ndarray) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([langs.take(pa.array(g)), sources.take(pa.array(g)), pa.array(terms, pa.binary()), pa.array(n, pa.int64()), pa.array(texts, pa.int64())], names=["lang", "source", "term", "n", "texts"])

            none = np.zeros(len(seen), np.int64)
            yield rows(np.arange(len(seen)), [b""] * len(seen), none, none)
            # group numbers must fit a 16-bit digit: blocks of more groups are cut
            data, offsets = B.text_bytes(table.column("text"))
            for low in range(0, len(seen), 1 << 16):
                part = (group >= low) & (group < low + (1 << 16))
                if part.all():
                    own, at, of = data, offsets, group
                else:
                    own, at = B.text_bytes(table.column("text").filter(pa.array(part)))
                    of = group[part]
                if len(own):
                    for g, terms, n, texts in counted(own, at, of - low):
                        yield rows(g + low, terms, n, texts)

    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    found = docs.select(text("lang"), text("source"), text("text")).mapInArrow(run, "lang string, source string, term binary, n long, texts long")
    found = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))
    return found.withColumn("term", F.col("term").cast("string"))


def share(n: Column | str, total: Column | str, terms: Column | str) -> Column:
    """1 + floor(10**9 * (n + 5) / (total + 5 * terms)), exactly."""
    whole = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")
    top = (F.lit(SCALE).cast("decimal(10,0)") * (whole(n) + 5).cast("decimal(20,0)")).cast("decimal(31,0)")
    below = (whole(total) + whole(terms) * 5).cast("decimal(21,0)")
    return F.call_function("div", top, below).cast("long") + 1


def tile_distances(cells: DataFrame, tiles: int) -> DataFrame:
    """(lang, source, other, value): the sum of |p - q| over a language's terms, for each
    two of its sources.

    cells: lang, source, bucket, term, p, base, terms; each (source, bucket) has a row of
    term null.  All terms add |base - other base| (in bucket 0); a term that one of the
    two sources has, or another of the tiles, adds what it differs by from that.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, i, j, bucket = key
        sources = rows[rows["term"].isna()]
        held = rows[rows["term"].notna()]
        term, names = pd.factorize(held["term"])
        place = {s: k for k, s in enumerate(sources["source"])}
        base, terms = sources["base"].to_numpy(np.int64), sources["terms"].to_numpy(np.int64)
        p = np.repeat(base[:, None], max(len(names), 1), 1)
        p[held["source"].map(place).to_numpy(np.int64), term] = held["p"].to_numpy(np.int64)
        tile, name, out = sources["tile"].to_numpy(), sources["source"].to_numpy(), []
        for a in np.flatnonzero(tile == i):
            others = np.flatnonzero(tile == j)
            others = others[others > a] if i == j else others
            if len(others):
                value = np.abs(p[others] - p[a])[:, : len(names)].sum(1)
                value += ((terms[a] if bucket == 0 else 0) - len(names)) * np.abs(base[others] - base[a])
                out.append(pd.DataFrame({"lang": key[0], "source": name[a], "other": name[others], "value": value}))
        return pd.concat(out) if out else pd.DataFrame(columns=["lang", "source", "other", "value"], dtype=object)

    tiled = cells.withColumn("tile", F.pmod(F.xxhash64("source"), F.lit(tiles)))
    # tile t meets each tile u once, as (least, greatest)
    every = F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))
    met = tiled.withColumn("u", F.explode(every)).select("*", F.least("tile", "u").alias("i"), F.greatest("tile", "u").alias("j"))
    found = met.groupBy("lang", "i", "j", "bucket").applyInPandas(run, "lang string, source string, other string, value long")
    ways = F.inline(F.array(F.struct("source", "other"), F.struct(F.col("other").alias("source"), F.col("source").alias("other"))))
    return found.groupBy("lang", "source", "other").agg(F.sum("value").alias("value")).select("lang", ways, "value")


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank); see the module."""
    counts = durable(term_counts(docs), "terms")
    words = counts.where("term <> ''")
    kept = words.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("texts").alias("texts")).where(F.col("texts") >= min_docs).drop("texts")
    kept = durable(kept, "kept")
    lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    cells = words.drop("texts").join(kept, ["lang", "term"])
    total = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term = ''").select("lang", "source").join(total, ["lang", "source"], "left").join(lang, "lang", "left")
    groups = durable(groups.na.fill(0, ["total", "terms", "lang_total"]).withColumn("base", F.when(F.col("terms") > 0, share(F.lit(0), "total", "terms")).otherwise(0)), "groups")
    cells = cells.join(groups, ["lang", "source"]).withColumn("p", share("n", "total", "terms"))

    over = F.col("p") - share("lang_n", "lang_total", "terms")
    term = cells.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), over.alias("value")).where("value > 0")

    most = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.max("terms").alias("terms")).agg(F.max("sources").alias("s"), F.max("terms").alias("t")).first()
    tiles, buckets = (most.s or 0) // TILE_SOURCES + 1, (most.t or 0) // BUCKET_TERMS + 1
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long")))
    some = groups.select("lang", "source", each.alias("bucket"), F.lit(None).cast("string").alias("term"), F.col("base").alias("p"), "base", "terms")
    held = cells.select("lang", "source", bucket.alias("bucket"), "term", "p", "base", "terms")
    pair = tile_distances(held.unionByName(some), tiles).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = term.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pair.withColumn("rank", F.row_number().over(order)).unionByName(best)
