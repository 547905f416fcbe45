"""LM scoring by context-tree weighting over bytes.

A text is its UTF-8 bytes (A-Z lowered) and one end symbol, 0xFF, which UTF-8
never holds; before the text stand `depth` more of them.  Each byte is eight
binary decisions, the high bit first.  A decision's estimate mixes, over all
depths of its context tree, the Krichevsky-Trofimov estimates of its contexts: at
a node, KT has the weight Pe / (Pe + product of the children's weighted
probabilities), with equal priors and both from the training counts, and the
child has what is left.  A context never seen says one half.

The tree holds every context of up to `depth` bytes of the training texts, so it
grows with them; it is a table, never a driver's or a worker's object.  Its
counts are those of the distinct grams (a context and its symbol).  The two
deepest levels are computed by the task that has their common ancestor (2**24
grams at most, whatever the input), the next ones by grouping, and the driver
sees the contexts of depth - 4 bytes only (256 at depth 5).  The result is the
log probability of each gram.

Scoring looks grams up.  Those with at least `gram_share` of all positions, and
words with at least `word_share` of all words, are sent to the workers (1 / share
of them at most); every other one is joined by its key, which no more than that
share of the positions hold.

The base model counts words in all training texts.

Defined cases: null text counts as empty and has only the end.  Texts above a
megabyte are worked on in pieces, each of which knows the bytes before it, so a
length changes no score.  Each row of docs gives a row, equal ones too.  Empty
tables: no rows.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import bytesops as B
from graphloom.llm.common import bounded_batches, discard, durable

DEPTH = 5
END = 255
END_WORD = np.array([0x5EED0E4D], np.uint64)
WORD, GRAM = 0, 1
HELD = 1_500_000  # keys that a task merges before it gives them out
U = np.uint64


def coded(data: np.ndarray, offsets: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grams, document) of every position: a symbol in the lowest byte, under it
    in the next ones its context, the nearest byte first."""
    for part, bounds, docs, ends, before in B.pieces(data, offsets, reach=depth):
        segments = len(bounds) - 1
        owner = np.repeat(np.arange(segments), np.diff(bounds))
        out = np.full(len(part) + segments * (depth + ends), END, np.int64)
        at = np.arange(len(part)) + (depth + ends) * owner + depth
        out[at] = B.LOWER[part]
        out[depth - len(before) : depth] = B.LOWER[before]
        if ends:
            at = np.concatenate([at, bounds[1:] + (depth + 1) * np.arange(1, segments + 1) - 1])
            owner = np.concatenate([owner, np.arange(segments)])
        code = out.copy()
        for j in range(1, depth + 1):
            code[j:] |= out[:-j] << (8 * j)
        yield code[at], docs[owner]


# --- the tree -----------------------------------------------------------------
# A decision is a context (of `level` bytes) and one of the 255 inner nodes of a
# symbol's eight bits, in one integer: context << 8 | node.


def _parent(key, level: int):  # noqa: ANN001, ANN202
    """Of a decision of `level`: that of the context without its oldest byte."""
    return ((key >> 8) & ((1 << 8 * (level - 1)) - 1)) << 8 | (key & 255)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x > 0: eight steps up, then Stirling's series."""
    shift = np.ones_like(x)
    for j in range(8):
        shift = shift * (x + j)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1) - 1.1447298858494002


def _own_share(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(below - _log_kt(zeros, ones), -700, 700)))


@dataclass
class Level:
    """Distinct decisions of one level: zeros, ones, and the log of the product
    of the children's weighted probabilities (None at the deepest level)."""

    key: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    below: np.ndarray | None

    def weighted(self) -> np.ndarray:
        kt = _log_kt(self.zeros, self.ones)
        return kt if self.below is None else np.logaddexp(kt, self.below) - np.log(2)

    def up(self, level: int) -> tuple[Level, np.ndarray]:
        """The level above, and the place in it of each decision's parent."""
        key, at = np.unique(_parent(self.key, level), return_inverse=True)
        sums = [np.bincount(at, x, len(key)) for x in (self.zeros, self.ones, self.weighted())]
        return Level(key, *sums), at

    def mixed(self, above: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What contexts up to this level say of a one, and the weight left below."""
        one = (self.ones + 0.5) / (self.zeros + self.ones + 1)
        if self.below is None:
            return above + weight * one, weight * 0
        share = _own_share(self.zeros, self.ones, self.below)
        return above + weight * share * one, weight * (1 - share)


def decisions(gram: np.ndarray, n: np.ndarray) -> tuple[Level, np.ndarray, np.ndarray]:
    """The deepest level of these grams; the eight decisions and bits of each."""
    symbol = gram & 255
    node = np.stack([(256 | symbol) >> (8 - k) for k in range(8)])
    bit = np.stack([symbol >> (7 - k) & 1 for k in range(8)])
    key, at = np.unique(((gram >> 8) << 8) | node, return_inverse=True)
    at = at.reshape(node.shape)
    count = np.broadcast_to(n, bit.shape)
    ones = np.bincount(at.ravel(), (count * bit).ravel(), len(key))
    zeros = np.bincount(at.ravel(), (count * (1 - bit)).ravel(), len(key))
    return Level(key, zeros, ones, None), at, bit


def _whole_groups(batches: Iterator[pa.RecordBatch], column: str, least: int = 50_000) -> Iterator[dict[str, np.ndarray]]:
    """Rows sorted by `column`, in blocks that cut no group of it."""
    held: list[pa.RecordBatch] = []

    def arrays(table: pa.Table) -> dict[str, np.ndarray]:
        return {c: table.column(c).to_numpy() for c in table.column_names}

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= least:
            table = pa.Table.from_batches(held)
            group = table.column(column).to_numpy()
            cut = int(np.searchsorted(group, group[-1], "left"))
            if cut:
                yield arrays(table.slice(0, cut))
            held = table.slice(cut).to_batches()
    if held and sum(map(len, held)):
        yield arrays(pa.Table.from_batches(held))


def _sql_lgamma(x: Column) -> Column:
    shift = x
    for j in range(1, 8):
        shift = shift * (x + j)
    y = x + 8
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - F.log(shift)


def _sql_kt() -> Column:
    zeros, ones = F.col("zeros"), F.col("ones")
    return _sql_lgamma(zeros + 0.5) + _sql_lgamma(ones + 0.5) - _sql_lgamma(zeros + ones + 1) - 1.1447298858494002


def _sql_up(rows: DataFrame, level: int) -> DataFrame:
    """Decisions (key, zeros, ones, below) of `level` to those of the level above."""
    parent = F.shiftleft(F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * (level - 1)) - 1)), 8).bitwiseOR(F.col("key").bitwiseAND(F.lit(255)))
    kt = rows.withColumn("kt", _sql_kt())
    weighted = F.greatest("kt", "below") + F.log1p(F.exp(-F.abs(F.col("kt") - F.col("below")))) - float(np.log(2))
    return kt.groupBy(parent.alias("key")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum(weighted).alias("below"))


def _sql_mixed(rows: DataFrame, above: DataFrame, level: int) -> DataFrame:
    """(key, above, weight) of `level`, from those of the level above it."""
    parent = F.shiftleft(F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * (level - 1)) - 1)), 8).bitwiseOR(F.col("key").bitwiseAND(F.lit(255)))
    both = rows.withColumn("parent", parent).join(above.withColumnRenamed("key", "parent"), "parent").withColumn("kt", _sql_kt())
    share = 1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("below") - F.col("kt")))))
    one = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)
    return both.select("key", (F.col("above") + F.col("weight") * share * one).alias("above"), (F.col("weight") * (1 - share)).alias("weight"))


def gram_logs(grams: DataFrame, depth: int) -> DataFrame:
    """(key, value): log10 of the probability of each gram's symbol after its
    context.  grams: key, n, one row for each gram; n counts training only."""
    root = depth - 2
    top = max(0, root - 2)
    at_root = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * root) - 1))

    def upwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _whole_groups(batches, "root"):
            level = decisions(x["key"], x["n"].astype(float))[0]
            for d in (depth, depth - 1):
                level, _ = level.up(d)
            yield pa.RecordBatch.from_arrays([pa.array(level.key), pa.array(level.zeros), pa.array(level.ones), pa.array(level.below)], names=["key", "zeros", "ones", "below"])

    rooted = grams.select(at_root.alias("root"), "key", "n")
    placed = rooted.repartition("root").sortWithinPartitions("root")
    levels = {root: durable(placed.mapInArrow(upwards, "key long, zeros double, ones double, below double"), "level")}
    for d in range(root, top, -1):
        levels[d - 1] = durable(_sql_up(levels[d], d), "level")
    # 256 contexts of 255 decisions at depth 5 (2**16 at 6), whatever the input
    first = levels[top].toPandas().sort_values("key")
    chain = [(Level(*(first[c].to_numpy() for c in ("key", "zeros", "ones", "below"))), None)]
    for d in range(top, 0, -1):
        chain.append(chain[-1][0].up(d))
    above, weight = np.zeros(len(chain[-1][0].key)), np.ones(len(chain[-1][0].key))
    for i in range(len(chain) - 1, -1, -1):
        above, weight = chain[i][0].mixed(above, weight)
        if i:
            above, weight = above[chain[i][1]], weight[chain[i][1]]
    said = pa.table({"key": pa.array(chain[0][0].key, pa.int64()), "above": pa.array(above, pa.float64()), "weight": pa.array(weight, pa.float64())})
    mixed = grams.sparkSession.createDataFrame(said)
    for d in range(top + 1, root + 1):
        mixed = _sql_mixed(levels[d], mixed, d)

    def downwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _whole_groups(batches, "root"):
            gram = x["gram"]
            key, n = x["key"][gram], x["n"][gram]
            if not len(key):
                continue
            order = np.argsort(x["key"][~gram])
            above, weight = x["above"][~gram][order], x["weight"][~gram][order]
            deepest, at, bit = decisions(key, n.astype(float))
            middle, to_middle = deepest.up(depth)
            _, to_root = middle.up(depth - 1)  # the same decisions as those that came along, in order
            a, w = middle.mixed(above[to_root], weight[to_root])
            one, _ = deepest.mixed(a[to_middle], w[to_middle])
            p = np.where(bit, one[at], 1 - one[at])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.log10(p).sum(0))], names=["key", "value"])

    none = F.lit(None)
    asked = rooted.select("root", "key", "n", none.cast("double").alias("above"), none.cast("double").alias("weight"), F.lit(True).alias("gram"))
    given = mixed.select(F.shiftright("key", 8).alias("root"), "key", F.lit(0).cast("long").alias("n"), "above", "weight", F.lit(False).alias("gram"))
    both = asked.unionByName(given).repartition("root").sortWithinPartitions("root")
    out = durable(both.mapInArrow(downwards, "key long, value double"), "logs")
    for rows in levels.values():
        discard(rows)
    return out


# --- learning and scoring -----------------------------------------------------


class Lookup:
    """Values of a bounded number of keys, in open tables of a power of two slots.
    Of keys that meet in a slot the first stays, the others go to a next table; the
    few that find no place are as unknown as keys that were never given."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, tables: int = 3) -> None:
        self.tables = []
        for salt in range(1, tables + 1):
            if not len(keys):
                break
            bits = max(4, int(len(keys)).bit_length() + 1)
            slot = self._slot(keys, salt, bits)
            first = np.zeros(1 << bits, np.int64)
            first[slot[::-1]] = np.arange(len(keys))[::-1]
            own = first[slot] == np.arange(len(keys))
            table, value = np.zeros(1 << bits, U), np.full(1 << bits, np.nan)
            table[slot[own]], value[slot[own]] = keys[own], values[own]
            self.tables.append((salt, bits, table, value))
            keys, values = keys[~own], values[~own]

    @staticmethod
    def _slot(keys: np.ndarray, salt: int, bits: int) -> np.ndarray:
        return (B.mix(keys, salt) >> U(64 - bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys, nan where unknown."""
        out = np.full(len(keys), np.nan)
        todo = slice(None)
        for salt, bits, table, value in self.tables:
            k = keys[todo]
            slot = self._slot(k, salt, bits)
            hit = table[slot] == k
            out[todo] = np.where(hit, value[slot], np.nan)
            miss = np.flatnonzero(~hit)
            todo = miss if isinstance(todo, slice) else todo[miss]
            if not len(todo):
                break
        return out


@dataclass
class Model:
    total: int  # N: training tokens
    distinct: int  # V
    depth: int
    words: tuple[np.ndarray, np.ndarray]  # frequent words and their training counts
    grams: tuple[np.ndarray, np.ndarray]  # frequent grams and their log10 probability
    counts: DataFrame  # kind, key, value: all words (training count) and grams (log10 probability)
    seen: DataFrame  # key, n: all grams and their training counts


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)


def _pair(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Both columns of (key, value) rows, without a copy of the whole as rows."""
    got = rows.toArrow()
    key, value = (got.column(i).to_numpy() for i in (0, 1))
    return key.view(U), value


def learn(docs: DataFrame, held_out: Column, depth: int = DEPTH, gram_share: float = 1e-7, word_share: float = 3e-7) -> Model:
    """The model of the rows that are not held out.  The others' words and grams
    get rows too, with their count of zero, so that every one can be looked up."""
    bounded_batches(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], list] = {(kind, out): [] for kind in (WORD, GRAM) for out in (False, True)}

        def out(what: tuple[int, bool]) -> pa.RecordBatch:
            keys, counts = _merged(held[what])
            held[what].clear()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), what[0], np.int8)), pa.array(np.full(len(keys), what[1])), pa.array(keys.view(np.int64)), pa.array(counts)], names=["kind", "held", "key", "n"])

        def put(what: tuple[int, bool], keys: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(keys):
                held[what].append(np.unique(keys, return_counts=True))
                if sum(len(k) for k, _ in held[what]) > HELD:
                    held[what][:] = [_merged(held[what])]
                    if len(held[what][0][0]) > HELD * 2 // 3:  # give out only what stays large
                        yield out(what)

        for batch in batches:
            data, offsets = B.text_bytes(batch.column("text"))
            apart = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
            h, doc = B.words(data, offsets)
            for held_ in (False, True):
                yield from put((WORD, held_), np.concatenate([h[apart[doc] == held_], np.repeat(END_WORD, (apart == held_).sum())]))
            for code, doc in coded(data, offsets, depth):
                for held_ in (False, True):
                    yield from put((GRAM, held_), code[apart[doc] == held_])
        for what in held:
            if held[what]:
                yield out(what)

    found = docs.select("text", F.coalesce(held_out, F.lit(False)).alias("held")).mapInArrow(counted, "kind byte, held boolean, key long, n long")
    counts = durable(found.groupBy("kind", "key").agg(F.sum(F.when(F.col("held"), 0).otherwise(F.col("n"))).alias("n"), F.sum("n").alias("all")), "counts")
    words, grams = counts.where(F.col("kind") == WORD), counts.where(F.col("kind") == GRAM)
    n, v, every = (int(x or 0) for x in words.agg(F.sum("n"), F.count_if(F.col("n") > 0), F.sum("all")).first())
    positions = int(grams.agg(F.sum("all")).first()[0] or 0)
    logs = gram_logs(grams.select("key", "n"), depth)
    end = int(END_WORD.view(np.int64)[0])
    # at most 1 / word_share words, and the end
    hot = words.where((F.col("all") >= word_share * every) | (F.col("key") == end)).select("key", "n")
    # at most 1 / gram_share grams
    often = grams.where(F.col("all") >= gram_share * positions).select("key").join(logs, "key").select("key", F.col("value").cast("float").alias("value"))
    table = words.select(F.lit(WORD).alias("kind"), "key", F.col("n").cast("double").alias("value")).unionByName(logs.select(F.lit(GRAM).alias("kind"), "key", "value"))
    return Model(n, v, depth, _pair(hot), _pair(often), table, grams.select("key", "n"))


_READY: dict[str, tuple[Lookup, Lookup]] = {}


def score(docs: DataFrame, model: Model, learned: bool = False) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score for every row of docs.

    learned: docs are those given to learn(), held out or not, so that every gram
    is known; else the tree is asked again for grams that it has no row of."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.words, model.grams))
    depth, floor = model.depth, model.total + model.distinct + 1
    kind = docs.schema["doc_id"].dataType.simpleString()
    name = f"{id(model)}-{model.total}-{model.distinct}"

    def tables() -> tuple[Lookup, Lookup]:
        """Once for each worker process."""
        if name not in _READY:
            _READY.clear()
            words, grams = sent.value
            _READY[name] = Lookup(*words), Lookup(*grams)
        return _READY[name]

    def listed(doc: list[np.ndarray], key: list[np.ndarray], n: int) -> pa.ListArray:
        """The keys of each document."""
        d, k = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (doc, key))
        cut = np.concatenate(([0], np.cumsum(np.bincount(d, minlength=n)))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(cut), pa.array(k[np.argsort(d, kind="stable")].view(np.int64)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams = tables()
        end = float(words.get(END_WORD)[0])
        end = 0.0 if np.isnan(end) else end
        for batch in batches:
            n = len(batch)
            data, offsets = B.text_bytes(batch.column("text"))
            h, doc = B.words(data, offsets)
            c = words.get(h)
            rare = np.isnan(c)
            base = np.bincount(doc, np.where(rare, 0, np.log10((c + 1) / floor)), n) + np.log10((end + 1) / floor)
            known = np.bincount(doc, c > 0, n).astype(np.int64) + (end > 0)
            tokens = np.bincount(doc, minlength=n) + 1
            rare_words = listed([doc[rare]], [h[rare]], n)
            total, at, keys = np.zeros(n), [], []
            for code, doc in coded(data, offsets, depth):
                value = grams.get(code.view(U))
                rare = np.isnan(value)
                total += np.bincount(doc, np.where(rare, 0, value), n)
                at.append(doc[rare])
                keys.append(code[rare])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_row"), pa.array(tokens), pa.array(known), pa.array(base), pa.array(total), rare_words, listed(at, keys, n)], names=["doc_id", "_row", "n_tokens", "known", "base", "total", "words", "grams"])

    keyed = docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
    rows = durable(keyed.mapInArrow(scored, f"doc_id {kind}, _row long, n_tokens long, known long, base double, total double, words array<long>, grams array<long>"), "scored")
    word, value = F.col("kind") == WORD, F.col("value")
    # rare words and grams: no key has more than its share of the positions
    asked = rows.select("_row", F.lit(WORD).alias("kind"), F.explode("words").alias("key")).unionByName(rows.select("_row", F.lit(GRAM).alias("kind"), F.explode("grams").alias("key")))
    counts = model.counts
    if not learned:
        new = asked.where(~word).select("key").distinct().join(model.seen, "key", "left_anti").select("key", F.lit(0).cast("long").alias("n"))
        new = durable(new, "new")
        logs = gram_logs(model.seen.unionByName(new), depth).join(new.select("key"), "key")
        counts = counts.unionByName(logs.select(F.lit(GRAM).alias("kind"), "key", "value"))
    each = asked.join(counts, ["kind", "key"], "left").groupBy("_row").agg(
        F.count_if(word & (value > 0)).alias("found"),
        F.sum(F.when(word, F.log10((F.coalesce(value, F.lit(0.0)) + 1) / F.lit(float(floor)))).otherwise(0.0)).alias("logs"),
        F.sum(F.when(word, 0.0).otherwise(value)).alias("more"),
    )
    got = lambda c: F.coalesce(c, F.lit(0))
    return rows.drop("words", "grams").join(each, "_row", "left").select("doc_id", "n_tokens", (F.col("known") + got("found")).alias("n_known"), (F.col("base") + got("logs")).alias("base_score"), (F.col("total") + got("more")).alias("score"))
