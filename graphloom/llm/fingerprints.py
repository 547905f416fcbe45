"""Document fingerprints by I-Match, with DataFrame operations only.

Terms are words (lower case), compared by a 64-bit hash.  The lexicon holds
the terms of the chosen inverse-document-frequency band, log(N / df) from
`idf_from` to `idf_to`, counted over all documents.  Each of its terms is in at least N / e**idf_to documents,
so it has at most (distinct words of a document, on average) * e**idf_to terms,
however many documents there are.  Up to IN_PLAN of them stand in the plan as a hash
table; a larger lexicon is a table that the terms are joined with.  Of it,
randomised subsets are drawn: at scale s
eight disjoint ones, each with 2**-s of the lexicon, so that short and long
texts both have subsets that a small edit leaves alone.  A text's distinct
lexicon terms are sorted, and each subset's part of them is hashed.

Likeness of two fingerprints: the share of equal hashes among the subsets that
hold a term of either.  A text without any such term is fingerprinted by the
hash of the whole text, and is like its equals (1) only.

Defined cases: null text counts as empty.  Null ids come first in the order;
rows of equal id are ordered by the text's hash, and rows equal in both follow each
other; a lone document is its own next; no rows give none.  Texts of any length
are read whole.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import durable, fresh, small_table

SCALES, EACH = (3, 5, 7, 9), 8
#: Where each scale's bits stand in a term's hash, and where those of its slot begin.
OFFSETS, SLOT_BITS = {3: 0, 5: 3, 7: 8, 9: 15}, 24
IN_PLAN = 1 << 16
BLOCK_ROWS, BLOCKS, COARSE = 512, 1 << 20, 1 << 10


def hashed_terms(text: Column) -> Column:
    """Distinct hashes of a text's words, unsorted (text before, between and after
    white space, so a leading space adds the empty word)."""
    words = F.split(F.lower(text), r"[\x20\x09-\x0D]+")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


@dataclass
class Lexicon:
    terms: DataFrame  # term long: those in the band
    frequent: DataFrame  # term long: those in more documents, at most (words of a document) * e**idf_from
    slots: list[list[int]] | None  # the terms by their slot; None: too many for the plan


def lexicon(docs: DataFrame, idf_from: float = 3.0, idf_to: float = 7.0) -> Lexicon:
    n = docs.count()
    low, high = n * float(np.exp(-idf_to)), max(n * float(np.exp(-idf_from)), 1.0)
    term = docs.select(F.explode(hashed_terms(F.coalesce("text", F.lit("")))).alias("term"))
    counted = durable(term.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= low), "lexicon")
    terms, frequent = counted.where(F.col("df") <= high).select("term"), counted.where(F.col("df") > high).select("term")
    size = terms.count()
    if size > IN_PLAN:
        return Lexicon(terms, frequent, None)
    slots: list[list[int]] = [[] for _ in range(1 << max(size // 2, 1).bit_length())]
    for (t,) in terms.collect():
        slots[(t >> SLOT_BITS) & (len(slots) - 1)].append(t)
    return Lexicon(terms, frequent, slots)


def with_terms(rows: DataFrame, text: str, out: str, lex: Lexicon) -> DataFrame:
    """rows with `out`, the sorted lexicon terms of a text."""
    if lex.slots is not None:
        table = F.from_json(F.lit(json.dumps(lex.slots)), "array<array<bigint>>")
        slot = lambda h: F.shiftright(h, SLOT_BITS).bitwiseAND(F.lit(len(lex.slots) - 1)).cast("int")
        return rows.withColumn(out, F.sort_array(F.filter(hashed_terms(F.col(text)), lambda h: F.array_contains(F.element_at(table, slot(h) + 1), h))))
    (row,) = fresh(rows.columns, "row")
    numbered = durable(rows.withColumn(row, F.monotonically_increasing_id()), "texts")
    each = numbered.select(row, F.explode(hashed_terms(F.col(text))).alias("term"))
    # without the words that are in very many texts no key of the join is hot
    found = each.join(F.broadcast(lex.frequent), "term", "left_anti").join(lex.terms, "term").groupBy(row).agg(F.sort_array(F.collect_list("term")).alias(out))
    return numbered.join(found, row, "left").withColumn(out, F.coalesce(out, F.array().cast("array<bigint>"))).drop(row)


def subset_hashes(frame: DataFrame, terms: str, out: str) -> DataFrame:
    """Adds array column `out`: the hash of each subset's terms, null where it has none."""

    def chosen(column: str, scale: int, k: int | None) -> Column:
        """Terms whose `scale` bits are k; None: below EACH."""
        bits, low = (1 << scale) - 1, OFFSETS[scale]
        mask, want = (bits & ~(EACH - 1), 0) if k is None else (bits, k)
        return F.filter(column, lambda h: h.bitwiseAND(F.lit(mask << low)) == F.lit(want << low))

    frame = frame.withColumns({f"_s{s}": chosen(terms, s, None) for s in SCALES})
    frame = frame.withColumn("_parts", F.array(*[chosen(f"_s{s}", s, k) for s in SCALES for k in range(EACH)]))
    hashed = F.transform("_parts", lambda p: F.when(F.size(p) > 0, F.xxhash64(p)))
    return frame.withColumn(out, hashed).drop("_parts", *[f"_s{s}" for s in SCALES])


def likeness(a: Column, b: Column, text_a: Column, text_b: Column) -> Column:
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: F.coalesce(e, F.lit(False))))
    any_ = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.isNotNull() | y.isNotNull()), lambda e: e))
    return F.when(any_ > 0, same / any_).otherwise((text_a == text_b).cast("double"))


def as_text(hashes: Column, text: Column) -> Column:
    parts = F.transform(hashes, lambda h: F.coalesce(F.lpad(F.lower(F.hex(h)), 16, "0"), F.lit("-")))
    return F.when(F.exists(hashes, lambda h: h.isNotNull()), F.concat_ws(".", parts)).otherwise(F.concat(F.lit("text."), F.lower(F.hex(text))))


def _not_after(bound: Column, id_: Column, tie: Column) -> Column:
    """Whether a block's bound stands at or before a row, nulls first."""
    b, t = bound.getField("i"), bound.getField("t")
    return F.when(b.isNull(), id_.isNotNull() | (t <= tie)).otherwise(id_.isNotNull() & ((b < id_) | ((b == id_) & (t <= tie))))


def _place(bounds: Column, longest: int, id_: Column, tie: Column) -> Column:
    """How many of the sorted bounds, `longest` at most, stand at or before a row."""

    def step(found: Column, jump: Column) -> Column:
        reached = found + jump
        return F.when((reached <= F.size(bounds)) & _not_after(F.get(bounds, reached - 1), id_, tie), reached).otherwise(found)

    jumps = F.array(*[F.lit(1 << k) for k in range(longest.bit_length() - 1, -1, -1)])
    return F.aggregate(jumps, F.lit(0), step) if longest else F.lit(0)


def with_blocks(docs: DataFrame, id_column: str, tie: str) -> tuple[DataFrame, int]:
    """docs with `_block`, ascending in (id, tie), and the largest block.

    The bounds are rows themselves, about one of BLOCK_ROWS by a hash (BLOCKS of
    them at most are expected, so blocks grow only beyond 500 million rows), so that
    blocks are even however ids are spread.  Each bound opens a block that has a row; block 0
    may have none.  About COARSE of the bounds, in the plan, lead a row to the list of
    bounds among which it stands, in a broadcast table of at most BLOCKS bounds; both are
    searched by halves.
    """
    i, t = F.col(id_column), F.col(tie)
    number = lambda salt, m: F.pmod(F.xxhash64("i", "t", F.lit(salt)), F.lit(m)) == 0
    rows = docs.select(i.alias("i"), t.alias("t"))
    bounds = durable(rows.where(number("bound", max(BLOCK_ROWS, -(-docs.count() // BLOCKS)))).distinct(), "bounds")
    n = bounds.count()
    if not n:
        return docs.withColumn("_block", F.lit(0)), 0
    coarse = sorted(((r.i, r.t) for r in bounds.where(number("coarse", -(-n // COARSE)) & F.lit(n > COARSE)).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    kind = docs.schema[id_column].dataType.simpleString()
    table = F.from_json(F.lit(json.dumps([{"i": i_, "t": t_} for i_, t_ in coarse])), f"array<struct<i:{kind},t:bigint>>")
    bounds = bounds.withColumn("_part", _place(table, len(coarse), F.col("i"), F.col("t")))
    sizes = sorted((r["_part"], r["count"]) for r in bounds.groupBy("_part").count().collect())
    starts = small_table(docs.sparkSession, [(p, sum(m for q, m in sizes if q < p)) for p in range(len(coarse) + 1)], "_part int, _start int")
    lists = bounds.groupBy("_part").agg(F.sort_array(F.collect_list(F.struct("i", "t"))).alias("_bounds"))
    lists = starts.join(lists, "_part", "left").withColumn("_bounds", F.coalesce("_bounds", F.array().cast(f"array<struct<i:{kind},t:bigint>>")))
    found = docs.withColumn("_part", _place(table, len(coarse), i, t)).join(F.broadcast(lists), "_part")
    block = F.col("_start") + _place(F.col("_bounds"), max(m for _, m in sizes), i, t)
    return found.withColumn("_block", block).drop("_part", "_start", "_bounds"), n


def with_next(docs: DataFrame, finish: Callable[[DataFrame], DataFrame], columns: list[str], id_column: str, tie: str) -> DataFrame:
    """finish(docs) with `next`, the struct of `columns` of its next row by (id, tie);
    after the last comes the first.  A block of rows also gets the first row of the
    block after it, so that no order over all rows is needed.  finish adds columns
    row by row."""
    placed, last = with_blocks(docs, id_column, tie)
    whole = F.struct(*[c for c in placed.columns if c != "_block"])
    order = F.struct(F.col(id_column).isNotNull().alias("a"), F.col(id_column).alias("b"), F.col(tie).alias("c"))
    first = placed.groupBy("_block").agg(F.min_by(whole, order).alias("r"))
    low = placed.agg(F.min("_block")).first()[0]
    before = F.when(F.col("_block") == low, last).otherwise(F.col("_block") - 1)
    guests = first.select("r.*", before.alias("_block"), F.lit(True).alias("_guest"))
    rows = finish(placed.withColumn("_guest", F.lit(False))).unionByName(finish(guests))
    line = Window.partitionBy("_block").orderBy("_guest", F.col(id_column).asc_nulls_first(), tie)
    return rows.withColumn("next", F.lead(F.struct(*columns)).over(line)).where("not _guest").drop("_block", "_guest")


def fingerprints(docs: DataFrame, idf_from: float = 3.0, idf_to: float = 7.0) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next for every row of docs (see the module)."""
    lex = lexicon(docs, idf_from, idf_to)
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumns({"n_chars": F.char_length("text").cast("long"), "h": F.xxhash64("text")})

    def printed(rows: DataFrame) -> DataFrame:
        return subset_hashes(with_terms(rows, "text", "terms", lex), "terms", "print").drop("terms")

    rows = with_next(base, printed, ["text", "print", "h"], "doc_id", "h")
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring("next.text", F.lit(1), quarter))
    rows = rows.select("doc_id", "n_chars", "print", "h", F.col("next.print").alias("next_print"), F.col("next.h").alias("next_h"), edited.alias("edited"))
    rows = rows.withColumns({"edited_sha256": F.sha2("edited", 256), "edited_h": F.xxhash64("edited")})
    rows = with_terms(rows, "edited", "terms", lex).drop("edited")
    rows = subset_hashes(rows, "terms", "edited_print")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("print"), F.col("h")).alias("fingerprint"),
        as_text(F.col("edited_print"), F.col("edited_h")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print"), F.col("h"), F.col("edited_h")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print"), F.col("h"), F.col("next_h")).alias("near_next"),
    )
