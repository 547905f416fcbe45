"""Many substrings looked up in many texts, by an index of pieces.

A text is filed under every piece of one to three characters that it holds.  A needle
of three characters or more is looked up by the rarest of its pieces (by the number of
texts that hold it), a shorter one by itself; what is found is then checked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.plans.tables import discard, durable, durable_counted, growing

SIZES = (1, 2, 3)
#: Pairs that one copy of a text is checked for.
CHUNK = 512


def pieces(text: Column, sizes: tuple[int, ...] = SIZES) -> Column:
    """'' and the distinct substrings of these sizes."""

    def of(k: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.length(text) - (k - 1)), lambda i: F.substr(text, i, F.lit(k)))
        return F.when(F.length(text) >= k, each).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(F.array(F.lit("")), *map(of, sizes)))


def needle_pieces(needle: Column) -> Column:
    """The pieces of which a text must hold all: of three characters, else the needle."""
    whole = F.array(needle)
    return F.when(F.length(needle) < 3, whole).otherwise(F.array_remove(pieces(needle, (3,)), ""))


def index(texts: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(piece, id) of texts (id, text); only the pieces of `asked` (piece), if given."""
    found = texts.select("id", F.explode(pieces(F.col("text"))).alias("piece")).select("piece", "id")
    return found if asked is None else found.join(asked.select("piece").distinct(), "piece", "left_semi")


def candidates(needles: DataFrame, postings: DataFrame) -> DataFrame:
    """The columns of needles but `pieces`, and id: the texts under the rarest piece of
    each.  Rows of needles must be distinct."""
    keys = [c for c in needles.columns if c != "pieces"]
    often = postings.groupBy("piece").agg(F.count("*").alias("n"))
    asked = needles.select(*keys, F.explode("pieces").alias("piece")).join(often, "piece", "left")
    # a piece that no text holds is the rarest, and finds nothing
    rarest = asked.groupBy(*keys).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("r"))
    return rarest.where("r.n > 0").select(*keys, F.col("r.piece").alias("piece")).join(growing(postings), "piece").drop("piece")


def checked(pairs: DataFrame, texts: DataFrame, fits: Callable[[Column, Column], Column], chunk: int = CHUNK) -> DataFrame:
    """The pairs (id, ...) for which fits(struct of the other columns, text) is true.

    A text (id, text) is joined once for about `chunk` of its pairs, not once for each.
    """
    others = [c for c in pairs.columns if c != "id"]
    sizes = pairs.groupBy("id").agg(F.floor(F.count("*") / chunk + 1).alias("_chunks"))
    dealt = pairs.join(growing(sizes), "id").withColumn("_chunk", F.pmod(F.xxhash64(*others), F.col("_chunks")))
    together = dealt.groupBy("id", "_chunk").agg(F.collect_list(F.struct(*others)).alias("_items"))
    read = together.join(growing(texts.select("id", F.col("text").alias("_text"))), "id")
    return read.select("id", F.inline(F.filter("_items", lambda x: fits(x, F.col("_text")))))


def holding(texts: DataFrame, needles: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """(needle, id) of every text (id, text) that holds a needle, in any number of places.

    `postings` is an index() of these texts that was stored before; else one of the
    needles' pieces is made.  Null texts and needles meet nothing; repeated needles
    count once; the empty needle is in every text.
    """
    texts = texts.where("text is not null")
    written, n = durable_counted(needles.select("needle").where("needle is not null").distinct(), "needles")
    if not n:
        discard(written)
        return texts.sparkSession.createDataFrame([], StructType([needles.schema["needle"], texts.schema["id"]]))
    asked = written.withColumn("pieces", needle_pieces(F.col("needle")))
    stored = durable(index(texts, asked.select(F.explode("pieces").alias("piece"))), "postings") if postings is None else postings
    # each step is read twice by the next one
    pairs = durable(candidates(asked, stored), "pairs")
    out = durable(checked(pairs, texts, lambda x, text: F.contains(text, x["needle"])).select("needle", "id"), "held")
    discard(written, pairs, *([stored] if postings is None else []))
    return out
