"""Source slices: the lines of many spans of many texts, in one pass over the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_LINES = 64


def slices(texts: DataFrame, spans: DataFrame, block: int = BLOCK_LINES) -> DataFrame:
    """(span_id, source): lines line_start to line_end, counted from 0, both included.

    texts: key, text; spans: span_id, key, line_start, line_end.  A text is cut at its
    newlines into blocks of lines, once; a span meets only the blocks that it touches,
    so no text is copied for each of its spans, and what a span gathers is its own
    lines.  Lines beyond the end are left out; a span without lines, or of a text
    that is null or missing, has source null.  Keys of texts must be unique.
    """
    lines = F.split("text", "\n")
    starts = F.sequence(F.lit(0), F.expr(f"(size(lines) - 1) div {block}"))
    cut = F.transform(starts, lambda k: F.struct(k.cast("long").alias("block"), F.slice("lines", k * block + 1, F.lit(block)).alias("part")))
    asked = spans.where("line_end >= line_start and line_end >= 0").withColumn("first", F.greatest("line_start", F.lit(0)))
    wanted = asked.select("key").distinct()
    blocks = texts.where("text is not null").join(wanted, "key", "left_semi").select("key", lines.alias("lines")).select("key", F.inline(cut))
    # no more blocks than the text has: a span may ask for lines far beyond its end
    last = texts.where("text is not null").select("key", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("last"))
    asked = asked.join(last, "key").withColumn("end", F.least("line_end", "last")).where("end >= first")
    touched = asked.withColumn("block", F.explode(F.sequence(F.expr(f"first div {block}"), F.expr(f"end div {block}"))))
    base = F.col("block") * block
    own = F.slice("part", F.greatest(F.col("first") - base, F.lit(0)).cast("int") + 1, (F.least(F.col("end") - base, F.lit(block - 1)) - F.greatest(F.col("first") - base, F.lit(0))).cast("int") + 1)
    pieces = touched.join(blocks, ["key", "block"]).select("span_id", F.struct("block", F.array_join(own, "\n").alias("text")).alias("piece"))
    whole = pieces.groupBy("span_id").agg(F.array_sort(F.collect_list("piece")).alias("p")).select("span_id", F.array_join("p.text", "\n").alias("source"))
    return spans.select("span_id").join(whole, "span_id", "left")


def symbol_sources(texts: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, source) of symbols (id, file_path, line_start, line_end) from texts (path, content)."""
    spans = symbols.select(F.col("id").alias("span_id"), F.col("file_path").alias("key"), "line_start", "line_end")
    return slices(texts.select(F.col("path").alias("key"), F.col("content").alias("text")), spans).withColumnRenamed("span_id", "id")
