"""Links inside one file: parents, sources, enclosing symbols, languages."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.schema import EXTENSIONS

#: Lines in a block of each size; the last holds any file.
BLOCKS = (16, 256, 4096, 65536, 1 << 62)


def language_of(path: Column) -> Column:
    """By extension, case-sensitive; null for files that are not indexed."""
    table = F.create_map(*map(F.lit, chain.from_iterable(EXTENSIONS.items())))
    name = F.substring_index(path, "/", -1)
    return F.when(F.contains(name, F.lit(".")), F.try_element_at(table, F.substring_index(name, ".", -1)))


def parents(children: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, parent_id): the first earlier symbol of the file named parent_name.

    children: id, file_id, pos, parent_name; symbols: id, file_id, name, pos.
    """
    # the first of a name is the only one that can be first before a child
    first = symbols.groupBy("file_id", F.col("name").alias("parent_name")).agg(F.min(F.struct("pos", "id")).alias("f"))
    return children.join(first, ["file_id", "parent_name"]).where("f.pos < pos").select("id", F.col("f.id").alias("parent_id"))


def sources(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """refs (file_id, source_symbol_name, ...) with source_symbol_id: the first symbol of that name in the file."""
    first = symbols.groupBy("file_id", F.col("name").alias("source_symbol_name")).agg(F.min_by("id", "pos").alias("source_symbol_id"))
    return refs.join(first, ["file_id", "source_symbol_name"], "left")


def enclosing(symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """(ref_id, name, id): the shortest symbol of the file around the line, the
    least id on ties.  lines: ref_id, file_id, line.

    Lines and symbols meet by block: a symbol is listed in the one or two blocks,
    of the least size above its length, that it touches; a line looks into one
    block of each size.  So a long file pairs no line with its far symbols.
    """
    length = F.col("line_end") - F.col("line_start")
    block = F.coalesce(*[F.when(length < s, F.lit(s)) for s in BLOCKS], F.lit(BLOCKS[-1]))
    touched = F.array_distinct(F.array(F.expr("line_start div block"), F.expr("line_end div block")))
    spans = symbols.select("file_id", "id", "name", "line_start", "line_end").withColumn("block", block).withColumn("at", F.explode(touched))
    asked = lines.withColumn("block", F.explode(F.array(*map(F.lit, BLOCKS)))).withColumn("at", F.expr("line div block"))
    hit = asked.join(spans, ["file_id", "block", "at"]).where(F.col("line").between(F.col("line_start"), F.col("line_end")))
    best = hit.groupBy("ref_id").agg(F.min(F.struct((F.col("line_end") - F.col("line_start")).alias("size"), "id", "name")).alias("b"))
    return best.select("ref_id", "b.name", "b.id")
