"""The code graph as a set of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.functions.text import ascii_like


@dataclass(frozen=True)
class CodeGraph:
    files: DataFrame
    symbols: DataFrame
    refs: DataFrame
    imports: DataFrame
    sources: DataFrame | None = None  # path, content of files that hold tests

    @property
    def spark(self) -> SparkSession:
        return self.files.sparkSession

    def paths(self, *, key: str = "file_id", name: str = "file_path") -> DataFrame:
        return self.files.select(F.col("id").alias(key), F.col("path").alias(name))

    def located_symbols(self) -> DataFrame:
        """Symbols with file_path and lang, as every symbol query needs them."""
        where = self.files.select(F.col("id").alias("file_id"), F.col("path").alias("file_path"), "lang")
        return self.symbols.join(where, "file_id")

    def named(self, name: str, qualifier: str | None) -> DataFrame:
        """Located symbols of a name; a qualifier must be the parent's name."""
        found = self.located_symbols().where(F.col("name") == name)
        if qualifier is not None:
            parents = self.symbols.where(F.col("name") == qualifier).select(F.col("id").alias("parent_id"))
            found = found.join(parents, "parent_id", "left_semi")
        return found

    def register(self, prefix: str = "") -> None:
        for table in ("files", "symbols", "refs", "imports"):
            getattr(self, table).createOrReplaceTempView(prefix + table)


SYMBOL_COLUMNS = ("id", "file_path", "name", "kind", "line_start", "line_end", "visibility", "signature")


def stored_symbols(df: DataFrame) -> DataFrame:
    return df.select(*SYMBOL_COLUMNS)


def in_path(c: Column | str, part: str | None) -> Column:
    return F.lit(True) if part is None else ascii_like(F.col(c) if isinstance(c, str) else c, part)


def empty_graph(spark: SparkSession) -> CodeGraph:
    make = lambda ddl: spark.createDataFrame([], ddl)
    return CodeGraph(make(schema.FILES), make(schema.SYMBOLS), make(schema.REFS), make(schema.IMPORTS), make(schema.SOURCES))
