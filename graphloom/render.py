"""Text and JSON of query results."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

Rows = Sequence[Any]


def rows(df: DataFrame) -> list[Row]:
    """A query's result, in its order, for printing."""
    return df.collect()


def to_json(found: Iterable[Row], compact: bool = False) -> str:
    """An array of objects; nulls are written out."""
    plain = [r.asDict(recursive=True) for r in found]
    return json.dumps(plain, ensure_ascii=False, separators=(",", ":")) if compact else json.dumps(plain, ensure_ascii=False, indent=2)


def _lines(found: Rows, empty: str, line: Callable[[Any], str], header: str = "") -> str:
    if not found:
        return empty
    return (header + ":\n" if header else "") + "\n".join(map(line, found))


def symbols(found: Rows) -> str:
    def line(s: Any) -> str:
        head = f"{s.visibility or ''} {s.kind} {s.name} {s.file_path}:{s.line_start}-{s.line_end}".strip()
        return head + (f" | {s.signature}" if s.signature else "")

    return _lines(found, "No symbols found.", line)


def calls(found: Rows, label: str) -> str:
    return _lines(found, f"No {label} found.", lambda c: f"  {c.symbol_name} in {c.file_path}:{c.line}", f"{len(found)} {label} found")


def references(found: Rows) -> str:
    return _lines(found, "No references found.", lambda r: f"  [{r.kind}] {r.source_symbol or '<file-level>'} in {r.source_file}:{r.line}{' [resolved]' if r.resolved else ''}")


def hierarchy(found: Rows) -> str:
    return _lines(found, "No inheritance found.", lambda e: f"{'  ' * e.depth}{e.name} ({e.kind}) in {e.file_path} | {e.relation}")


def _alias(i: Any) -> str:
    return f" as {i.alias}" if i.alias is not None else ""


def resolved_imports(found: Rows) -> str:
    def line(i: Any) -> str:
        known = None not in (i.target_file, i.target_symbol, i.target_line)
        target = f"{i.target_kind or '?'} {i.target_symbol} in {i.target_file}:{i.target_line}" if known else "[unresolved]"
        return f"{i.source_file}:{i.line} {i.local_name} ({i.full_path}){_alias(i)} → {target}"

    return _lines(found, "No imports found.", line)


def imported_by(found: Rows) -> str:
    return _lines(found, "No importers found.", lambda e: f"  {e.file_path}:{e.line} {e.local_name} ({e.full_path}){_alias(e)}", f"{len(found)} importer(s) found")


def _listed(found: Rows, empty: str, header: str) -> str:
    return _lines(found, empty, lambda s: f"  {s.kind} {s.name} in {s.file_path}:{s.line_start}", f"{len(found)} {header}")


def tested_by(found: Rows) -> str:
    return _listed(found, "No tests found for this symbol.", "test(s) found")


def untested(found: Rows) -> str:
    return _listed(found, "All functions/methods are tested.", "untested functions/methods")


def dead_code(found: Rows) -> str:
    return _listed(found, "No dead code found.", "potentially unused functions")


def status(row: Row) -> str:
    return f"Files: {row.files}, Symbols: {row.symbols}, References: {row.references}"


def resolution(row: Row) -> str:
    return f"Resolution: {row.resolved}/{row.total} resolved, {row.ambiguous} ambiguous, {row.unresolved} unresolved"


def symbol_lines(df: DataFrame) -> DataFrame:
    """symbols() as a column: one line a row, for results that stay distributed."""
    head = F.concat(F.coalesce("visibility", F.lit("")), F.lit(" "), "kind", F.lit(" "), "name", F.lit(" "), "file_path", F.lit(":"), "line_start", F.lit("-"), "line_end")
    more = F.when(F.coalesce("signature", F.lit("")) != "", F.concat(F.lit(" | "), "signature")).otherwise("")
    return df.select("id", F.concat(F.trim(head), more).alias("line"))


def reference_lines(df: DataFrame) -> DataFrame:
    """references() as a column."""
    source = F.coalesce("source_symbol", F.lit("<file-level>"))
    resolved = F.when(F.col("resolved"), " [resolved]").otherwise("")
    return df.select(F.concat(F.lit("  ["), "kind", F.lit("] "), source, F.lit(" in "), "source_file", F.lit(":"), "line", resolved).alias("line"))


def json_lines(df: DataFrame) -> DataFrame:
    """to_json() as a column: one object a row, nulls written out."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))


def call_lines(df: DataFrame) -> DataFrame:
    """calls() as a column, without its header."""
    return df.select(F.concat(F.lit("  "), "symbol_name", F.lit(" in "), "file_path", F.lit(":"), "line").alias("line"))


def hierarchy_lines(df: DataFrame) -> DataFrame:
    """hierarchy() as a column."""
    return df.select(F.concat(F.repeat(F.lit("  "), F.col("depth")), "name", F.lit(" ("), "kind", F.lit(") in "), "file_path", F.lit(" | "), "relation").alias("line"))


def _alias_text() -> Column:
    return F.coalesce(F.concat(F.lit(" as "), "alias"), F.lit(""))


def resolved_import_lines(df: DataFrame) -> DataFrame:
    """resolved_imports() as a column."""
    target = F.concat(F.coalesce("target_kind", F.lit("?")), F.lit(" "), "target_symbol", F.lit(" in "), "target_file", F.lit(":"), "target_line")
    return df.select(F.concat("source_file", F.lit(":"), "line", F.lit(" "), "local_name", F.lit(" ("), "full_path", F.lit(")"), _alias_text(), F.lit(" → "), F.coalesce(target, F.lit("[unresolved]"))).alias("line"))


def importer_lines(df: DataFrame) -> DataFrame:
    """imported_by() as a column, without its header."""
    return df.select(F.concat(F.lit("  "), "file_path", F.lit(":"), "line", F.lit(" "), "local_name", F.lit(" ("), "full_path", F.lit(")"), _alias_text()).alias("line"))


def listed_lines(df: DataFrame) -> DataFrame:
    """tested_by(), untested() and dead_code() as a column, without their header."""
    return df.select(F.concat(F.lit("  "), "kind", F.lit(" "), "name", F.lit(" in "), "file_path", F.lit(":"), "line_start").alias("line"))


def headed(lines: DataFrame, header: str, empty: str) -> DataFrame:
    """Lines with a first one that counts them (`12 callers found:`), or the message for none."""
    said = lines.agg(F.count("*").alias("n")).select(F.when(F.col("n") == 0, empty).otherwise(F.concat("n", F.lit(f" {header}:"))).alias("line"))
    return said.unionByName(lines)


def status_line(df: DataFrame) -> DataFrame:
    """status() as a column."""
    return df.select(F.concat(F.lit("Files: "), "files", F.lit(", Symbols: "), "symbols", F.lit(", References: "), "references").alias("line"))


def resolution_line(df: DataFrame) -> DataFrame:
    """resolution() as a column."""
    return df.select(F.concat(F.lit("Resolution: "), "resolved", F.lit("/"), "total", F.lit(" resolved, "), "ambiguous", F.lit(" ambiguous, "), "unresolved", F.lit(" unresolved")).alias("line"))
