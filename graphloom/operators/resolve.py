"""Reference resolution: which symbol a reference means, by ordered rules.

a. no symbol of the name: the last part of an import of that name in the file,
   if exactly one symbol has it; b. one symbol of the name; c. one in the same
file; d. one whose path or parent fits the qualifier; e. the first (least id)
whose path holds the import's full path; else ambiguous.

Each rule is an equi-join on aggregated keys, so a frequent name never pairs
all its references with all its symbols; rule d looks candidates up by a part
of the path, for distinct (name, qualifier) only, rule e by the rarest piece of
the import's path, for distinct paths and files only.

resolve() takes all references or any part of them: then only the symbols that
these can mean are read, so one name costs what that name has.  update() keeps
what a change cannot touch.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.substring import holding
from graphloom.functions.text import last_segment
from graphloom.plans.catalog import CodeGraph
from graphloom.plans.tables import durable, growing

IMPORT_MARKS = "\\.:"


def _segment_fits(path: str, segment: Column) -> Column:
    tail = F.substring_index(F.col(path), "/", -1)
    stem = F.when(F.endswith(tail, F.lit(".rs")), F.regexp_replace(tail, r"\.rs$", "")).otherwise(F.col(path))
    return (stem == segment) | F.contains(F.col(path), F.concat(F.lit("/"), segment, F.lit("/")))


def _qualified(asked: DataFrame, candidates: DataFrame) -> DataFrame:
    """(name, qualifier, id) where exactly one candidate fits."""
    asked = asked.withColumn("segments", F.filter(F.split("qualifier", "::"), lambda s: s != ""))
    part = F.explode(F.array_distinct(F.array(F.element_at("segments", 1), F.element_at(F.split(F.element_at("segments", 1), "/"), 1))))
    keyed = asked.where(F.size("segments") > 0).select("name", "qualifier", "segments", part.alias("part"))
    parts = F.array_distinct(F.concat(F.split("path", "/"), F.array(F.regexp_replace(F.substring_index("path", "/", -1), r"\.rs$", ""), F.col("path"))))
    by_part = candidates.select("name", "id", "path", F.explode(parts).alias("part"))
    fits = F.forall("segments", lambda s: _segment_fits("path", s))
    by_path = keyed.join(by_part, ["name", "part"]).where(fits).select("name", "qualifier", "id")
    parents = candidates.select("name", F.col("parent_name").alias("qualifier"), "id")
    by_parent = asked.select("name", "qualifier").join(parents, ["name", "qualifier"]).select("name", "qualifier", "id")
    every = by_path.unionByName(by_parent).distinct()
    # without segments every candidate fits, and there are several
    every = every.join(asked.where(F.size("segments") == 0).select("name", "qualifier"), ["name", "qualifier"], "left_anti")
    return every.groupBy("name", "qualifier").agg(F.min("id").alias("d_id"), F.count("*").alias("d_n")).where("d_n = 1").drop("d_n")


def _imported(g: CodeGraph) -> DataFrame:
    """(source_file_id, target_name, full_path): the last import of a name in a file."""
    return growing(g.imports.groupBy(F.col("file_id").alias("source_file_id"), F.col("local_name").alias("target_name")).agg(F.max_by("full_path", "id").alias("full_path")))


def _narrowed(g: CodeGraph, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(imports, symbols) that these references can mean, written."""
    imports = durable(g.imports.join(growing(refs.select(F.col("source_file_id").alias("file_id"), F.col("target_name").alias("local_name"))), ["file_id", "local_name"], "left_semi"), "imports")
    names = refs.select(F.col("target_name").alias("name")).unionByName(imports.select(last_segment(F.col("full_path"), IMPORT_MARKS).alias("name"))).distinct()
    return imports, durable(g.symbols.join(growing(names), "name", "left_semi"), "symbols")


def resolve(g: CodeGraph, refs: DataFrame | None = None) -> DataFrame:
    """Columns of refs (all) with target_symbol_id and resolved set anew, and rule."""
    whole = g
    if refs is not None:
        refs = durable(refs, "asked")
        imports, symbols = _narrowed(g, refs)
        g = replace(g, refs=refs, imports=imports, symbols=symbols)
    parent = growing(whole.symbols.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name")))
    # steps are written, as the driver plans all that is left after each shuffle of a plan
    names = growing(durable(g.symbols.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("b_id")), "names"))
    in_file = growing(g.symbols.groupBy("name", "file_id").agg(F.count("*").alias("c_n"), F.min("id").alias("c_id")).where("c_n = 1").drop("c_n"))
    imported = _imported(g)

    rows = g.refs.drop("target_symbol_id", "resolved")
    rows = rows.join(names.withColumnRenamed("name", "target_name"), "target_name", "left").join(imported, ["source_file_id", "target_name"], "left")
    rows = rows.join(in_file.select(F.col("name").alias("target_name"), F.col("file_id").alias("source_file_id"), "c_id"), ["source_file_id", "target_name"], "left")
    rows = rows.withColumn("actual", F.when(F.col("n").isNull(), last_segment(F.col("full_path"), IMPORT_MARKS)))
    rows = rows.join(names.where("n = 1").select(F.col("name").alias("actual"), F.col("b_id").alias("a_id")), "actual", "left")

    several = g.symbols.select("id", "file_id", "name", "parent_id").join(names.where("n > 1").select("name"), "name", "left_semi")
    # candidates of qualified names only
    asked = growing(g.refs.where("target_qualifier is not null").select(F.col("target_name").alias("name"), F.col("target_qualifier").alias("qualifier")).distinct())
    candidates = several.join(asked.select("name"), "name", "left_semi").join(growing(g.paths(name="path")), "file_id").join(parent, "parent_id", "left")
    candidates = durable(candidates.select("name", "id", "path", "parent_name"), "candidates")
    by_qualifier = growing(durable(_qualified(asked, candidates).select(F.col("name").alias("target_name"), F.col("qualifier").alias("target_qualifier"), "d_id"), "qualified"))
    rows = rows.join(by_qualifier, ["target_name", "target_qualifier"], "left")

    paths = imported.join(growing(g.refs.select("source_file_id", "target_name")), ["source_file_id", "target_name"], "left_semi").select(F.col("target_name").alias("name"), "full_path").distinct()
    paths = growing(durable(paths.join(names.where("n > 1").select("name"), "name", "left_semi"), "paths"))
    files = growing(durable(several.join(paths.select("name"), "name", "left_semi").select("name", "file_id", "id"), "named"))
    # files once each, whatever the number of their symbols
    texts = g.files.select("id", F.col("path").alias("text")).join(files.select(F.col("file_id").alias("id")), "id", "left_semi")
    hits = holding(texts, paths.select(F.col("full_path").alias("needle")))  # a written table
    by_import = paths.join(hits.select(F.col("needle").alias("full_path"), F.col("id").alias("file_id")), "full_path").join(files.select("name", "file_id", "id"), ["name", "file_id"])
    by_import = growing(durable(by_import.groupBy("name", "full_path").agg(F.min("id").alias("e_id")), "imported"))
    rows = rows.join(by_import.withColumnRenamed("name", "target_name"), ["target_name", "full_path"], "left")

    n = F.col("n")
    rule = (
        F.when(n.isNull(), F.when(F.col("a_id").isNotNull(), "a").otherwise("unresolved"))
        .when(n == 1, "b")
        .when(F.col("c_id").isNotNull(), "c")
        .when(F.col("d_id").isNotNull(), "d")
        .when(F.col("e_id").isNotNull(), "e")
        .otherwise("ambiguous")
    )
    rows = rows.withColumn("rule", rule)
    target = F.coalesce(*[F.when(F.col("rule") == r, F.col(f"{r}_id")) for r in "abcde"])
    kept = [F.col(c) for c in g.refs.columns if c not in ("target_symbol_id", "resolved")]
    return rows.select(*kept, target.alias("target_symbol_id"), target.isNotNull().alias("resolved"), "rule")


def of_name(g: CodeGraph, name: str) -> DataFrame:
    """The references that have this name, or an import through which they can mean it."""
    via = g.imports.where((last_segment(F.col("full_path"), IMPORT_MARKS) == name) & (F.col("local_name") != name))
    keys = growing(via.select(F.col("file_id").alias("source_file_id"), F.col("local_name").alias("target_name")).distinct())
    other = g.refs.where(F.col("target_name") != name).join(keys, ["source_file_id", "target_name"], "left_semi")
    return g.refs.where(F.col("target_name") == name).unionByName(other)


def apply(g: CodeGraph, refs: DataFrame | None = None) -> CodeGraph:
    """The graph with its references (or these alone) resolved."""
    columns = [F.col(c) for c in g.refs.columns]
    rows = resolve(g, refs).select(*columns)
    return replace(g, refs=rows if refs is None else durable(rows, "resolved"))


@dataclass(frozen=True)
class Change:
    """Rows that differ between two states of a graph.  A changed file's rows are all in
    it: the old ones as removed, the new ones as added."""

    symbols_added: DataFrame
    symbols_removed: DataFrame
    imports_added: DataFrame
    imports_removed: DataFrame
    refs_added: DataFrame
    refs_removed: DataFrame


def update(before: DataFrame, after: CodeGraph, change: Change) -> DataFrame:
    """resolve(after), from resolve() of the state before: columns of it and `anew`.

    A reference is resolved anew if it is new, if a symbol of its name came or went, if
    its file's import of the name did, or if it has such an import and a symbol of the
    import's last part came or went.  All others keep their row.
    """
    names = change.symbols_added.select("name").unionByName(change.symbols_removed.select("name")).distinct()
    keys = lambda df: df.select(F.col("file_id").alias("source_file_id"), F.col("local_name").alias("target_name"))
    through = after.imports.withColumn("name", last_segment(F.col("full_path"), IMPORT_MARKS)).join(names, "name", "left_semi")
    imports = keys(change.imports_added).unionByName(keys(change.imports_removed)).unionByName(keys(through)).distinct()
    old = before.join(change.refs_removed.select("id"), "id", "left_anti")
    touched = old.join(names.withColumnRenamed("name", "target_name"), "target_name", "left_semi").select("id")
    touched = touched.unionByName(old.join(imports, ["source_file_id", "target_name"], "left_semi").select("id"))
    asked = touched.unionByName(change.refs_added.select("id")).distinct()
    anew = resolve(after, after.refs.join(asked, "id", "left_semi"))
    kept = old.join(asked, "id", "left_anti").select(*anew.columns)
    return kept.withColumn("anew", F.lit(False)).unionByName(anew.withColumn("anew", F.lit(True)))


def stats(resolved: DataFrame) -> DataFrame:
    """One row: total, resolved, ambiguous, unresolved."""
    count = F.count_if
    return resolved.agg(F.count("*").alias("total"), count(F.col("resolved")).alias("resolved"), count(F.col("rule") == "ambiguous").alias("ambiguous"), count(F.col("rule") == "unresolved").alias("unresolved"))
