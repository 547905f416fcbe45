"""Queries of a graph that is kept: stored layout, changes, coverage, digests, slices.

Registered beside those of catalogue.py, with their SQL.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import render
from graphloom.functions.substring import holding
from graphloom.operators import calls, coverage, digest, hierarchy, imports, link, owners, references, resolve, slices, symbols, testing
from graphloom.plans import catalogue as C
from graphloom.plans.catalog import CodeGraph
from graphloom.plans.layout import stored
from graphloom.plans.tables import durable
from graphloom.sources import bridge, versions
from graphloom.streaming import changes

GONE = 10**9


def changed_graph(g: CodeGraph) -> tuple[CodeGraph, resolve.Change]:
    """A state of the graph before a change, and the change that leads to g: some symbols
    were missing or had another name, some imports and references were missing, and
    some references have gone since."""
    i = F.col("id")
    new, renamed = i % 40 == 7, i % 40 == 9
    old_name = F.concat(F.lit("old_"), F.col("name"))
    before = replace(
        g,
        symbols=g.symbols.where(~new).withColumn("name", F.when(renamed, old_name).otherwise(F.col("name"))),
        imports=g.imports.where(i % 30 != 11),
        refs=g.refs.where(i % 50 != 3).unionByName(g.refs.where(i % 50 == 5).withColumn("id", i + GONE)),
    )
    return before, resolve.Change(
        symbols_added=g.symbols.where(new | renamed),
        symbols_removed=before.symbols.where(renamed),
        imports_added=g.imports.where(i % 30 == 11),
        imports_removed=g.imports.limit(0),
        refs_added=g.refs.where(i % 50 == 3),
        # ids of references made from imports begin at 10**8
        refs_removed=g.refs.where(i % 50 == 5).select((i + GONE).alias("id")),
    )


def resolve_incremental(g: CodeGraph) -> DataFrame:
    before, change = changed_graph(g)
    first = durable(resolve.resolve(before), "resolved")
    return resolve.update(first, g, change).select("id", "target_symbol_id", "rule", "anew")


CHANGED = r"""
chg AS (SELECT name FROM symbols WHERE id % 40 IN (7, 9) UNION SELECT concat('old_', name) FROM symbols WHERE id % 40 = 9),
via AS (SELECT DISTINCT file_id, local_name FROM imports WHERE id % 30 = 11 OR regexp_extract(full_path, '([^\\.:]*)$', 1) IN (SELECT name FROM chg))"""


def edited(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """documents as files before and after an edit: some have new text and a new time, some
    a new time only, some are gone, some are new."""
    files = docs.select(F.col("doc_id").alias("key"), F.coalesce("n_chars", F.lit(0)).cast("long").alias("size"), F.lit(0).cast("long").alias("modified"), F.col("text").alias("content"))
    k = F.col("key")
    before = files.where(k % 13 != 4)
    after = files.where(k % 11 != 5).withColumn("content", F.when(k % 10 == 3, F.concat(F.coalesce("content", F.lit("")), F.lit("!"))).otherwise(F.col("content")))
    return before, after.withColumn("modified", F.when((k % 10 == 3) | (k % 10 == 7), F.lit(1)).otherwise(F.lit(0)).cast("long"))


def document_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kept = durable(versions.snapshot(before), "snapshot")
    return versions.changes(kept, after).select(F.col("key").alias("doc_id"), "action")


def event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = changes.event_changes(spark, spark.read.parquet(f"{sf_dir}/events.parquet"))
    # microseconds since 1970 of the time as it is written, in any session's time zone
    last = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(timestamp_micros(last_at) as timestamp_ntz))")
    return found.select(F.col("key").alias("user_id"), last.alias("last_at"), "seen", "changed")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three spans of lines of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("key"), "text")
    k = F.col("key")
    starts = F.array(F.lit(0), k % 5, k % 3 + 60)
    spans = docs.select("key", F.posexplode(starts).alias("at", "line_start")).select("key", (k * 3 + F.col("at")).alias("span_id"), "line_start", (F.col("line_start") + k % 4 + F.col("at") * 2).alias("line_end"))
    return slices.slices(docs, spans)


def words_in_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of part names and the imports whose path holds them."""
    g = bridge.graph(spark, sf_dir)
    words = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.explode(F.split("p_name", " ")).alias("needle"))
    found = holding(durable(g.imports.select("id", F.col("full_path").alias("text")), "texts"), words)
    return found.select(F.col("needle").alias("word"), F.col("id").alias("import_id"))


def file_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The project of every file; projects are rooted at the source folders of nations."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    i = F.col("n_nationkey")
    roots = F.array(F.concat(F.lit("/repo/src/n"), i), F.when(i % 3 == 0, F.concat(F.lit("/repo/tests/n"), i)), F.when(i == 0, F.lit("/repo/tests")))
    projects = nations.select("n_name", F.explode(roots).alias("root")).select(F.concat_ws(":", "n_name", "root").alias("name"), "root")
    return owners.owners(bridge.graph(spark, sf_dir).files.select("id", "path"), projects).select("id", "project")


def link_sources(g: CodeGraph) -> DataFrame:
    """References linked again to the first symbol of their source's name in the file."""
    named = g.refs.join(g.symbols.select(F.col("id").alias("source_symbol_id"), F.col("name").alias("source_symbol_name")), "source_symbol_id", "left")
    asked = named.select("id", F.col("source_file_id").alias("file_id"), "source_symbol_name")
    return link.sources(asked, g.symbols.select("id", "file_id", "name", F.col("id").alias("pos"))).select("id", "source_symbol_id")


def _register() -> None:
    plain = C._plain
    anew = "(r.id % 50 = 3 OR r.target_name IN (SELECT name FROM chg) OR EXISTS (SELECT 1 FROM via v WHERE v.file_id = r.source_file_id AND v.local_name = r.target_name)) AS anew"
    plain("resolve_incremental", f"SELECT r.id, r.target_symbol_id, r.rule, {anew} FROM resolved r", resolve_incremental, C.RESOLVED, CHANGED)

    ref = "SELECT f.path AS source_file, s.name AS source_symbol, r.target_name, r.target_qualifier, r.kind, r.line, r.target_symbol_id IS NOT NULL AS resolved, tf.path AS target_file, t.name AS target_symbol FROM resolved r JOIN files f ON r.source_file_id = f.id LEFT JOIN symbols s ON r.source_symbol_id = s.id LEFT JOIN symbols t ON r.target_symbol_id = t.id LEFT JOIN files tf ON t.file_id = tf.id"
    plain("stored_references", f"{ref} WHERE r.target_name = 'main'", lambda g: references.find_references(stored(resolve.apply(g)), "main"), C.RESOLVED)
    dead = f"SELECT {C.STORED} FROM {C.LOCATED} WHERE {C.CALLABLE} AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.target_name = s.name AND r.kind = 'call')"
    plain("stored_dead_code", dead, lambda g: symbols.find_dead_code(stored(g)))

    pairs = "pairs AS (SELECT DISTINCT name AS test, name FROM symbols WHERE is_test = 1 UNION SELECT p.test, e.target FROM pairs p JOIN edges e ON e.source = p.name)"
    weights = "weights AS (SELECT name AS test, count(*) AS n FROM symbols WHERE is_test = 1 GROUP BY name)"
    plain("test_counts", "SELECT p.name, CAST(sum(w.n) AS BIGINT) AS tests FROM pairs p JOIN weights w USING (test) GROUP BY p.name", coverage.test_counts, C.EDGES, pairs, weights)

    under = """parts AS (SELECT f.id, f.path, string_split(f.path, '/') AS p FROM files f),
dirs AS (SELECT id, unnest(list_transform(range(2, len(p)), lambda k: array_to_string(p[1:k], '/'))) AS directory FROM parts)"""
    one = lambda c: f"CAST(count(s.id) FILTER (WHERE {c}) AS BIGINT)"
    plain("digest_directories", f"SELECT d.directory, count(DISTINCT d.id) AS files, count(s.id) AS symbols, {one(C.TYPE)} AS types, {one("s.kind IN ('function', 'method')")} AS callables, {one('s.is_test = 1')} AS tests FROM dirs d LEFT JOIN symbols s ON s.file_id = d.id GROUP BY d.directory", digest.directories, under)
    ranked = "ranked AS (SELECT m.*, row_number() OVER (PARTITION BY parent_id ORDER BY line_start, id) AS rank, count(*) OVER (PARTITION BY parent_id) AS members FROM symbols m WHERE parent_id IS NOT NULL)"
    plain("digest_members", f"SELECT f.path AS file_path, s.name AS type, coalesce(m.members, 0) AS members, CAST(m.rank AS INTEGER) AS rank, m.name, m.kind, m.line_start FROM {C.LOCATED} LEFT JOIN ranked m ON m.parent_id = s.id AND m.rank <= 4 WHERE {C.TYPE}", lambda g: digest.members(g, 4), ranked)
    plain("link_sources", "SELECT r.id, (SELECT min(q.id) FROM symbols q WHERE q.file_id = r.source_file_id AND q.name = s.name) AS source_symbol_id FROM refs r LEFT JOIN symbols s ON s.id = r.source_symbol_id", link_sources)

    C.QUERIES["words_in_imports"] = words_in_imports
    C.ORACLES["words_in_imports"] = f"WITH {bridge.CTES}, words AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part) SELECT w.word, i.id AS import_id FROM words w JOIN imports i ON contains(i.full_path, w.word)"
    C.QUERIES["file_owners"] = file_owners
    C.ORACLES["file_owners"] = f"""WITH {bridge.CTES},
roots AS (SELECT n_name, concat('/repo/src/n', n_nationkey) AS root FROM nation UNION ALL SELECT n_name, concat('/repo/tests/n', n_nationkey) FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT n_name, '/repo/tests' FROM nation WHERE n_nationkey = 0)
SELECT f.id, (SELECT arg_max(concat(r.n_name, ':', r.root), length(r.root)) FROM roots r WHERE starts_with(f.path, r.root)) AS project FROM files f"""
    C.QUERIES["document_changes"] = document_changes
    C.ORACLES["document_changes"] = """SELECT doc_id, CASE WHEN doc_id % 11 = 5 THEN 'gone' WHEN doc_id % 13 = 4 OR doc_id % 10 = 3 THEN 'parse' WHEN doc_id % 10 = 7 THEN 'touch' ELSE 'skip' END AS action
FROM documents WHERE NOT (doc_id % 11 = 5 AND doc_id % 13 = 4)"""
    C.QUERIES["event_changes"] = event_changes
    C.ORACLES["event_changes"] = """WITH ordered AS (SELECT user_id, ts, row_number() OVER w AS k, event_type, value, props, lag(event_type) OVER w AS t, lag(value) OVER w AS v, lag(props) OVER w AS p FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, epoch_us(max(ts)) AS last_at, count(*) AS seen, count(*) FILTER (WHERE k = 1 OR event_type IS DISTINCT FROM t OR value IS DISTINCT FROM v OR props IS DISTINCT FROM p) AS changed FROM ordered GROUP BY user_id"""
    C.QUERIES["document_lines"] = document_lines
    C.ORACLES["document_lines"] = """WITH spans AS (SELECT doc_id, text, unnest([0, 1, 2]) AS nth FROM documents),
asked AS (SELECT doc_id * 3 + nth AS span_id, string_split(text, chr(10)) AS lines, CASE nth WHEN 0 THEN 0 WHEN 1 THEN doc_id % 5 ELSE doc_id % 3 + 60 END AS low, doc_id % 4 + nth * 2 AS more FROM spans)
SELECT span_id, CASE WHEN low < len(lines) THEN array_to_string(lines[low + 1:low + more + 1], chr(10)) END AS source FROM asked"""

    listed = "concat('  ', s.kind, ' ', s.name, ' in ', f.path, ':', CAST(s.line_start AS VARCHAR))"
    headed = lambda rows, header, empty: f"SELECT CASE WHEN count(*) = 0 THEN '{empty}' ELSE concat(CAST(count(*) AS VARCHAR), ' {header}:') END AS line FROM ({rows}) UNION ALL {rows}"
    rows = f"SELECT DISTINCT concat('  ', coalesce(s.name, '<top-level>'), ' in ', f.path, ':', CAST(r.line AS VARCHAR)) AS line FROM {C.CALLS} WHERE r.kind = 'call' AND r.target_name = 'main'"
    plain("render_callers", headed(rows, "callers found", "No callers found."), lambda g: render.headed(render.call_lines(calls.find_callers(g, "main")), "callers found", "No callers found."))
    plain("render_hierarchy", f"SELECT concat(repeat('  ', depth), name, ' (', kind, ') in ', file_path, ' | ', relation) AS line FROM ({C.ROWS['ancestor']})", lambda g: render.hierarchy_lines(hierarchy.find_hierarchy(g, "F4", "ancestors")), C.NAMES["ancestor"])
    rows = "SELECT concat('  ', f.path, ':', CAST(i.line AS VARCHAR), ' ', i.local_name, ' (', i.full_path, ')', CASE WHEN i.alias IS NULL THEN '' ELSE concat(' as ', i.alias) END) AS line FROM imports i JOIN files f ON i.file_id = f.id WHERE i.full_path ILIKE '%src::%'"
    plain("render_importers", headed(rows, "importer(s) found", "No importers found."), lambda g: render.headed(render.importer_lines(imports.find_imported_by(g, "src::")), "importer(s) found", "No importers found."))
    target = "concat(a.source_file, ':', CAST(a.line AS VARCHAR), ' ', a.local_name, ' (', a.full_path, ')', CASE WHEN a.alias IS NULL THEN '' ELSE concat(' as ', a.alias) END, ' → ', CASE WHEN coalesce(r.id, o.id) IS NULL THEN '[unresolved]' ELSE concat(coalesce(r.kind, o.kind), ' ', coalesce(r.name, o.name), ' in ', coalesce(r.path, o.path), ':', CAST(coalesce(r.line_start, o.line_start) AS VARCHAR)) END)"
    plain("render_resolved_imports", f"SELECT {target} AS line FROM asked a LEFT JOIN ranked r ON r.id = a.id AND r.rn = 1 LEFT JOIN own o ON o.id = a.id AND o.rn = 1", lambda g: render.resolved_import_lines(imports.resolve_import(g, "src::")), C.TARGETS.replace("\\\\\\\\", "\\\\"))
    where = f"FROM {C.LOCATED} WHERE {C.CALLABLE}"
    rows = f"SELECT {listed} AS line {where} AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.target_name = s.name AND r.kind = 'call')"
    plain("render_dead_code", headed(rows, "potentially unused functions", "No dead code found."), lambda g: render.headed(render.listed_lines(symbols.find_dead_code(g)), "potentially unused functions", "No dead code found."))
    rows = f"SELECT {listed} AS line FROM {C.LOCATED} WHERE s.is_test = 1 AND s.name = 'nothing'"
    plain("render_tested_by", headed(rows, "test(s) found", "No tests found for this symbol."), lambda g: render.headed(render.listed_lines(testing.find_tested_by(g, "nothing", depth=1)), "test(s) found", "No tests found for this symbol."))
    plain("render_status", "SELECT concat('Files: ', (SELECT count(*) FROM files), ', Symbols: ', (SELECT count(*) FROM symbols), ', References: ', (SELECT count(*) FROM refs)) AS line", lambda g: render.status_line(symbols.status(g)))
    plain("render_resolution", "SELECT concat('Resolution: ', count(target_symbol_id), '/', count(*), ' resolved, ', count(*) FILTER (WHERE rule = 'ambiguous'), ' ambiguous, ', count(*) FILTER (WHERE rule = 'unresolved'), ' unresolved') AS line FROM resolved", lambda g: render.resolution_line(resolve.stats(resolve.resolve(g))), C.RESOLVED)


_register()
