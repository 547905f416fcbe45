"""Every registered query of the code graph, with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import render
from graphloom.functions.text import last_segment
from graphloom.operators import calls, hierarchy, imports, link, references, resolve, symbols, testing
from graphloom.plans import expected, layout
from graphloom.plans.catalog import CodeGraph
from graphloom.sources import bridge, samples

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: References with their target, by the rules in order.
RESOLVED = r"""
cand AS (SELECT s.id, s.file_id, s.name, f.path, p.name AS parent_name,
           regexp_replace(regexp_extract(f.path, '([^/]*)$', 1), '\.rs$', '') AS cut, ends_with(f.path, '.rs') AS rs
         FROM symbols s JOIN files f ON s.file_id = f.id LEFT JOIN symbols p ON s.parent_id = p.id),
names AS (SELECT name, count(*) AS n, min(id) AS b_id FROM symbols GROUP BY name),
imap AS (SELECT file_id, local_name, arg_max(full_path, id) AS full_path FROM imports GROUP BY ALL),
fit AS (
  SELECT r.id AS ref_id,
    count(*) FILTER (WHERE c.file_id = r.source_file_id) AS c_n, min(c.id) FILTER (WHERE c.file_id = r.source_file_id) AS c_id,
    count(*) FILTER (WHERE q) AS d_n, min(c.id) FILTER (WHERE q) AS d_id,
    min(c.id) FILTER (WHERE contains(c.path, i.full_path)) AS e_id
  FROM refs r JOIN names n ON n.name = r.target_name AND n.n > 1
  JOIN LATERAL (SELECT c.*, coalesce(c.parent_name = r.target_qualifier, false) OR coalesce(len(list_filter(string_split(r.target_qualifier, '::'),
        lambda g: g <> '' AND NOT ((CASE WHEN c.rs THEN c.cut ELSE c.path END) = g OR contains(c.path, '/' || g || '/')))) = 0, false) AS q
      FROM cand c WHERE c.name = r.target_name) c ON true
  LEFT JOIN imap i ON i.file_id = r.source_file_id AND i.local_name = r.target_name
  GROUP BY r.id),
resolved AS (
  SELECT r.*, CASE WHEN n.n IS NULL THEN CASE WHEN a.n = 1 THEN 'a' ELSE 'unresolved' END WHEN n.n = 1 THEN 'b'
      WHEN fit.c_n = 1 THEN 'c' WHEN fit.d_n = 1 THEN 'd' WHEN fit.e_id IS NOT NULL THEN 'e' ELSE 'ambiguous' END AS rule,
    CASE WHEN n.n IS NULL THEN CASE WHEN a.n = 1 THEN a.b_id END WHEN n.n = 1 THEN n.b_id
      WHEN fit.c_n = 1 THEN fit.c_id WHEN fit.d_n = 1 THEN fit.d_id ELSE fit.e_id END AS target_symbol_id
  FROM refs r LEFT JOIN names n ON n.name = r.target_name
  LEFT JOIN imap i ON i.file_id = r.source_file_id AND i.local_name = r.target_name
  LEFT JOIN names a ON a.name = regexp_extract(i.full_path, '([^\\.:]*)$', 1)
  LEFT JOIN fit ON fit.ref_id = r.id)"""

STORED = "s.id, f.path AS file_path, s.name, s.kind, s.line_start, s.line_end, CAST(NULL AS VARCHAR) AS visibility, CAST(NULL AS VARCHAR) AS signature"
LOCATED = "symbols s JOIN files f ON s.file_id = f.id"
CALLS = "refs r JOIN files f ON r.source_file_id = f.id LEFT JOIN symbols s ON r.source_symbol_id = s.id"
CALLER = "coalesce(s.name, '<top-level>') AS symbol_name, f.path AS file_path, r.line, r.kind"
CALLEE = "r.target_name AS symbol_name, f.path AS file_path, r.line, r.kind"
CALLABLE = "s.kind IN ('function', 'method') AND s.name NOT IN ('main', 'new', '__init__', '__construct')"


#: Queries that join references or read the graph in many places: it is derived and
#: written once for them, and the optimizer then knows the size of each table.
MANY_READS = ("resolve_", "references_", "callers_", "callees_", "dead_code", "ancestors", "descendants", "hierarchy_both", "test_", "tested_by", "untested", "enclosing_", "stored_", "link_", "render_", "digest_")


def _query(name: str, sql: str | None, *more: str) -> Callable[[Callable[[CodeGraph], DataFrame]], Callable[[CodeGraph], DataFrame]]:
    """Registers f(graph) as a query; `more` are CTEs after the bridge's."""

    def put(f: Callable[[CodeGraph], DataFrame]) -> Callable[[CodeGraph], DataFrame]:
        if name.startswith(MANY_READS):
            QUERIES[name] = lambda spark, sf_dir: f(layout.kept(bridge.graph(spark, sf_dir)))
        else:
            QUERIES[name] = lambda spark, sf_dir: f(bridge.graph(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = f"WITH RECURSIVE {', '.join([bridge.CTES, *more])} {sql}"
        return f

    return put


def _plain(name: str, sql: str, f: Callable[[CodeGraph], DataFrame], *more: str) -> None:
    _query(name, sql, *more)(f)


def levels_sql(first: str, expand: str, seed: str, depth: int) -> tuple[str, list[str]]:
    """Unrolled levels: l0 is `first`; `expand` has {frontier} for its names."""
    ctes, seen = [f"l0 AS ({first})"], [f"SELECT '{seed}' AS name"]
    for k in range(1, depth):
        ctes.append(f"v{k} AS ({' UNION '.join(seen)})")
        ctes.append(f"n{k} AS (SELECT DISTINCT symbol_name AS name FROM l{k - 1} WHERE symbol_name <> '<top-level>' AND symbol_name NOT IN (SELECT name FROM v{k}))")
        ctes.append(f"l{k} AS ({expand.format(frontier=f'n{k}')})")
        seen.append(f"SELECT name FROM n{k}")
    return " UNION ALL ".join(f"SELECT symbol_name, file_path, line, kind FROM l{k}" for k in range(depth)), ctes


CALLERS_OF = f"SELECT DISTINCT r.target_name, {CALLER} FROM {CALLS} WHERE r.kind = 'call' AND r.target_name IN (SELECT name FROM {{frontier}})"
CALLEES_OF = f"SELECT {CALLEE} FROM {CALLS} WHERE r.kind = 'call' AND s.name IN (SELECT name FROM {{frontier}})"


def _callers(seed: str, depth: int) -> tuple[str, list[str]]:
    return levels_sql(f"SELECT DISTINCT r.target_name, {CALLER} FROM {CALLS} WHERE r.kind = 'call' AND r.target_name = '{seed}'", CALLERS_OF, seed, depth)


def _callees(seed: str, depth: int) -> tuple[str, list[str]]:
    return levels_sql(f"SELECT {CALLEE} FROM {CALLS} WHERE r.kind = 'call' AND s.name = '{seed}'", CALLEES_OF, seed, depth)


INHERITS = "r.kind IN ('inherit', 'implement', 'trait_impl')"
TYPE = "s.kind IN ('class', 'struct', 'trait', 'interface')"
#: Names with the least number of steps from F4; walks of FAR steps hold all least ones.
FAR = 40
NAMES = {
    "ancestor": f"names0 AS (SELECT 'F4' AS name, 0 AS d UNION SELECT r.target_name, v.d + 1 FROM names0 v JOIN symbols s ON s.name = v.name JOIN refs r ON r.source_file_id = s.file_id AND {INHERITS} WHERE v.d < {FAR}), least0 AS (SELECT name, min(d) AS d FROM names0 GROUP BY name)",
    "descendant": f"names1 AS (SELECT 'F4' AS name, 0 AS d UNION SELECT s.name, v.d + 1 FROM names1 v JOIN refs r ON r.target_name = v.name AND {INHERITS} JOIN symbols s ON s.file_id = r.source_file_id AND {TYPE} WHERE v.d < {FAR}), least1 AS (SELECT name, min(d) AS d FROM names1 GROUP BY name)",
}
ROWS = {
    "ancestor": f"SELECT r.target_name AS name, r.kind, f.path AS file_path, 'ancestor' AS relation, CAST(h.d AS INTEGER) AS depth FROM (SELECT DISTINCT s.name, s.file_id, v.d FROM symbols s JOIN least0 v ON s.name = v.name) h JOIN refs r ON r.source_file_id = h.file_id AND {INHERITS} JOIN files f ON f.id = r.source_file_id",
    "descendant": f"SELECT name, kind, file_path, 'descendant' AS relation, CAST(d AS INTEGER) AS depth FROM (SELECT DISTINCT r.target_name, s.name, r.kind, f.path AS file_path, v.d FROM refs r JOIN least1 v ON r.target_name = v.name JOIN files f ON f.id = r.source_file_id JOIN symbols s ON s.file_id = r.source_file_id AND {TYPE} WHERE {INHERITS})",
}
EDGES = "edges AS (SELECT DISTINCT s.name AS source, r.target_name AS target FROM refs r JOIN symbols s ON r.source_symbol_id = s.id WHERE r.kind = 'call')"
REACH = "reach AS (SELECT DISTINCT name FROM symbols WHERE is_test = 1 UNION SELECT e.target FROM reach v JOIN edges e ON e.source = v.name)"
TARGETS = """
tgt AS (SELECT s.name, f.path, s.kind, s.line_start, s.id FROM symbols s JOIN files f ON s.file_id = f.id),
tn AS (SELECT name, count(*) AS n FROM tgt GROUP BY name),
asked AS (SELECT i.*, f.path AS source_file, regexp_extract(i.full_path, '([^\\\\.:/]*)$', 1) AS actual FROM imports i JOIN files f ON i.file_id = f.id
          WHERE i.local_name = 'src::' OR contains(i.full_path, 'src::')),
ranked AS (SELECT a.id, t.*, t.id AS sid, row_number() OVER (PARTITION BY a.id ORDER BY
             (tn.n > 1 AND len(list_filter(regexp_split_to_array(lower(a.full_path), '[\\\\.:/]'), lambda p: NOT contains(lower(t.path), p))) = 0) DESC, t.path, t.id) AS rn
           FROM asked a JOIN tgt t ON t.name = a.actual JOIN tn ON tn.name = a.actual),
own AS (SELECT a.id, t.name, t.path, t.kind, t.line_start, row_number() OVER (PARTITION BY a.id ORDER BY t.path, t.id) AS rn FROM asked a JOIN tgt t ON t.name = a.local_name WHERE a.local_name <> a.actual)"""


def _register() -> None:
    _plain("status_counts", "SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM refs) AS \"references\"", symbols.status)
    _plain("find_symbols", f"SELECT {STORED} FROM {LOCATED} WHERE s.name = 'main'", lambda g: symbols.find_symbols(g, "main"))
    _plain("find_symbols_kind_file", f"SELECT {STORED} FROM {LOCATED} WHERE s.name = 'main' AND s.kind = 'function' AND f.path ILIKE '%/SRC/%'", lambda g: symbols.find_symbols(g, "main", "function", "/SRC/"))
    _plain("find_symbols_qualified", f"SELECT {STORED} FROM {LOCATED} JOIN symbols p ON s.parent_id = p.id WHERE s.name = 'large_rod_35' AND p.name = 'F35'", lambda g: symbols.find_symbols(g, "F35::large_rod_35"))
    _plain("list_symbols", f"SELECT {STORED} FROM {LOCATED}", symbols.list_symbols)
    _plain("list_symbols_kind_file", f"SELECT {STORED} FROM {LOCATED} WHERE s.kind = 'method' AND f.path ILIKE '%tests/%.RS%'", lambda g: symbols.list_symbols(g, "method", "tests/%.RS"))
    dead = f"SELECT {STORED} FROM {LOCATED} WHERE {CALLABLE} AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.target_name = s.name AND r.kind = 'call')"
    _plain("dead_code", dead, symbols.find_dead_code)
    _plain("dead_code_excluding", f"{dead} AND f.path ILIKE '%/src/%' AND s.name NOT IN ('large_rod_35', 'blue_rod_54')", lambda g: symbols.find_dead_code(g, "/src/", ["large_rod_35", "blue_rod_54"]))

    for depth in (1, 2, 3):
        sql, ctes = _callers("main", depth)
        _plain(f"callers_d{depth}", sql, lambda g, d=depth: calls.find_callers(g, "main", depth=d), *ctes)
        sql, ctes = _callees("main", depth)
        _plain(f"callees_d{depth}", sql, lambda g, d=depth: calls.find_callees(g, "main", depth=d), *ctes)
    _plain("callers_qualified", f"SELECT DISTINCT {CALLER} FROM {CALLS} WHERE r.kind = 'call' AND r.target_name = 'large_rod_35' AND r.target_qualifier = 'F35'", lambda g: calls.find_callers(g, "F35::large_rod_35"))
    by_file = "SELECT DISTINCT " + CALLER + " FROM resolved r JOIN files f ON r.source_file_id = f.id LEFT JOIN symbols s ON r.source_symbol_id = s.id WHERE r.kind = 'call' AND (SELECT count(*) FROM ids) > 0 AND (r.target_symbol_id IN (SELECT id FROM ids) OR (r.target_symbol_id IS NULL AND r.target_name = 'main'))"
    _plain("callers_by_file", by_file, lambda g: calls.find_callers(_of(g, "main"), "main", "/src/"), RESOLVED, f"ids AS (SELECT s.id FROM {LOCATED} WHERE s.name = 'main' AND f.path ILIKE '%/src/%')")
    _plain("callers_absent_file", f"SELECT DISTINCT {CALLER} FROM {CALLS} WHERE false", lambda g: calls.find_callers(g, "main", "/nowhere/"))
    _plain("callees_qualified_file", f"SELECT {CALLEE} FROM {CALLS} JOIN symbols p ON s.parent_id = p.id WHERE r.kind = 'call' AND s.name = 'large_rod_35' AND p.name = 'F35' AND f.path ILIKE '%n%'", lambda g: calls.find_callees(g, "F35.large_rod_35", "n"))

    ref = "SELECT f.path AS source_file, s.name AS source_symbol, r.target_name, r.target_qualifier, r.kind, r.line, r.target_symbol_id IS NOT NULL AS resolved, tf.path AS target_file, t.name AS target_symbol FROM resolved r JOIN files f ON r.source_file_id = f.id LEFT JOIN symbols s ON r.source_symbol_id = s.id LEFT JOIN symbols t ON r.target_symbol_id = t.id LEFT JOIN files tf ON t.file_id = tf.id"
    _plain("references_all", f"{ref} WHERE r.target_name = 'main'", lambda g: references.find_references(_of(g, "main"), "main"), RESOLVED)
    _plain("references_kind", f"{ref} WHERE r.target_name = 'F4' AND r.kind = 'inherit'", lambda g: references.find_references(_of(g, "F4"), "F4", "inherit"), RESOLVED)
    _plain("references_qualified", f"{ref} WHERE r.target_name = 'large_rod_35' AND r.target_qualifier = 'F35'", lambda g: references.find_references(_of(g, "large_rod_35"), "F35::large_rod_35"), RESOLVED)

    _plain("ancestors", ROWS["ancestor"], lambda g: hierarchy.find_hierarchy(g, "F4", "ancestors"), NAMES["ancestor"])
    _plain("descendants", ROWS["descendant"], lambda g: hierarchy.find_hierarchy(g, "F4", "descendants"), NAMES["descendant"])
    _plain("hierarchy_both", f"{ROWS['ancestor']} UNION ALL {ROWS['descendant']}", lambda g: hierarchy.find_hierarchy(g, "F4"), *NAMES.values())

    entry = "SELECT f.path AS {0}, i.local_name, i.full_path, i.alias, i.line FROM imports i JOIN files f ON i.file_id = f.id WHERE {1}"
    _plain("imports_lookup", entry.format("source_file", "(i.local_name = 'main' OR i.full_path ILIKE '%main%') AND f.path ILIKE '%src%'"), lambda g: imports.query_imports(g, "main", "src").select("source_file", "local_name", "full_path", "alias", "line"))
    _plain("imported_by", entry.format("file_path", "i.full_path ILIKE '%src::%'"), lambda g: imports.find_imported_by(g, "src::"))
    _plain("imported_by_file", entry.format("file_path", "i.full_path ILIKE '%app\\n1%' AND f.path ILIKE '%tests%'"), lambda g: imports.find_imported_by(g, "app\\n1", "tests"))
    targets = "SELECT a.source_file, a.local_name, a.full_path, a.alias, a.line, coalesce(r.path, o.path) AS target_file, coalesce(r.name, o.name) AS target_symbol, coalesce(r.kind, o.kind) AS target_kind, coalesce(r.line_start, o.line_start) AS target_line FROM asked a LEFT JOIN ranked r ON r.id = a.id AND r.rn = 1 LEFT JOIN own o ON o.id = a.id AND o.rn = 1"
    _plain("resolve_import", targets, lambda g: imports.resolve_import(g, "src::"), TARGETS.replace("\\\\\\\\", "\\\\"))
    _plain("import_symbol_names", "SELECT id, regexp_extract(full_path, '([^\\\\.:/]*)$', 1) AS symbol_name FROM imports", lambda g: g.imports.select("id", last_segment(F.col("full_path"), imports.MARKS).alias("symbol_name")))

    _plain("test_reachable", "SELECT name FROM reach", testing.test_reachable, EDGES, REACH)
    wide = "up AS (SELECT 'main' AS name, 0 AS d UNION SELECT s.name, up.d + 1 FROM up JOIN refs r ON r.kind = 'call' AND r.target_name = up.name JOIN symbols s ON r.source_symbol_id = s.id WHERE up.d < 10)"
    tested = f"SELECT {STORED} FROM {LOCATED} WHERE s.is_test = 1 AND s.name IN (SELECT name FROM up WHERE d > 0) UNION ALL SELECT {STORED} FROM {LOCATED} WHERE s.is_test = 1 AND s.name = 'main'"
    _plain("tested_by", tested, lambda g: testing.find_tested_by(g, "main"), wide)
    candidates = f"SELECT {STORED} FROM {LOCATED} WHERE {CALLABLE} AND s.is_test = 0 AND NOT (f.lang = 'qml' AND regexp_matches(s.name, '^on[A-Z]'))"
    _plain("untested_candidates", candidates, lambda g: testing.stored_symbols(testing.untested_candidates(g)))
    _plain("untested", f"{candidates} AND s.name NOT IN (SELECT name FROM reach)", testing.find_untested, EDGES, REACH)
    _plain("untested_path", f"{candidates} AND f.path ILIKE '%/src/n1%' AND s.name <> 'large_rod_35' AND s.name NOT IN (SELECT name FROM reach)", lambda g: testing.find_untested(g, "/src/n1", ["large_rod_35"]), EDGES, REACH)

    _plain("resolve_refs", "SELECT id, target_symbol_id, target_symbol_id IS NOT NULL AS resolved, rule FROM resolved", lambda g: resolve.resolve(g).select("id", "target_symbol_id", "resolved", "rule"), RESOLVED)
    _plain("resolve_stats", "SELECT count(*) AS total, count(target_symbol_id) AS resolved, count(*) FILTER (WHERE rule = 'ambiguous') AS ambiguous, count(*) FILTER (WHERE rule = 'unresolved') AS unresolved FROM resolved", lambda g: resolve.stats(resolve.resolve(g)), RESOLVED)
    inside = "SELECT r.id AS ref_id, arg_min(s.name, (s.line_end - s.line_start, s.id)) AS name FROM refs r JOIN symbols s ON s.file_id = r.source_file_id AND r.line BETWEEN s.line_start AND s.line_end GROUP BY r.id"
    _plain("enclosing_symbol", inside, lambda g: link.enclosing(g.symbols, g.refs.select(F.col("id").alias("ref_id"), F.col("source_file_id").alias("file_id"), "line")).select("ref_id", "name"))
    parents = "SELECT s.id, arg_min(p.id, p.id) AS parent_id FROM symbols s JOIN symbols q ON s.parent_id = q.id JOIN symbols p ON p.file_id = s.file_id AND p.name = q.name AND p.id < s.id GROUP BY s.id"
    _plain("link_parents", parents, lambda g: link.parents(g.symbols.select("id", "file_id", "name", F.col("id").alias("pos"), "parent_id").join(g.symbols.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name")), "parent_id").select("id", "file_id", "pos", "parent_name"), g.symbols.select("id", "file_id", "name", F.col("id").alias("pos"))))
    _plain("languages", "SELECT id, CASE regexp_extract(path, '([^.]*)$', 1) WHEN 'rs' THEN 'rust' WHEN 'php' THEN 'php' WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' ELSE 'qml' END AS lang FROM files", lambda g: g.files.select("id", link.language_of(F.col("path")).alias("lang")))

    said = "says AS (SELECT f.path, concat('open ', q.path, ' ', min(s.name)) AS content FROM files f JOIN symbols t ON t.file_id = f.id AND t.is_test = 1 JOIN files q ON q.id = f.id - f.id % 5 + 4 JOIN symbols s ON s.file_id = q.id AND s.kind IN ('function', 'method') GROUP BY f.path, q.path)"
    mention = "EXISTS (SELECT 1 FROM says c WHERE contains(c.content, s.name) AND contains(c.content, f.path))"
    _plain("untested_with_texts", f"{candidates} AND s.name NOT IN (SELECT name FROM reach) AND NOT (ends_with(f.path, '.qml') AND {mention})", lambda g: testing.find_untested(_with_texts(g)), EDGES, REACH, said)

    line = "trim(concat(s.kind, ' ', s.name, ' ', f.path, ':', CAST(s.line_start AS VARCHAR), '-', CAST(s.line_end AS VARCHAR)))"
    _plain("render_symbols", f"SELECT s.id, {line} AS line FROM {LOCATED} WHERE s.name = 'main'", lambda g: render.symbol_lines(symbols.find_symbols(g, "main")))
    shown = "concat('  [', r.kind, '] ', coalesce(s.name, '<file-level>'), ' in ', f.path, ':', CAST(r.line AS VARCHAR))"
    _plain("render_references", f"SELECT {shown} AS line FROM {CALLS} WHERE r.target_name = 'main'", lambda g: render.reference_lines(references.find_references(g, "main")))
    obj = "concat('{\"file_path\":\"', f.path, '\",\"local_name\":\"', i.local_name, '\",\"full_path\":\"', i.full_path, '\",\"alias\":', CASE WHEN i.alias IS NULL THEN 'null' ELSE concat('\"', i.alias, '\"') END, ',\"line\":', CAST(i.line AS VARCHAR), '}')"
    _plain("render_json", f"SELECT {obj} AS line FROM imports i JOIN files f ON i.file_id = f.id WHERE i.full_path ILIKE '%src::%'", lambda g: render.json_lines(imports.find_imported_by(g, "src::")))

    for lang, (syms, refs, imps) in expected.EXTRACTED.items():
        for part, names, rows in (("symbols", expected.SYMBOLS, syms), ("refs", expected.REFS, refs), ("imports", expected.IMPORTS, imps)):
            key = f"extract_{lang}_{part}"
            QUERIES[key] = lambda spark, _, lang=lang, part=part: samples.flat(samples.extracted(spark, lang), part)
            ORACLES[key] = expected.values(names, rows)
    QUERIES["ingest_index"] = lambda spark, _: samples.ingested(spark)
    QUERIES["stream_watch"] = lambda spark, _: samples.watched(spark)
    ORACLES["ingest_index"] = expected.rows_sql("file, name, kind, CAST(is_test AS INTEGER) AS is_test", expected.INGESTED)
    ORACLES["stream_watch"] = expected.rows_sql("name, kind", expected.WATCHED)


def _of(g: CodeGraph, name: str) -> CodeGraph:
    """The graph with the references that can mean a name, resolved."""
    return resolve.apply(g, resolve.of_name(g, name))


def _with_texts(g: CodeGraph) -> CodeGraph:
    """Texts for test files: each opens the .qml file of its block of five."""
    tests = g.symbols.where("is_test = 1").select(F.col("file_id").alias("id")).distinct().join(g.files, "id").select("path", (F.col("id") - F.col("id") % 5 + 4).alias("file_id"))
    first = g.symbols.where(F.col("kind").isin("function", "method")).groupBy("file_id").agg(F.min("name").alias("name"))
    texts = tests.join(first, "file_id").join(g.paths(name="opened"), "file_id")
    return CodeGraph(g.files, g.symbols, g.refs, g.imports, texts.select("path", F.concat_ws(" ", F.lit("open"), "opened", "name").alias("content")))


_register()
