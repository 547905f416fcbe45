"""A deterministic code graph derived from the driver's business tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.plans.catalog import CodeGraph

TABLES = ("supplier", "part", "customer", "orders")

#: The derivation, in SQL that Spark and DuckDB read alike; {table} is a given table.
TEMPLATE = """
files AS (
  SELECT s_suppkey AS id,
    concat('/repo/', CASE WHEN s_suppkey % 4 = 0 THEN 'tests' ELSE 'src' END,
           '/n', CAST(s_nationkey AS VARCHAR(20)), '/f', CAST(s_suppkey AS VARCHAR(20)),
           CASE s_suppkey % 5 WHEN 0 THEN '.rs' WHEN 1 THEN '.php' WHEN 2 THEN '.py'
                              WHEN 3 THEN '.ts' ELSE '.qml' END) AS path,
    CASE s_suppkey % 5 WHEN 0 THEN 'rust' WHEN 1 THEN 'php' WHEN 2 THEN 'python'
                       WHEN 3 THEN 'typescript' ELSE 'qml' END AS lang
  FROM {supplier}),
symbols AS (
  SELECT p_partkey AS id, CAST(floor(p_partkey / 20) AS BIGINT) AS file_id,
    CASE WHEN p_partkey % 80 = 40 THEN concat('F', CAST(CAST(floor(p_partkey / 20) AS BIGINT) % 50 AS VARCHAR(20)))
         WHEN p_partkey % 20 = 0 THEN concat('F', CAST(CAST(floor(p_partkey / 20) AS BIGINT) AS VARCHAR(20)))
         WHEN p_size <= 2 THEN 'main'
         WHEN p_partkey % 100 = 87 THEN concat('onMoved', CAST(p_partkey % 7 AS VARCHAR(20)))
         ELSE concat(replace(p_name, ' ', '_'), '_', CAST(p_partkey % 97 AS VARCHAR(20))) END AS name,
    CASE WHEN p_partkey % 40 = 0 THEN 'class' WHEN p_partkey % 20 = 0 THEN 'trait'
         WHEN p_partkey % 3 = 0 THEN 'method' WHEN p_partkey % 20 = 19 THEN 'struct'
         ELSE 'function' END AS kind,
    (p_partkey % 20) * 10 AS line_start, (p_partkey % 20) * 10 + 8 AS line_end,
    CASE WHEN p_partkey % 20 <> 0 AND p_partkey % 3 = 0 THEN p_partkey - p_partkey % 20 END AS parent_id,
    CASE WHEN CAST(floor(p_partkey / 20) AS BIGINT) % 4 = 0 AND p_partkey % 20 > 0 AND p_size % 5 = 0
         THEN 1 ELSE 0 END AS is_test
  FROM {part}),
sz AS (SELECT a.np, b.nf FROM (SELECT count(*) AS np FROM {part}) a CROSS JOIN (SELECT count(*) AS nf FROM {supplier}) b),
imports AS (
  SELECT c.c_custkey AS id, (c.c_custkey * 7) % sz.nf AS file_id,
    CASE WHEN c.c_custkey % 4 = 0 THEN concat('Alias', CAST(c.c_custkey AS VARCHAR(20))) ELSE s.name END AS local_name,
    CASE WHEN c.c_custkey % 4 = 1 THEN concat('n', CAST(n.s_nationkey AS VARCHAR(20)), '/f', CAST(s.file_id AS VARCHAR(20)))
      WHEN c.c_custkey % 3 = 0 THEN concat('src::n', CAST(n.s_nationkey AS VARCHAR(20)), '::', s.name)
      WHEN c.c_custkey % 3 = 1 THEN concat('App', chr(92), 'n', CAST(n.s_nationkey AS VARCHAR(20)), chr(92), s.name)
      ELSE concat('repo.n', CAST(n.s_nationkey AS VARCHAR(20)), '.', s.name) END AS full_path,
    CASE WHEN c.c_custkey % 4 = 0 THEN concat('Alias', CAST(c.c_custkey AS VARCHAR(20))) END AS alias,
    c.c_custkey % 30 AS line
  FROM {customer} c CROSS JOIN sz
  JOIN symbols s ON s.id = CASE WHEN c.c_custkey % 2 = 0
                                THEN (c.c_custkey * 20) % sz.np ELSE c.c_custkey END
  JOIN {supplier} n ON n.s_suppkey = s.file_id),
refs AS (
  SELECT o.o_orderkey AS id, s.file_id AS source_file_id,
    CASE WHEN o.o_orderkey % 17 <> 0 THEN s.id END AS source_symbol_id,
    CASE WHEN t.kind IN ('class', 'trait')
         THEN CASE o.o_orderkey % 3 WHEN 0 THEN 'inherit' WHEN 1 THEN 'implement' ELSE 'trait_impl' END
         ELSE 'call' END AS kind,
    CASE WHEN o.o_orderkey % 13 = 0 THEN concat('ext_', t.name) ELSE t.name END AS target_name,
    CASE WHEN o.o_orderkey % 5 < 2 THEN p.name END AS target_qualifier,
    s.line_start + o.o_orderkey % 8 AS line
  FROM {orders} o CROSS JOIN sz
  JOIN symbols s ON s.id = o.o_orderkey % sz.np
  JOIN symbols t ON t.id = o.o_custkey
  LEFT JOIN symbols p ON t.parent_id = p.id
  UNION ALL
  SELECT 100000000 + i.id, i.file_id, CAST(NULL AS BIGINT), 'call', i.local_name, CAST(NULL AS VARCHAR(20)), i.line
  FROM imports i WHERE i.id % 4 IN (0, 1))"""
CTES = TEMPLATE.format(**{t: t for t in TABLES})
#: For Spark: what grows with the tables is merged, not broadcast (see tables.growing).
MERGED = TEMPLATE.replace("imports AS (\n  SELECT", "imports AS (\n  SELECT /*+ MERGE(s, n) */").replace("refs AS (\n  SELECT", "refs AS (\n  SELECT /*+ MERGE(s, t, p) */")


def _whole(df: DataFrame, ddl: str) -> DataFrame:
    """All columns of the schema, in order; those that are missing are null."""
    from pyspark.sql.types import StructType

    want = StructType.fromDDL(ddl)
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])


def graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    # the tables are arguments of the query, so no view of the caller's is touched
    given = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    of = lambda table: spark.sql(f"WITH {MERGED} SELECT * FROM {table}", **given)
    refs = _whole(of("refs"), schema.REFS).withColumn("resolved", F.lit(False))
    return CodeGraph(_whole(of("files"), schema.FILES), _whole(of("symbols"), schema.SYMBOLS), refs, _whole(of("imports"), schema.IMPORTS))
