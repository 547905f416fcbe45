"""The queries opN_<name> and the pipeline, with SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import additive, archive, audit, ctw, divergence, fingerprints, langid, licences, minhash, packing, pieces, toxicity, urls
from graphloom.llm.common import read, remainder_is_two, shared_dir


def op1_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = remainder_is_two("doc_id", 7)
    model = ctw.learn(docs, held)
    return ctw.score(docs, model, learned=True).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree source/lang/block: every 64th id is a block's
    licence file, every 1024th that of its language, every 8192nd of its source."""
    i, part = F.col("doc_id"), lambda c: F.coalesce(F.col(c), F.lit("none"))
    block = F.floor(i / 64).cast("string")
    path = (
        F.when(i % 8192 == 0, F.concat_ws("/", part("source"), F.lit("LICENSE")))
        .when(i % 1024 == 0, F.concat_ws("/", part("source"), part("lang"), F.lit("LICENSE")))
        .when(i % 64 == 0, F.concat_ws("/", part("source"), part("lang"), block, F.lit("LICENSE")))
        .otherwise(F.concat_ws("/", part("source"), part("lang"), block, F.concat(i.cast("string"), F.lit(".txt"))))
    )
    return docs.select("doc_id", path.alias("path"), "text")


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(document_files(read(spark, sf_dir, "documents")))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(read(spark, sf_dir, "documents"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = remainder_is_two("doc_id", 4)
    model = langid.fit(docs, held)
    return langid.predict(docs, model, ["doc_id"]).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op5_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return additive.search(rows, rows.where("vec_id % 50 = 0"), k=5)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), kept=["doc_id"])


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every text, their hash, and whether they decode to the text."""
    v = pieces.load()
    docs = read(spark, sf_dir, "documents")
    ids = pieces.encode(docs, v, ["doc_id", "text"])
    back = pieces.decode(ids.select("doc_id", F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), F.xxhash64("text").alias("h"), "ids"), v, ["doc_id", "n_pieces", "ids_hash", "h"])
    return back.select("doc_id", "n_pieces", "ids_hash", (F.xxhash64("text") == F.col("h")).alias("exact"))


URL_RULES = [
    urls.domain_rule("block", "net/"),
    urls.domain_rule("allow", "example.net/en/"),
    urls.domain_rule("block", "example.com/de/"),
    urls.domain_rule("allow", "org/fr/"),
]


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES + urls.general_rules())
    return judged.select("page_id", "host", "path", F.when(F.col("level") == 0, F.col("rule")).alias("rule"), "verdict")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = remainder_is_two("doc_id", 4)
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), held)
    return toxicity.score(docs, model, kept=["doc_id"]).select("doc_id", held.alias("held_out"), "score", "predicted")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(read(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def op12_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as archives to the shared folder, then read from there."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    mark = archive.write(read(spark, sf_dir, "pages"), path)
    return archive.read(spark, path, mark, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ctw": op1_ctw,
    "op2_licences": op2_licences,
    "op3_minhash": op3_minhash,
    "op4_langid": op4_langid,
    "op5_additive": op5_additive,
    "op6_packing": op6_packing,
    "op7_pieces": op7_pieces,
    "op8_urls": op8_urls,
    "op9_toxicity": op9_toxicity,
    "op10_fingerprints": op10_fingerprints,
    "op11_divergence": op11_divergence,
    "op12_archive": op12_archive,
    "op13_audit": op13_audit,
    "pipeline": pipeline,
}

#: The word rules as one alternation each; a space stands for what is between tokens.
_either = lambda words: "|".join(w.replace(" ", "[^a-z0-9/]+") for w in words)

ORACLES: dict[str, str] = {
    "op8_urls": f"""
WITH split AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
judged AS (
  SELECT *, translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_path, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM split)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
       WHEN rule IS NOT NULL THEN 'allow'
       WHEN host = '' THEN 'allow'
       WHEN regexp_matches(concat(host, lower_path), '(^|[^a-z0-9])({_either(urls.WORDS)})([^a-z0-9]|$)') THEN 'block'
       WHEN regexp_matches(host, '(^|[^a-z0-9])({_either(urls.HOST_WORDS)})([^a-z0-9]|$)') THEN 'block'
       ELSE 'allow' END AS verdict
FROM judged
""",
    "op11_divergence": r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
words AS (SELECT row_id, lang, source, unnest(words) AS term FROM docs),
langs AS (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT row_id) >= 30),
sizes AS (SELECT lang, count(*) AS v, sum(n) AS total FROM langs GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
cells AS (SELECT lang, source, term, count(*) AS n FROM words JOIN langs USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM cells GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * z.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 5)) // (z.total + 5 * z.v) AS q
  FROM groups g JOIN langs k ON k.lang = g.lang JOIN sizes z ON z.lang = g.lang
  LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value
             FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
every AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
  CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM every QUALIFY part = 'pair' OR rank <= 50
""",
    "op12_archive": r"""
WITH bits AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
    min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, 1 + (i // 8) * 10, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INTEGER, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM bits
""",
    "op13_audit": r"""
WITH texts AS (
  SELECT d.doc_id, coalesce(d.source, '') AS part, coalesce(d.text, '') AS text,
    min(d.doc_id) OVER (PARTITION BY coalesce(d.text, '')) AS first,
    list_filter(regexp_split_to_array(coalesce(d.text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
  FROM documents d LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id),
judged AS (
  SELECT part, good, toxic, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(first < doc_id, false)] AS fails
  FROM texts),
masks AS (SELECT part, good, toxic, fails, count(*) AS n FROM judged GROUP BY ALL),
letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS f),
orders AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
seen AS (
  SELECT m.part, s.o, s.step, m.n, m.good, m.toxic, m.fails[s.o[s.step]] AS here,
    len(list_filter(s.o[1:s.step - 1], lambda f: m.fails[f])) > 0 AS earlier, len(list_filter(m.fails, lambda x: x)) AS many
  FROM masks m, steps s),
counted AS (
  SELECT part, o, step,
    sum(n) FILTER (WHERE NOT here AND NOT earlier) AS kept, sum(n) FILTER (WHERE here AND NOT earlier) AS removed,
    sum(n) FILTER (WHERE here AND earlier) AS redundant, sum(n) FILTER (WHERE here AND many = 1) AS unique_fails,
    sum(n) FILTER (WHERE here AND NOT earlier AND good) AS good_lost, sum(n) FILTER (WHERE here AND NOT earlier AND toxic) AS toxic_lost
  FROM seen GROUP BY ALL)
SELECT part, list_aggregate(list_transform(o, lambda f: substr('ABCDE', f, 1)), 'string_agg', '') AS filter_order, CAST(step AS INTEGER) AS step,
  CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
  CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, o[step]) AS BIGINT) AS shapley
FROM counted
""",
}
