"""The corpus pipeline: toxicity, language, near duplicates, packing.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and
returns what it keeps.  run() writes each stage's result as Parquet to the
shared folder and hands the reread table to the next; what a stage has read is
deleted then.

Defined cases, for all stages: null text counts as empty.  An empty text, or one
without a letter, has no language and is rejected by the second stage.  A null
doc_id takes part and is no training row by its label.  Long texts are read whole.
Repeated rows are judged alike; of rows with one id and of equal texts one stays in
the third stage.  Ties go to the least id.  No rows give none.  The first three stages
return the columns that they were given, values and names as they were, whatever
those names are; the last returns doc_id and the batch's columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import langid, minhash, packing, toxicity
from graphloom.llm.common import discard, durable, plain_names, read, remainder_is_two

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under 0.3."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), remainder_is_two("doc_id", 4))
    plain, back = plain_names(docs, ("doc_id", "text"))
    return back(toxicity.score(plain, model).where("predicted = 0"))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near enough to a centroid of a learned language."""
    model = langid.fit(docs, remainder_is_two("doc_id", 4))
    plain, back = plain_names(docs, ("doc_id", "text"))
    return back(langid.predict(plain, model).where("not rejected"))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the least id, of each class of exact and near copies."""
    return minhash.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its length bucket and batch."""
    return packing.pack(docs, kept=["doc_id"])


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_languages),
    ("minhash_near_dedup", one_of_each_class),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        kept = durable(stage(spark, docs, sf_dir), name)
        discard(docs)  # the table of the stage before; the given documents stay
        docs = kept
    return docs


#: Trained scores, k-means and MinHash have no SQL form; tests use brute force.
ORACLE_SQL = None
