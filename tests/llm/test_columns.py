"""Columns of the caller that are named like those of operators and stages."""

import pytest

import corpus_pipeline
from graphloom.llm import licences, minhash, pieces
from graphloom.llm.common import named, plain_names

SMALL = "/root/testdata/sf0.001"
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, rows long, _tid string, _key string, _in string, score string, rejected string, predicted string, lang_pred string, `a.b` string, `c``d` string, _c3 string"


@pytest.fixture(scope="module")
def wide(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()
    rows = [(*d, d.doc_id * 7, *(f"{name}{d.doc_id}" for name in "abcdefghij")) for d in docs]
    return spark.createDataFrame(rows, CLASHING)


def by_id(df):
    return {r[0]: tuple(r) for r in df.collect()}


def test_names_come_back(wide):
    plain, back = plain_names(wide, ("doc_id", "text"))
    assert back(plain).columns == wide.columns and by_id(back(plain)) == by_id(wide)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_the_callers_columns(spark, wide, stage):
    all_ = by_id(wide)
    got = stage(spark, wide, SMALL)
    assert got.columns == wide.columns
    rows = by_id(got)
    assert len(rows) > 100 and all(all_[i] == r for i, r in rows.items())


def test_the_last_stage_takes_any_columns(spark, wide):
    got = corpus_pipeline.STAGES[-1][1](spark, wide, SMALL)
    assert set(by_id(got)) == set(by_id(wide))


def test_more_hot_buckets_than_a_broadcast_holds(wide, monkeypatch):
    monkeypatch.setattr(minhash, "HOT", 1)
    monkeypatch.setattr(minhash, "HOT_BUCKETS", 5)
    few = wide.where("doc_id < 60")
    want = {r.doc_id: r.class_id for r in minhash.classes(few).collect()}
    monkeypatch.undo()
    assert want == {r.doc_id: r.class_id for r in minhash.classes(few).collect()}


def test_pieces_keep_the_callers_columns(wide):
    v = pieces.load()
    some = wide.limit(5)
    ids = pieces.encode(some, v)
    assert ids.columns == [*wide.columns, "ids"]
    back = pieces.decode(ids.select(*named([c for c in ids.columns if c != "text"])), v)
    assert {r.doc_id: r.text for r in back.collect()} == {r.doc_id: r.text for r in some.collect()}
    assert {r["_in"] for r in back.collect()} == {r["_in"] for r in some.collect()}


@pytest.mark.parametrize("text", ["Licensed under MIT", "MIT licensed", "MIT-licensed", "Released under the MIT licence", "Released under the MIT License", "MIT License", "The MIT License (MIT)"])
def test_short_mit_forms(spark, text):
    files = spark.createDataFrame([(1, "src/a.c", f"// {text}\nint a;"), (2, "src/b.c", "Wir gehen mit dem Hund und mit der Katze"), (3, "src/c.c", "available mit licence")], "doc_id long, path string, text string")
    got = {r.doc_id: r.licence for r in licences.scan(files).collect()}
    assert got[1] == "MIT" and got[2] is None
