"""Words, context trees, toxicity and language against plain Python."""

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import bytesops as B
from graphloom.llm import ctw, langid, toxicity
from graphloom.llm.common import remainder_is_two

ODD = ["", None, " \t\n", "a", "One two  three four five six", "É É é\x00\x0bB", "x" * 3000, "w " * 5000]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


def frame(spark, texts, ids=None, langs=None):
    ids = list(range(len(texts))) if ids is None else ids
    langs = ["en"] * len(texts) if langs is None else langs
    return spark.createDataFrame([(i, t, lang, None, None, 1.0) for i, t, lang in zip(ids, texts, langs)], SCHEMA)


def plain_words(text):
    return (text or "").encode().lower().split()


def test_words_and_shingles_match_python():
    data, offsets = B.text_bytes(pa.array(ODD))
    h, doc = B.words(data, offsets)
    expect = [(i, w) for i, t in enumerate(ODD) for w in plain_words(t)]
    assert doc.tolist() == [i for i, _ in expect]
    of = {}
    for (_, w), x in zip(expect, h.tolist()):
        assert of.setdefault(w, x) == x
    assert len(set(of.values())) == len(of)
    doc, _, count = B.shingles(data, offsets)
    for i, t in enumerate(ODD):
        w = plain_words(t)
        want = collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else {}
        assert sorted(count[doc == i].tolist()) == sorted(want.values())


def test_very_long_text_is_cut_between_words():
    text = "abc de\n" * 400_000 + "z" * (3 << 20)
    h, _ = B.words(*B.text_bytes(pa.array([text, "tail"])))
    assert len(h) == 800_002


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


def brute_tree(train, test, depth):
    """CTW by its definition, with dictionaries of contexts."""
    counts = collections.defaultdict(collections.Counter)
    for t in train:
        x = b"\xff" * depth + t + b"\xff"
        for i in range(depth, len(x)):
            for d in range(depth + 1):
                counts[x[i - d : i]][x[i]] += 1
    kept = set(counts)

    def children(c):
        return [bytes([o]) + c for o in range(256) if bytes([o]) + c in kept] if len(c) < depth else []

    def split(counter, prefix, length):
        a = b = 0
        for s, n in counter.items():
            if s >> (8 - length) == prefix:
                if s >> (7 - length) & 1:
                    b += n
                else:
                    a += n
        return a, b

    memo = {}

    def weighted(c, prefix, length):
        key = (c, prefix, length)
        if key not in memo:
            own = kt(*split(counts[c], prefix, length))
            if len(c) == depth:
                memo[key] = (own, own, None)
            else:
                below = sum(weighted(k, prefix, length)[0] for k in children(c))
                memo[key] = (math.log(0.5) + max(own, below) + math.log(math.exp(own - max(own, below)) + math.exp(below - max(own, below))), own, below)
        return memo[key]

    out = 0.0
    x = b"\xff" * depth + test + b"\xff"
    for i in range(depth, len(x)):
        for length in range(8):
            prefix, bit = x[i] >> (8 - length), x[i] >> (7 - length) & 1
            p, left, c = 0.0, 1.0, b""
            while True:
                a, b = split(counts[c], prefix, length)
                one = (b + 0.5) / (a + b + 1)
                if len(c) == depth:
                    p += left * one
                    break
                _, own, below = weighted(c, prefix, length)
                share_ = 1 / (1 + math.exp(below - own))
                p, left = p + left * share_ * one, left * (1 - share_)
                older = bytes([x[i - len(c) - 1]]) + c
                if older not in kept:
                    p += left / 2
                    break
                c = older
            out += math.log10(p if bit else 1 - p)
    return out


@pytest.mark.parametrize("depth, share", [(3, 0.0), (3, 0.02), (6, 1e-3)])
def test_context_tree_matches_its_definition(spark, depth, share):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab e\n") for _ in range(rng.randint(0, 40))) for _ in range(12)]
    docs = frame(spark, texts)
    model = ctw.learn(docs, remainder_is_two("doc_id", 7), depth=depth, gram_share=share)
    train = [t.encode() for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    got = {r.doc_id: r for r in ctw.score(docs, model, learned=True).collect()}
    for i in range(0, 12, 3):
        assert got[i].score == pytest.approx(brute_tree(train, texts[i].encode(), depth), abs=1e-4)
    # texts that were not there when the model learned
    others = ["abba cab", "zz", "", "e\ne\n ab"]
    for r in ctw.score(frame(spark, others), model).collect():
        assert r.score == pytest.approx(brute_tree(train, others[r.doc_id].encode(), depth), abs=1e-4)


def test_probabilities_of_a_context_add_up_to_one(spark):
    rng = random.Random(5)
    model = ctw.learn(frame(spark, ["".join(rng.choice("abc ") for _ in range(300))]), F.lit(False), depth=4)
    context = int.from_bytes(b"ba c"[::-1], "little")
    new = spark.createDataFrame([(context << 8 | s, 0) for s in range(256)], "key long, n long").join(model.seen, "key", "left_anti")
    logs = ctw.gram_logs(model.seen.unionByName(new), 4).where(F.shiftright("key", 8) == context).collect()
    assert len(logs) == 256 and sum(10**r.value for r in logs) == pytest.approx(1, abs=1e-9)


def test_long_texts_keep_their_context_at_a_cut(spark):
    unit = "the quick brown fox jumps over the lazy dog "
    docs = frame(spark, [unit * 60_000, unit])  # 2.6 MB: three pieces
    model = ctw.learn(docs, F.lit(False))
    total = sum(r.n for r in model.seen.collect())
    assert total == len(unit) * 60_001 + 2
    # grams are those of the endless repetition but at the two beginnings and ends
    assert model.seen.count() <= len(unit) + 2 * (ctw.DEPTH + 1)


@pytest.mark.parametrize("share", [1e-6, 0.05])
def test_base_score_and_counts(spark, share):
    texts = [*ODD, "One two", "rare word", "One two", "a a A a"]
    ids = [*range(len(ODD)), 50, 51, 50, None]
    docs = frame(spark, texts, ids)
    model = ctw.learn(docs, remainder_is_two("doc_id", 7), depth=2, word_share=share)
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i in ids]
    c = collections.Counter()
    for t, h in zip(texts, held):
        if not h:
            c.update([*plain_words(t), None])
    n, v = sum(c.values()), len(c)
    rows = ctw.score(docs, model).collect()
    assert model.total == n and model.distinct == v and len(rows) == len(texts)
    want = collections.defaultdict(list)
    for i, t in zip(ids, texts):
        tokens = [*plain_words(t), None]
        want[i].append((len(tokens), sum(c[w] > 0 for w in tokens), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens)))
    for r in rows:
        best = want[r.doc_id][0]
        assert (r.n_tokens, r.n_known) == best[:2]
        assert r.base_score == pytest.approx(best[2], rel=1e-9)


def test_scoring_of_empty_tables(spark):
    docs = frame(spark, [])
    model = ctw.learn(docs, remainder_is_two("doc_id", 7))
    assert ctw.score(docs, model).count() == 0
    assert ctw.score(frame(spark, ["ab"]), model).first().score == pytest.approx(-3 * 8 * math.log10(2), rel=1e-6)


def test_lookup_has_every_value_or_none():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 62, 5000)).astype(np.uint64)
    keys = np.concatenate([np.zeros(1, np.uint64), keys])
    got = ctw.Lookup(keys, np.arange(len(keys), dtype=float)).get(np.concatenate([keys, keys + np.uint64(1)]))
    has = ~np.isnan(got)
    assert has[: len(keys)].mean() > 0.99 and not has[len(keys) + 1 :].any()
    assert (got[: len(keys)] == np.arange(len(keys)))[has[: len(keys)]].all()
    assert np.isnan(ctw.Lookup(keys[:0], np.zeros(0)).get(keys)).all()


def test_toxicity_learns_words_and_pairs(spark):
    rng = random.Random(1)
    texts, toxic = [], []
    for _ in range(400):
        words = [f"w{rng.randint(0, 40)}" for _ in range(20)]
        # an insult or a group alone is harmless, both together are toxic
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words += ["clownish"] * a + ["farmers"] * b
        rng.shuffle(words)
        texts.append(" ".join(words))
        toxic.append(int(a and b))
    docs = frame(spark, texts)
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int").selectExpr("*", "'x' as text")
    held = remainder_is_two("doc_id", 4)
    model = toxicity.fit(docs, labels, held)
    assert (model.v != 0).any()
    rows = toxicity.score(docs, model, kept=["doc_id"]).withColumn("held", held).where("held").collect()
    right = [r.predicted == toxic[r.doc_id] for r in rows]
    assert len(rows) > 60 and np.mean(right) > 0.95


def test_toxicity_learns_a_pair_of_terms_that_say_nothing_alone(spark):
    """Toxic if both or neither are there: each of them is in half of either class."""
    rng = random.Random(2)
    texts, toxic = [], []
    for k in range(1200):
        words = [f"w{rng.randint(0, 30)}" for _ in range(8)]
        a, b = k % 2, k // 2 % 2
        texts.append(" ".join([*words, *["clownish"] * a, *["farmers"] * b]))
        toxic.append(int(a == b))
    docs = frame(spark, texts)
    held = remainder_is_two("doc_id", 4)
    model = toxicity.fit(docs, spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int"), held)
    rows = toxicity.score(docs, model, threshold=0.5, kept=["doc_id"]).withColumn("held", held).where("held").collect()
    assert np.mean([r.predicted == toxic[r.doc_id] for r in rows]) > 0.9


def test_the_machine_is_a_sum_over_pairs(spark):
    rng = np.random.default_rng(4)
    size = 1 << toxicity.BITS
    evidence = rng.random(size).astype(np.float32)
    evidence[rng.random(size) < 0.2] = np.nan
    m = toxicity.Machine(-0.3, evidence, rng.normal(0, 0.1, size).astype(np.float32), rng.normal(0, 0.1, (size, 3)).astype(np.float32))
    texts = ["One two three", "one ONE one", "", None, "alphabet alphabets soup of letters", "w " * 700_000 + "alphabet"]
    got = {r.doc_id: r.score for r in toxicity.score(frame(spark, texts), m).collect()}
    for i, t in enumerate(texts):
        words = sorted(set(plain_words(t)))
        held = set()
        for w in words:
            data, offsets = B.text_bytes(pa.array([w.decode()]))
            held |= {int(b) for _, bs in toxicity.present(data, offsets) for b in bs}
        known = sorted(b for b in held if not np.isnan(evidence[b]))
        x = {b: 3 / math.sqrt(len(held)) + float(evidence[b]) for b in known}
        z = -0.3 + sum(float(m.w[b]) * x[b] for b in known)
        z += sum(float(m.v[b].astype(float) @ m.v[c].astype(float)) * x[b] * x[c] for k, b in enumerate(known) for c in known[:k])
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)


def test_toxicity_learns_once_from_repeated_rows(spark):
    texts = ["bad words here", "good words here"] * 20
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)], "doc_id long, toxic int")
    held = remainder_is_two("doc_id", 4)
    docs = frame(spark, texts)
    once, twice = toxicity.fit(docs, labels, held), toxicity.fit(docs.unionByName(docs), labels, held)
    assert once.bias == twice.bias and (once.w == twice.w).all() and (once.v == twice.v).all()


def test_toxicity_defined_cases(spark):
    docs = frame(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, none, remainder_is_two("doc_id", 4))
    assert {r.score for r in toxicity.score(docs, model).collect()} == {0.5}
    one = spark.createDataFrame([(3, 0), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, one, remainder_is_two("doc_id", 4))
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(ODD) and all(r.score < 0.3 and r.predicted == 0 for r in rows)
    assert toxicity.score(frame(spark, []), model).count() == 0


def test_language_by_centroids(spark):
    rng = random.Random(2)
    sounds = {"aa": ["the", "ing", "wh"], "bb": ["sch", "ung", "ein"], "cc": ["eau", "oi", "ment"]}
    texts, langs = [], []
    for k in range(150):
        lang = list(sounds)[k % 3]
        texts.append(" ".join("".join(rng.choice(sounds[lang]) for _ in range(3)) for _ in range(15)))
        langs.append(lang)
    docs = frame(spark, texts, langs=langs)
    held = remainder_is_two("doc_id", 4)
    model = langid.fit(docs, held)
    rows = langid.predict(docs, model, ["doc_id", "lang"]).withColumn("held", held).where("held").collect()
    assert rows and all(r.lang == r.lang_pred and not r.rejected and 0 <= r.score <= 1 for r in rows)
    odd = {r.doc_id: r for r in langid.predict(frame(spark, [*ODD, "漢字漢字"]), model).collect()}
    assert odd[0].lang_pred == odd[1].lang_pred == odd[2].lang_pred == "und" and odd[1].score == 0
    assert odd[8].rejected and odd[8].lang_pred in sounds
    assert langid.predict(frame(spark, []), model).count() == 0
    assert langid.fit(frame(spark, []), held) is None
    assert {r.lang_pred for r in langid.predict(docs.limit(3), None).collect()} == {"und"}


def test_every_language_is_learned(spark):
    """130 languages, each with letters of its own: none goes without centroids."""
    texts, langs = [], []
    for k in range(130):
        own = chr(0x4E00 + 40 * k) + chr(0x4E01 + 40 * k)
        for j in range(4):
            texts.append(" ".join([own, own + own[0], own[1] * 2] * (3 + j)))
            langs.append(f"l{k:03d}")
    docs = frame(spark, texts, langs=langs)
    model = langid.fit(docs, remainder_is_two("doc_id", 4))
    assert set(model.langs) == set(langs) and model.langs == sorted(model.langs)
    rows = langid.predict(docs, model, ["doc_id", "lang"]).collect()
    assert len(rows) == len(texts) and all(r.lang == r.lang_pred and not r.rejected for r in rows)


def test_gram_frequencies_come_from_all_training_rows(spark):
    texts = [f"abc {'xyz' * (k % 7 == 0)} def" for k in range(60)] + ["sch ung"] * 6
    docs = frame(spark, texts, langs=["aa"] * 60 + ["bb"] * 6)
    held = remainder_is_two("doc_id", 4)
    model = langid.fit(docs, held, sample=5)
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 4 != 2]
    seen = sum((tf > 0).sum(0) for _, tf in langid.counts(*B.text_bytes(pa.array(train))))
    assert np.allclose(model.idf, np.log((1 + len(train)) / (1 + seen)) + 1, atol=1e-6)


def test_columns_with_clashing_names_are_kept(spark):
    from graphloom.llm import packing

    docs = frame(spark, ["one two", None, "three"]).selectExpr("*", "1 as _text", "2 as __text", "3 as _h", "4 as Predicted", "6 as letters")
    m = toxicity.Machine(0.0, np.full(1 << toxicity.BITS, np.nan, np.float32), np.zeros(1 << toxicity.BITS, np.float32), np.zeros((1 << toxicity.BITS, 1), np.float32))
    for out in (toxicity.score(docs, m), langid.predict(docs, None), packing.pack(docs)):
        rows = out.collect()
        assert len(rows) == 3 and all((r["_text"], r["__text"], r["_h"], r["letters"]) == (1, 2, 3, 6) for r in rows)
