"""Near duplicates, packing, fingerprints and neighbours against brute force."""

import collections
import hashlib
import itertools
import random

import numpy as np
import pytest

from graphloom.llm import additive, fingerprints, minhash, packing
from graphloom.llm.components import components
from tests.llm.test_bytes_models import ODD, frame, plain_words


def shingles(text):
    w = plain_words(text)
    return collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter()


def jp(x, y):
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in x | y) for i in x if i in y)


def brute_classes(texts, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [shingles(t) for t in texts]
    for (a, s, x), (b, t, y) in itertools.combinations(zip(ids, texts, sets), 2):
        if (s or "") == (t or "") or (x and y and jp(x, y) >= 0.8 - 1e-9):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {i: find(i) for i in ids}


def copies(rng, n, edits, length=60):
    base = [f"t{rng.randint(0, 5000)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 9999)}"
        out.append(" ".join(w))
    return out


def test_similarity_is_the_probability_jaccard():
    rng = random.Random(3)
    for _ in range(20):
        x = collections.Counter(rng.choices(range(12), k=15))
        y = collections.Counter(rng.choices(range(12), k=15))
        a, b = sorted(x), sorted(y)
        got = minhash.similarity(np.array(a, np.uint64), np.array([x[k] for k in a]), np.array(b, np.uint64), np.array([y[k] for k in b]))
        assert got == pytest.approx(jp(x, y))


def test_registers_agree_with_the_similarity():
    x, y = {k: 1 + k % 3 for k in range(60)}, {k: 1 + k % 4 for k in range(15, 75)}
    doc = np.array([0] * len(x) + [1] * len(y))
    s = (np.array([*x, *y], np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    r = minhash.signatures(doc, s, np.array([*x.values(), *y.values()]), 2, size=4000)
    assert (r != 0).all()
    assert (r[0] == r[1]).mean() == pytest.approx(jp(collections.Counter(x), collections.Counter(y)), abs=0.03)


@pytest.mark.parametrize("hot", [3, 1 << 20])
def test_classes_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(minhash, "HOT", hot)
    monkeypatch.setattr(minhash, "LEFT", 4)
    monkeypatch.setattr(minhash, "RIGHT", 6)
    rng = random.Random(8)
    texts = [*ODD, *copies(rng, 40, 4), *copies(rng, 25, 2), *copies(rng, 6, 1, 5), "one two", "one two", "ONE two", *["same text of many words here"] * 30]
    texts += [" ".join(f"u{rng.randint(0, 9999)}" for _ in range(30)) for _ in range(30)]
    rng.shuffle(texts)
    ids = rng.sample(range(1000), len(texts))
    got = {r.doc_id: (r.class_id, r.class_size) for r in minhash.classes(frame(spark, texts, ids)).collect()}
    want = brute_classes(texts, ids)
    assert {i: c for i, (c, _) in got.items()} == want
    sizes = collections.Counter(want.values())
    assert all(n == sizes[c] for c, n in got.values())
    kept = minhash.one_of_each(frame(spark, texts, ids))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(sizes) and "score" in kept.columns


def test_classes_defined_cases(spark):
    assert minhash.classes(frame(spark, [])).count() == 0
    docs = frame(spark, ["a b", "a b", "c d", None, ""], [7, 7, 7, None, 9])
    rows = minhash.classes(docs).collect()
    assert len(rows) == 5 and {r.class_id for r in rows if r.doc_id == 7} == {7}
    assert len({r.class_id for r in rows if r.doc_id != 7}) == 1  # null counts as empty
    assert minhash.one_of_each(docs).count() == 2


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(5, 3), (5, 5)], "a long, b long")
    got = {r.id: r.component for r in components(edges).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 3: 3, 5: 3}


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts))


def test_bounds_are_optimal():
    rng = random.Random(5)
    for _ in range(30):
        lengths = rng.sample(range(1, 40), rng.randint(1, 8))
        counts = [rng.randint(1, 9) for _ in lengths]
        k = rng.randint(1, 4)
        bounds = packing.best_bounds(np.array(lengths), np.array(counts), k)
        assert bounds == sorted(bounds) and len(bounds) <= k and bounds[-1] == max(lengths)
        best = min(padding(lengths, counts, [*c, max(lengths)]) for r in range(k) for c in itertools.combinations(lengths, r))
        assert padding(lengths, counts, bounds) == best


def test_bounds_of_many_lengths_match_the_plain_programme():
    rng = np.random.default_rng(8)
    for u, k in ((200, 5), (300, 16), (97, 97)):
        x = np.sort(rng.choice(np.arange(1, 40_000), u, replace=False))
        c = rng.integers(1, 50, u)
        n, t = np.concatenate(([0], np.cumsum(c))), np.concatenate(([0], np.cumsum(c * x)))
        best = [x[j] * n[j + 1] - t[j + 1] for j in range(u)]
        for _ in range(k - 1):
            best = [min([best[j], *(best[i - 1] + x[j] * (n[j + 1] - n[i]) - (t[j + 1] - t[i]) for i in range(1, j + 1))]) for j in range(u)]
        assert padding(x.tolist(), c.tolist(), packing.best_bounds(x, c, k)) == best[-1]


def test_lengths_above_a_thousand_stay_exact(spark):
    texts = ["w " * k for k in range(2000, 2008)]
    assert {r.padding for r in packing.pack(frame(spark, texts), buckets=16).collect()} == {0}
    long = packing.pack(frame(spark, ["w " * 19_990, "w " * 20_000, "w " * 16_383]), buckets=2).collect()
    assert sorted((r.n_tokens, r.over_budget) for r in long) == [(16_384, False), (19_991, True), (20_001, True)]
    assert len({r.batch_id for r in long}) == 3


def test_packing_keeps_every_row(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 7)
    rng = random.Random(6)
    texts = [*ODD, *[" ".join("w" * rng.randint(1, 60)) for _ in range(120)]] + ["x y"] * 20
    rows = packing.pack(frame(spark, texts), buckets=4, budget=200).collect()
    assert len(rows) == len(texts)
    batches = collections.defaultdict(list)
    for r in rows:
        assert r.n_tokens == len((texts[r.doc_id] or "").split()) + 1
        assert 0 <= r.padding == r.bucket - r.n_tokens
        assert r.over_budget == (r.n_tokens > 200) and (r.padding == 0 or not r.over_budget)
        batches[r.batch_id].append(r)
    assert len({r.bucket for r in rows if not r.over_budget}) <= 4
    sizes = collections.defaultdict(list)
    for b in batches.values():
        assert len({r.bucket for r in b}) == 1
        full = max(1, 200 // b[0].bucket)
        assert len(b) <= full
        assert len(b) == 1 if b[0].over_budget else len(b) * b[0].bucket <= 200
        sizes[b[0].bucket].append(len(b) < full)
    assert all(sum(s) <= 1 for s in sizes.values())
    assert packing.pack(frame(spark, [])).count() == 0


def test_fingerprints(spark):
    rng = random.Random(7)
    vocabulary = [f"v{k}" for k in range(400)]
    texts = [*ODD[:6], *[" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 80))) for _ in range(80)]]
    texts += [texts[20], texts[20]]
    ids = [3 * k for k in range(len(texts))]
    rows = {r.doc_id: r for r in fingerprints.fingerprints(frame(spark, texts, ids)).collect()}
    assert len(rows) == len(texts)
    plain = [t or "" for t in texts]
    for k, i in enumerate(ids):
        cut = len(plain[k]) // 4
        edited = plain[k][: len(plain[k]) - cut] + plain[(k + 1) % len(plain)][:cut]
        assert rows[i].n_chars == len(plain[k])
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if edited == plain[k]:
            assert rows[i].near_edited == 1 and rows[i].fingerprint == rows[i].edited_fingerprint
    assert rows[ids[-1]].fingerprint == rows[ids[-2]].fingerprint == rows[60].fingerprint
    assert rows[ids[-2]].near_next == 1
    long = [r for r in rows.values() if r.n_chars > 100]
    assert np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long if r.doc_id != ids[-2]]) + 0.05
    assert fingerprints.fingerprints(frame(spark, [])).count() == 0
    one = fingerprints.fingerprints(frame(spark, ["only one here"])).first()
    assert one.near_next == 1
    ties = fingerprints.fingerprints(frame(spark, ["b", "a", None, "c"], [None, 1, 1, None])).collect()
    assert len(ties) == 4


@pytest.mark.parametrize("coarse", [fingerprints.COARSE, 3])
@pytest.mark.parametrize("ids", [[9 * 10**18, -9 * 10**18, 0, 5], [None] * 4, [10**15, *range(1, 60)], [7] * 30 + [None] * 30])
def test_next_document_of_any_ids(spark, monkeypatch, ids, coarse):
    monkeypatch.setattr(fingerprints, "BLOCK_ROWS", 2)
    monkeypatch.setattr(fingerprints, "COARSE", coarse)
    texts = [f"{k} words of text {k * k}" for k in range(len(ids))]
    rows = fingerprints.fingerprints(frame(spark, texts, ids)).collect()
    hashes = {r.t: r.h for r in frame(spark, texts).selectExpr("text as t", "xxhash64(text) as h").collect()}
    line = sorted(zip(ids, texts), key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    want = []
    for k, (i, t) in enumerate(line):
        cut = len(t) // 4
        want.append((i, hashlib.sha256((t[: len(t) - cut] + line[(k + 1) % len(line)][1][:cut]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.edited_sha256) for r in rows), key=str) == sorted(want, key=str)


def test_blocks_are_even_beside_an_outlier(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BLOCK_ROWS", 16)
    docs = spark.range(4000).selectExpr("if(id = 0, 9000000000000000000, id) as i", "xxhash64(id) as h")
    sizes = [r["count"] for r in fingerprints.with_blocks(docs, "i", "h")[0].groupBy("_block").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 160


def test_fingerprint_subsets_are_sorted_term_hashes(spark):
    docs = frame(spark, ["b a a c", "c a b"])
    terms = fingerprints.with_terms(docs, "text", "t", fingerprints.lexicon(docs, 0.0)).collect()
    assert terms[0].t == terms[1].t == sorted(terms[0].t) and len(terms[0].t) == 3


@pytest.mark.parametrize("slot", [additive.SLOT, 300])
def test_neighbours_recall_and_cases(spark, monkeypatch, slot):
    monkeypatch.setattr(additive, "SLOT", slot)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(1500, 24))
    rows = [(i, x.astype(np.float32).tolist()) for i, x in enumerate(v)]
    bad = [(2000, None), (2001, [0.0] * 24), (2002, [1.0, None] + [0.0] * 22), (2003, [float("nan")] * 24), (2004, [1.0]), (None, rows[0][1]), (0, rows[0][1]), (2050, [float("inf")] * 24)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    got = additive.search(df, df.where("vec_id % 50 = 0"), rerank=200).collect()
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits, by = 0, collections.defaultdict(list)
    for r in got:
        by[r.query_id].append(r)
    assert sorted(by) == list(range(0, 1500, 50))
    for q, found in by.items():
        s = x @ x[q]
        s[q] = -9
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == [1, 2, 3, 4, 5]
        assert all(r.score == pytest.approx(s[r.vec_id], abs=1e-12) for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        hits += len({r.vec_id for r in found} & set(np.argsort(-s)[:5].tolist()))
    assert hits >= 0.9 * 5 * len(by)


def test_few_or_no_neighbours(spark):
    df = spark.createDataFrame([(50, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [2.0, 2.0])], "vec_id long, embedding array<float>")
    got = additive.search(df, df.where("vec_id % 50 = 0")).collect()
    assert sorted((r.rank, r.vec_id) for r in got) == [(1, 1), (2, 2)]
    assert additive.search(df.limit(0), df.limit(0)).count() == 0


def test_slots_merge_all_that_one_slot_holds(spark, monkeypatch):
    """All near vectors in a hashed share of the ids: a threshold from that share cuts candidates."""
    rng = np.random.default_rng(7)
    near = {r.id for r in spark.range(1500).where("pmod(xxhash64(id, 'share'), 5) = 0").collect()}
    v = rng.normal(size=(1500, 24)) + np.where(np.isin(np.arange(1500), list(near))[:, None], 8.0, 0.0) * np.eye(24)[0]
    v[::50] = rng.normal(size=(30, 24)) + 8 * np.eye(24)[0]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = []
    for slot in (300, 1500):
        monkeypatch.setattr(additive, "SLOT", slot)
        got.append({(r.query_id, r.rank): (r.vec_id, r.score) for r in additive.search(df, df.where("vec_id % 50 = 0"), k=400, rerank=400).collect()})
    assert len(got[0]) == 30 * 400
    assert got[0] == got[1]
