"""Language ID, the toxicity fit and vector search of the registered queries against plain versions."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from graphloom.llm import langid, toxicity
from graphloom.llm.common import remainder_is_two
from graphloom.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def held(i, modulus=4):
    return zlib.crc32(str(i).encode()) % modulus == 2


def grams(text):
    """Hashed 2- and 3-grams of a text's letters, by plain loops."""
    x = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode()]
    out = collections.Counter()
    for width in (2, 3):
        for k in range(len(x) - width + 1):
            g = x[k : k + width]
            if g[0] == g[1] == 32:
                continue
            h = 0
            for b in g:
                h = (h * 257 + b) % 2**32
            out[(h * 2654435761) % 2**32 >> 19] += 1
    return out


def test_language_query(spark):
    rows = pq.read_table(f"{SMALL}/documents.parquet").to_pylist()
    lettered = lambda t: bool(re.search(r"[^\W\d_]", t or ""))
    train = [r for r in rows if not held(r["doc_id"]) and r["lang"] is not None and lettered(r["text"])]
    df = collections.Counter(g for r in train for g in grams(r["text"]))
    idf = lambda g: math.log((1 + len(train)) / (1 + df[g])) + 1
    model = langid.fit(spark.read.parquet(f"{SMALL}/documents.parquet"), remainder_is_two("doc_id", 4))
    assert np.allclose(model.idf, [idf(g) for g in range(langid.DIMS)], atol=1e-5)
    assert set(model.langs) == {r["lang"] for r in train}
    assert np.allclose(np.linalg.norm(model.matrix, axis=1), 1, atol=1e-4)
    got = {r.doc_id: r for r in QUERIES["op4_langid"](spark, SMALL).collect()}
    assert len(got) == len(rows)
    right = []
    for r in rows:
        g = got[r["doc_id"]]
        assert g.held_out == held(r["doc_id"])
        if not lettered(r["text"]):
            assert (g.lang_pred, g.score, g.rejected) == ("und", 0.0, True)
            continue
        tf = grams(r["text"])
        v = {t: (1 + math.log(n)) * idf(t) for t, n in tf.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cosines = [sum(x * float(c[t]) for t, x in v.items()) / norm for c in model.matrix]
        best = max(cosines)
        assert g.score == pytest.approx(best, abs=1e-4)
        assert any(model.langs[k] == g.lang_pred for k, c in enumerate(cosines) if c > best - 1e-5)
        slope, start = model.line[max(range(len(cosines)), key=cosines.__getitem__)]
        least = math.exp(slope * math.log(len(tf)) + start)
        assert g.rejected == (best < least) or abs(best - least) < 1e-4
        if g.held_out and r["lang"] is not None:
            right.append(g.lang_pred == r["lang"])
    assert np.mean(right) > 0.95


def plain_fit(rows, y, n_terms, rank, steps, rate, decay, seed):
    """AdaGrad on the logistic loss of a factorization machine, with every pair written out."""
    rng = np.random.default_rng(seed)
    w, v = [0.0] * n_terms, rng.normal(0, 0.02, (rank, n_terms))
    gw, gv, gb = [1e-6] * n_terms, np.full((rank, n_terms), 1e-6), 1e-6
    bias = math.log((sum(y) + 0.5) / (len(y) - sum(y) + 0.5))
    for _ in range(-(-steps // -(-len(y) // 128))):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), 128):
            part = order[lo : lo + 128]
            miss = {}
            for i in part:
                z = bias + sum(w[t] * x for t, x in rows[i])
                z += sum(sum(v[k][s] * v[k][t] for k in range(rank)) * a * b for n, (s, a) in enumerate(rows[i]) for t, b in rows[i][:n])
                miss[i] = 1 / (1 + math.exp(-z)) - y[i]
            dw = [decay * w[t] for t in range(n_terms)]
            dv = decay * v
            for i in part:
                for t, x in rows[i]:
                    dw[t] += miss[i] * x / len(part)
                    for k in range(rank):
                        dv[k][t] += miss[i] * x / len(part) * sum(v[k][s] * a for s, a in rows[i] if s != t)
            for t in range(n_terms):
                gw[t] += dw[t] ** 2
                w[t] -= rate * dw[t] / math.sqrt(gw[t])
            gv += dv * dv
            v = v - rate / 4 * dv / np.sqrt(gv)
            db = sum(miss.values()) / len(part)
            gb += db * db
            bias -= rate * db / math.sqrt(gb)
    return bias, np.array(w), v.T


def test_toxicity_fit():
    rng = np.random.default_rng(8)
    rows = [[(int(t), float(np.float32(rng.random() + 0.2))) for t in np.sort(rng.choice(7, rng.integers(1, 5), replace=False))] for _ in range(150)]
    y = [int(any(t == 2 for t, _ in r) and any(t == 5 for t, _ in r)) for r in rows]
    doc = np.repeat(np.arange(150), [len(r) for r in rows])
    term, x = np.array([t for r in rows for t, _ in r]), np.array([a for r in rows for _, a in r])
    for steps in (1, 6):
        got = toxicity.fit_rows(doc, term, x, np.array(y, float), 7, rank=2, steps=steps)
        want = plain_fit(rows, y, 7, 2, steps, 0.1, 1e-4, 7)
        for a, b in zip(got, want):
            assert np.allclose(a, b, rtol=1e-6, atol=1e-9)


def test_toxicity_query_against_its_labels(spark):
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist()}
    rows = QUERIES["op9_toxicity"](spark, "/root/testdata/sf0.01").collect()
    assert all(r.predicted == (r.score >= 0.3) and r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    right = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert len(right) > 50 and np.mean(right) > 0.9  # some 300 labelled rows


def test_vector_query_finds_the_nearest(spark):
    rows = pq.read_table("/root/testdata/sf0.01/embeddings.parquet").to_pylist()
    use = [r for r in rows if r["embedding"] and None not in r["embedding"] and np.isfinite(r["embedding"]).all() and np.any(r["embedding"])]
    x = np.array([r["embedding"] for r in use], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([r["vec_id"] for r in use])
    got = collections.defaultdict(list)
    for r in QUERIES["op5_additive"](spark, "/root/testdata/sf0.01").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = []
    for q in np.flatnonzero(ids % 50 == 0):
        c = x @ x[q]
        order = [k for k in np.lexsort((ids, -c)) if k != q][:5]
        found = sorted(got[ids[q]])
        assert [r for r, _, _ in found] == list(range(1, 6))
        assert [s for _, _, s in found] == sorted((s for _, _, s in found), reverse=True)
        at = {int(i): k for k, i in enumerate(ids)}
        assert all(s == pytest.approx(c[at[i]], abs=1e-9) for _, i, s in found)
        hits.append(len({int(ids[k]) for k in order} & {i for _, i, _ in found}) / 5)
    assert hits and np.mean(hits) >= 0.9
