"""Whole queries on the smallest tables against plain versions of them."""

import collections
import hashlib
import math
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from graphloom.llm import fingerprints, licences, packing
from graphloom.llm.queries import QUERIES
from tests.llm.test_sets_and_packing import brute_classes, padding

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    rows = pq.read_table(f"{SMALL}/documents.parquet").to_pylist()
    return sorted(rows, key=lambda r: r["doc_id"])


def term_hashes(text):
    return {int(np.uint64(xxhash.xxh64_intdigest(w.encode(), seed=42)).astype(np.int64)) for w in re.split(r"[\x20\x09-\x0D]+", text.lower())}


@pytest.mark.parametrize("in_plan", [fingerprints.IN_PLAN, 10])
def test_fingerprint_query(spark, documents, monkeypatch, in_plan):
    monkeypatch.setattr(fingerprints, "IN_PLAN", in_plan)
    texts = [r["text"] for r in documents]
    n = len(texts)
    df = collections.Counter(b for t in texts for b in term_hashes(t))
    lexicon = {b for b, c in df.items() if n * math.exp(-7) <= c <= max(n * math.exp(-3), 1)}

    def parts(text):
        kept = sorted(term_hashes(text) & lexicon)
        out = []
        for s in fingerprints.SCALES:
            for k in range(fingerprints.EACH):
                out.append(tuple(b for b in kept if b >> fingerprints.OFFSETS[s] & ((1 << s) - 1) == k))
        return out

    def like(a, b, x, y):
        held = [(p, q) for p, q in zip(a, b) if p or q]
        return sum(p == q for p, q in held) / len(held) if held else float(x == y)

    got = {r.doc_id: r for r in QUERIES["op10_fingerprints"](spark, SMALL).collect()}
    assert len(got) == n
    own = [parts(t) for t in texts]
    for i, r in enumerate(documents):
        after = (i + 1) % n
        cut = len(texts[i]) // 4
        edited = texts[i][: len(texts[i]) - cut] + texts[after][:cut]
        g = got[r["doc_id"]]
        assert g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert g.near_edited == pytest.approx(like(own[i], parts(edited), texts[i], edited))
        assert g.near_next == pytest.approx(like(own[i], own[after], texts[i], texts[after]))


def test_near_duplicate_query(spark, documents):
    want = brute_classes([r["text"] for r in documents], [r["doc_id"] for r in documents])
    assert {r.doc_id: r.class_id for r in QUERIES["op3_minhash"](spark, SMALL).collect()} == want


def test_packing_query(spark, documents):
    rows = QUERIES["op6_packing"](spark, SMALL).collect()
    lengths = collections.Counter(len(r["text"].encode().split()) + 1 for r in documents)
    assert collections.Counter(r.n_tokens for r in rows) == lengths
    x, c = np.array(sorted(lengths)), np.array([lengths[k] for k in sorted(lengths)])
    within = x <= 16384
    x, c = x[within], c[within]
    assert {r.bucket for r in rows if not r.over_budget} <= set(packing.best_bounds(x, c, 16))
    assert all(r.over_budget == (r.n_tokens > 16384) for r in rows)
    # no bound moved to a neighbouring length gives less padding
    bounds = packing.best_bounds(x, c, 16)
    best = padding(x.tolist(), c.tolist(), bounds)
    for k in range(len(bounds) - 1):
        for other in x[(x > (bounds[k - 1] if k else 0)) & (x < bounds[k + 1])]:
            moved = [*bounds[:k], int(other), *bounds[k + 1 :]]
            assert padding(x.tolist(), c.tolist(), moved) >= best


def test_licence_query(spark, documents):
    words = lambda t: re.findall("[a-z0-9]+", t.translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})))
    n = len(documents)
    known = {w for forms in licences.TEMPLATES.values() for _, t in forms for w in words(t)}
    df = collections.Counter(w for r in documents for w in set(words(r["text"])) & known)
    idf = lambda w: 1 + math.log((1 + n) / (1 + df[w])) if w in known else 1 + math.log((1 + n) / 2)

    def vector(text):
        v = {w: c * idf(w) for w, c in collections.Counter(words(text)).items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        return {w: x / norm for w, x in v.items()}

    templates = [(name, set(needs.split()), vector(t)) for name, forms in licences.TEMPLATES.items() for needs, t in forms]

    def path(i, source, lang):
        folder = [source or "none", lang or "none", str(i // 64)]
        if i % 64:
            return "/".join([*folder, f"{i}.txt"])
        return "/".join([*folder[: 1 if i % 8192 == 0 else 2 if i % 1024 == 0 else 3], "LICENSE"])

    own, at = {}, {}
    for r in documents:
        i, text = r["doc_id"], r["text"]
        at[i] = path(i, r["source"], r["lang"])
        lines = [x for x in text.split("\n") if re.search("[A-Za-z0-9]", x)]
        heads = {"\n".join(lines[j : j + k]) for k in range(1, 5) for j in range(len(lines) - k + 1)}
        heads |= set(re.split(r"\n(?:[^A-Za-z0-9\n]*\n)+", text))
        for head in heads | ({text} if i % 64 == 0 else set()):
            v = vector(head)
            for name, needs, t in templates:
                if needs <= set(v):  # no prefilter by marks here
                    c = round(sum(x * t.get(w, 0) for w, x in v.items()), 9)
                    if c >= 0.7:
                        own[i] = min(own.get(i, (0, "~")), (-c, name))
    grants = {}
    for i, (c, name) in own.items():
        if i % 64 == 0:
            folder = at[i].rpartition("/")[0]
            grants[folder] = min(grants.get(folder, (0, "~")), (c, name))
    want = {}
    for i, p in at.items():
        folder, best = p.rpartition("/")[0], None
        while best is None and i not in own:
            if folder in grants:
                best = (grants[folder][1], folder)
            if not folder:
                break
            folder = folder.rpartition("/")[0]
        want[i] = (own[i][1], None) if i in own else best or (None, None)
    rows = QUERIES["op2_licences"](spark, SMALL).collect()
    assert {r.doc_id: (r.licence, r.inherited_from) for r in rows} == want and len(rows) == n
    assert own and all(r.cosine == pytest.approx(-own[r.doc_id][0], abs=1e-8) for r in rows if r.doc_id in own)


def test_piece_query_round_trips(spark, documents):
    rows = QUERIES["op7_pieces"](spark, SMALL).collect()
    assert len(rows) == len(documents) and all(r.exact and r.n_pieces > 0 for r in rows)


def test_scoring_query(spark, documents):
    rows = QUERIES["op1_ctw"](spark, SMALL).collect()
    assert len(rows) == len(documents)
    held = [r for r in rows if r.held_out]
    assert all(r.score < 0 and r.base_score < 0 and 0 < r.n_known <= r.n_tokens for r in rows)
    assert np.sum([r.score for r in held]) > np.sum([r.base_score for r in held]) * 1.2


def test_pipeline_against_its_parts(spark, documents):
    import corpus_pipeline as c

    rejected = {r.doc_id for r in QUERIES["op9_toxicity"](spark, SMALL).where("predicted = 1").collect()}
    stages = dict(c.STAGES)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    clean = stages["toxicity"](spark, docs, SMALL)
    kept = {r.doc_id: r.text for r in clean.collect()}
    assert set(kept) == {r["doc_id"] for r in documents} - rejected
    known = {r.doc_id: r.text for r in stages["language_id"](spark, clean, SMALL).collect()}
    assert set(known) <= set(kept) and len(known) >= 0.97 * len(kept)
    classes = brute_classes(list(known.values()), list(known))
    rows = c.run(spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(set(classes.values()))
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(known[i].encode().split()) + 1 for i in set(classes.values())}
