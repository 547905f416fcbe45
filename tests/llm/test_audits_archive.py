"""Source divergence, WARC archives and filter interactions against plain versions."""

import base64
import collections
import hashlib
import io
import itertools
import random
import re
import struct
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import archive, audit, divergence
from graphloom.llm import bytesops as B

TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, term string, n long, `a.b` string, mask int, digest string, `part` string"
UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def rows_of(spark, rows, ddl="doc_id long, text string, lang string, source string"):
    return spark.createDataFrame(rows, ddl)


def terms(text):
    return [t.translate(UPPER) for t in TERMS.findall(text or "")]


# divergence


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="aAbZé漢 ,1\n", max_size=60), st.integers(0, 2)), max_size=8))
def test_terms_of_every_length_are_counted(texts):
    data, offsets = B.text_bytes(pa.array([t for t, _ in texts], pa.string()))
    got = {}
    if len(data):
        for g, names, n, held in divergence.counted(data, offsets, np.array([g for _, g in texts], np.int64)):
            for key, name, a, b in zip(g.tolist(), names, n.tolist(), held.tolist()):
                assert (key, name.decode()) not in got
                got[key, name.decode()] = (a, b)
    n, held = collections.Counter(), collections.Counter()
    for text, g in texts:
        n.update((g, t) for t in terms(text))
        held.update({(g, t) for t in terms(text)})
    assert got == {k: (n[k], held[k]) for k in n}


def plain_divergence(docs, least, top):
    docs = [((lang or ""), (source or ""), terms(text)) for _, text, lang, source in docs]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = collections.Counter(t for _, _, words in own for t in set(words))
        kept = {t for t in held if held[t] >= least}
        count = lambda rows: collections.Counter(t for _, _, words in rows for t in words if t in kept)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        whole = share(count(own))
        counts = {s: count([d for d in own if d[1] == s]) for s in {d[1] for d in own}}
        shares = {s: share(c) for s, c in counts.items()}
        for s, p in shares.items():
            pair = [(-sum(abs(p[t] - q[t]) for t in kept), o.encode()) for o, q in shares.items() if o != s]
            term = [(whole[t] - p[t], t.encode()) for t in kept if counts[s][t] and p[t] > whole[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out |= {(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)}
    return out


def test_divergence_equals_a_plain_version(spark):
    rng = random.Random(3)
    vocabulary = ["a", "Be", "cde", "wordswor", "ninechars", "sixteen_letters", "sechzehnbuchstab", "seventeenletterss", "é" * 9, "漢字" * 30, "q" * 5000, "ZZ", "zz", "z1z"]
    docs = [(i, rng.choice([" ", "-", "7", "\n"]).join(rng.choices(vocabulary, weights=range(1, 15), k=rng.randint(0, 40))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "S2", "é", None])) for i in range(120)]
    docs += [(1000, None, "en", "none"), (None, "", "xx", "lonely"), (1, "only once", "yy", "u"), (1, "only once", "yy", "u"), (2, "", "yy", None)]
    got = divergence.audit(rows_of(spark, docs), 3, 4)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert {tuple(r) for r in got.collect()} == plain_divergence(docs, 3, 4)
    assert divergence.audit(rows_of(spark, []), 3).count() == 0


def test_divergence_over_tiles_and_buckets_and_odd_columns(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TILE_SOURCES", 2)
    monkeypatch.setattr(divergence, "BUCKET_TERMS", 3)
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choices(list("abcdefghijklmnop"), k=9)), "en", f"s{rng.randint(0, 8)}") for i in range(90)]
    wide = rows_of(spark, [(*d, 7, "t", 9, "x", 3, "d", "p") for d in docs], CLASHING)
    assert {tuple(r) for r in divergence.audit(wide, 2, 3).collect()} == plain_divergence(docs, 2, 3)


def test_a_long_text_is_read_whole(spark):
    docs = [(1, "start " + "filler " * 300_000 + "finish", "en", "a"), (2, "finish", "en", "b"), (3, "start", "en", "b")]
    got = {tuple(r) for r in divergence.audit(rows_of(spark, docs), 2).collect()}
    assert got == plain_divergence(docs, 2, 50)


# archives


def decoded(folder):
    """The records of a folder's archives, by a plain decoder: (file, headers, block)."""
    for file in sorted(Path(folder).glob("part-*")):
        data = file.read_bytes()
        magic, size = struct.unpack("<II", data[:8])
        known = None
        if magic == archive.DICTIONARY_MAGIC:
            known = zstandard.ZstdCompressionDict(data[8 : 8 + size])
        plain = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
        stream = io.BytesIO(plain.stream_reader(io.BytesIO(data), read_across_frames=True).read())
        while line := stream.readline():
            if line == b"\r\n":
                continue
            assert line == b"WARC/1.1\r\n"
            head = {}
            while (line := stream.readline()) != b"\r\n":
                key, _, value = line.decode().rstrip("\r\n").partition(": ")
                head[key] = value
            block = stream.read(int(head["Content-Length"]))
            assert stream.read(4) == b"\r\n\r\n"
            yield known is not None, head, block


def pages():
    rng = random.Random(1)
    out = [(i, f"http://h{i % 7}.org/p/{i}", "<html><body>" + " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=60)) + f"<i>{i}</i></body></html>") for i in range(300)]
    out += [(1000 + i, "http://copies.org/", out[5][2]) for i in range(200)]
    out += [(2000, None, None), (2001, "http://x/ y\r\nWARC-Type: z", ""), (2002, "http://crlf", "a\r\n\r\nb"), (None, "http://nobody", "of no id"), (None, "http://nobody", out[5][2]), (None, "http://nobody", "of no id"), (2003, "http://twice", "twice"), (2003, "http://twice", "twice"), (2004, "http://big", "é漢<p>" * 400_000), (-5, "http://least", out[9][2])]
    return out


def plain_records(rows):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        of = first.get(html or "")
        revisit = of is not None and of != i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", of if revisit else None))
    return collections.Counter(out)


def test_archives_are_read_back_whole(spark, tmp_path):
    rows = pages()
    table = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "page_id long, url string, html string, digest string, first long, `a.b` string")
    mark = archive.write(table, f"file://{tmp_path}/a")
    got = archive.read(spark, f"file://{tmp_path}/a", mark)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert collections.Counter(tuple(r) for r in got.select(columns).collect()) == plain_records(rows)
    texts = collections.Counter((r.page_id, bytes(r.payload).decode()) for r in got.where("record_type = 'response'").collect())
    assert all((i, html or "") in texts for i, _, html in rows if i is not None and i < 1000 and i != 9 and i != 5)
    assert (2002, "a\r\n\r\nb") in texts and (2004, "é漢<p>" * 400_000) in texts
    assert {r.url for r in got.where("page_id = 2001").collect()} == {"http://x/%20y%0D%0AWARC-Type:%20z"}
    assert [r.url for r in got.where("page_id = 2000").collect()] == [None]


def test_archives_are_plain_warc_with_a_dictionary_in_front(spark, tmp_path):
    rows = pages()
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    archive.write(table, f"file://{tmp_path}/b")
    found = list(decoded(f"{tmp_path}/b"))
    assert len(found) == len(rows) and all(led for led, _, _ in found)
    ids = {head["WARC-Record-ID"] for _, head, _ in found if head["WARC-Type"] == "response"}
    for _, head, block in found:
        assert head["WARC-Block-Digest"] == "sha1:" + archive.sha1(block)
        http, _, payload = block.partition(b"\r\n\r\n")
        if head["WARC-Type"] == "revisit":
            assert not payload and head["WARC-Refers-To"] in ids and head["WARC-Profile"] == archive.REVISIT_PROFILE
        else:
            assert head["WARC-Payload-Digest"] == "sha1:" + archive.sha1(payload)


def test_a_dictionary_makes_small_records_smaller(spark, tmp_path):
    table = spark.createDataFrame(pages()[:300], "page_id long, url string, html string").coalesce(1)
    size = lambda name: sum(f.stat().st_size for f in Path(f"{tmp_path}/{name}").glob("part-*"))
    archive.write(table, f"file://{tmp_path}/with")
    archive.write(table, f"file://{tmp_path}/without", dictionary=b"")
    assert size("with") < 0.7 * size("without")


def test_archives_of_few_and_of_no_pages(spark, tmp_path):
    for name, rows in (("few", [(1, "u", "x"), (2, None, None)]), ("none", [])):
        mark = archive.write(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/{name}")
        got = archive.read(spark, f"file://{tmp_path}/{name}", mark)
        assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()) == plain_records(rows)


def test_a_separator_inside_a_frame_is_written_around(spark, tmp_path, monkeypatch):
    mark = archive.separator()
    monkeypatch.setattr(archive, "separator", lambda: mark)
    hostile = mark + "".join(chr(33 + i % 90) for i in range(50))  # short texts are stored as they are
    assert archive.write(spark.createDataFrame([(1, "u", hostile)], "page_id long, url string, html string"), f"file://{tmp_path}/h", dictionary=b"") == mark
    frames = b"".join(f.read_bytes() for f in Path(f"{tmp_path}/h").glob("part-*"))
    assert frames.count(mark.encode()) == 1
    assert bytes(archive.read(spark, f"file://{tmp_path}/h", mark).first().payload).decode() == hostile


def test_damaged_payloads_are_found():
    raw = archive.record(1, "u", b"payload", None, "2020-01-01T00:00:00Z")
    assert archive.parsed(raw)["payload"] == b"payload"
    with pytest.raises(ValueError):
        archive.parsed(raw.replace(b"payload\r\n", b"payl0ad\r\n"))


# filter interactions


def plain_audit(docs, labels):
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    out = collections.Counter()
    parts = {s or "" for _, _, s in docs}
    for order in itertools.permutations("ABCDE"):
        for k in range(5):
            for p in parts:
                out[p, "".join(order), k + 1] = np.zeros(7, int)
    for i, text, source in docs:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and text in first and first[text] < i}
        failing = {f for f in fails if fails[f]}
        orders = ["".join(o) for o in itertools.permutations("ABCDE")]
        first_failed = collections.Counter(next(x for x in o if x in failing) for o in orders) if failing else {}
        for order in orders:
            for k, f in enumerate(order):
                before = any(fails[e] for e in order[:k])
                removed = fails[f] and not before
                out[source or "", order, k + 1] += np.array([not before and not fails[f], removed, fails[f] and before, failing == {f}, removed and i in good, removed and i in toxic, first_failed.get(f, 0)])
    return {(*k, *v.tolist()) for k, v in out.items()}


def audit_rows():
    rng = random.Random(2)
    make = lambda n, extra="": " ".join(rng.choices([f"w{k}" for k in range(n)], k=rng.choice([150, 250]))) + extra
    docs = [(i, make(rng.choice([20, 400]), rng.choice(["", " #", " " + "UPPER" * 20])), rng.choice(["a", "b", None, ""])) for i in range(12)]
    docs += [(50 + i, docs[3][1], "a") for i in range(3)] + [(0, docs[0][1], "z"), (None, docs[3][1], "a"), (60, None, "b"), (61, "", "c"), (62, "x\x0bx\x0cx x " * 150, "a"), (63, "é" * 10 + "A", "b")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(8)] + [(0, 1, 0), (0, 0, 1), (None, 1, 1), (999, 1, 1), (60, 1, 1)]
    return docs, labels


def test_audit_equals_a_plain_version(spark):
    docs, labels = audit_rows()
    table = spark.createDataFrame([(i, t, s, "x", 1, False, "y", 9) for i, t, s in docs], "doc_id long, text string, source string, part string, mask int, good boolean, `a.b` string, n long")
    said = spark.createDataFrame([(*r, "z") for r in labels], "doc_id long, quality int, toxic int, part string")
    got = audit.audit(table, said)
    assert got.columns == ["part", "filter_order", "step", *audit.COUNTS]
    assert {tuple(r) for r in got.collect()} == plain_audit(docs, labels)
    assert audit.audit(table.limit(0), said).count() == 0
    assert audit.audit(table, said.limit(0)).agg({"good_lost": "sum", "toxic_lost": "sum"}).first()[0] == 0


def test_packed_fields_do_not_overflow():
    masks = [(m, g, t) for m in range(32) for g in (False, True) for t in (False, True)]
    n = 10**15
    total = sum(n * audit.packed("ABCDE", *m) for m in masks)
    one = sum(audit.unpacked(audit.packed("ABCDE", *m), "ABCDE") for m in masks)
    assert (audit.unpacked(total, "ABCDE") == n * one).all()
    assert one.shape == (600, 7)


def test_words_of_long_texts_are_counted_in_pieces(monkeypatch):
    text = b"aa bb\tcc \x0b aa" * 50
    want = (len(text.split()), len(set(text.split())))
    assert audit.word_counts(text) == want
    monkeypatch.setattr(audit, "PIECE", 7)
    assert audit.word_counts(text) == want and audit.word_counts(b"") == (0, 0)
    assert audit.failed("w " * 2_000_000 + "$") == 0b1010
