import base64
import hashlib

import numpy as np
import pyarrow as pa
from millrace.llm import fingerprints as P
from millrace.llm import warc as W

PAGES = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, None), (4, "http://a/4", ""), (5, "http://a/ö", "zażółć\r\n\r\n" * 3), (6, "http://a/6", "<p>x</p>"), (7, "http://a/7", "y" * 500_000)]
SCHEMA = "page_id long, url string, html string"


def wanted(rows, least=0):
    out = {}
    for i, _, h in rows:
        p = (h or "").encode()
        top = max((j for j, _, x in rows if (x or "") == (h or "")), default=i)
        first = len(p) < least or top == i
        out[i] = (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if first else "revisit", None if first else top)
    return out


def read_back(index):
    return {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in W.read(index).collect()}


def test_round_trip(spark):
    index = W.write(spark.createDataFrame(PAGES, SCHEMA))
    assert read_back(index) == wanted(PAGES)
    payloads = {r.page_id: bytes(r.payload) for r in W.read(index).where("record_type = 'response'").collect()}
    assert all(payloads[i] == (h or "").encode() for i, _, h in PAGES if i in payloads)


def test_smaller_payloads_are_not_revisits(spark):
    assert read_back(W.write(spark.createDataFrame(PAGES, SCHEMA), min_revisit_bytes=9)) == wanted(PAGES, 9)


def test_selected_records_only(spark, monkeypatch):
    monkeypatch.setattr(W, "FILE_BYTES", 400)
    monkeypatch.setattr(W, "GAP", 0)
    index = W.write(spark.createDataFrame(PAGES, SCHEMA))
    assert set(read_back(index.where("page_id IN (2, 5, 7)"))) == {2, 5, 7}


def test_empty_table_repeats_null_id_and_extra_columns(spark):
    assert W.read(W.write(spark.createDataFrame([], SCHEMA))).count() == 0
    rows = [(1, "u", "same", "a"), (1, "u", "same", "b"), (None, "v", "same", "c"), (None, "w", "alone", "d")]
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in W.read(W.write(spark.createDataFrame(rows, SCHEMA + ", file string"))).collect())
    assert got == [(0, "response", 0), (0, "revisit", 1), (1, "response", 0), (1, "response", 0)]


def test_a_changed_payload_is_noticed(spark):
    import pytest

    index = W.write(spark.createDataFrame(PAGES[:1], SCHEMA))
    path = index.first().file.removeprefix("file:").replace("//", "/", 1) if index.first().file.startswith("file:") else index.first().file
    raw = bytearray(open(path, "rb").read())
    raw[len(raw) // 2] ^= 255
    open(path, "wb").write(raw)
    with pytest.raises(Exception):
        W.read(index).collect()


def brute_edit(rows):
    rows = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    out = {}
    for k, (i, t) in enumerate(rows):
        t, u = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t) // 2
        out[i] = (len(t), hashlib.sha256((t[: len(t) - n] + u[:n]).encode()).hexdigest())
    return out


def test_edited_texts_over_ranges(docs):
    rows = [(i * 3, f"text ä number {i} 😀 " * (i % 9)) for i in range(200)] + [(1, None), (2, "")]
    got = {r.doc_id: (r.n_chars, r.edited_sha256) for r in P.describe(docs(rows)).collect()}
    assert got == brute_edit(rows)


def test_one_row_no_row_and_long_text(docs, empty):
    assert P.describe(empty).count() == 0
    r = P.describe(docs([(5, "abcd")])).first()
    assert (r.n_chars, r.edited_sha256, r.near_next) == (4, hashlib.sha256(b"abab").hexdigest(), 1.0)
    rows = [(1, "long word " * 200_000), (2, "b")]
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in P.describe(docs(rows)).collect()} == brute_edit(rows)


def test_equal_texts_have_equal_fingerprints_and_copies_are_near():
    words = [f"w{i}" for i in range(300)]
    other = [f"v{i}" for i in range(300)]
    near = words[:150] + ["changed"] + words[151:]
    a, b, c, d, e = P.simhash(pa.array([" ".join(x) for x in (words, words, near, other)] + [None]))
    bits = lambda x, y: int(np.bitwise_count(x ^ y))
    assert a == b and bits(a, c) <= 8 and bits(a, d) > 16 and e == 0


def test_block_tables_find_all_within_the_radius(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**63), 2**63 - 1, 40, np.int64)
    fps = set(base.tolist())
    for x in base[:20].tolist():
        for n in range(6):
            y = np.int64(x)
            for b in rng.choice(64, n, replace=False):
                y ^= np.int64(1) << np.int64(b)
            fps.add(int(y))
    asks = base[:15].tolist()
    got = {(r.q, r.fp) for r in P.within(spark.createDataFrame([(x,) for x in fps], "fp long"), spark.createDataFrame([(x,) for x in asks], "q long")).collect()}
    assert got == {(q, f) for q in asks for f in fps if bin((q ^ f) & (2**64 - 1)).count("1") <= 3}


def slow_simhash(text):
    """The fingerprint in plain integers."""
    import math
    import re
    from collections import Counter

    m64, gold = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def mixed(x, salt=0):
        x = (x + salt * gold + 0x632BE59BD9B4E019) & m64
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m64
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m64
        return x ^ (x >> 31)

    low = re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode())
    words = [mixed(sum((b + 1) * pow(gold, i, 1 << 64) for i, b in enumerate(w)) & m64) for w in re.findall(rb"[^\x20\x09-\x0d]+", low)]
    if not words:
        return 0
    k = min(3, len(words))
    terms = Counter(mixed(sum(mixed(w, 40 + j) for j, w in enumerate(words[i : i + k])) & m64, 50 + k) for i in range(len(words) - k + 1))
    votes = [sum(round(4096 * (1 + math.log(n))) * (1 if t >> b & 1 else -1) for t, n in terms.items()) for b in range(64)]
    return sum(1 << b for b in range(64) if votes[b] > 0)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in P.op10(spark, sf).collect()}
    fps = {i: int(got[i].fingerprint, 16) for i, _ in rows}
    like = lambda x, y: 1 - bin(x ^ y).count("1") / 64
    for k, (i, t) in enumerate(rows):
        j, u = rows[(k + 1) % len(rows)]
        r, n = got[i], len(t) // 2
        edited = t[: len(t) - n] + u[:n]
        if len(t) < 3000:
            assert fps[i] == slow_simhash(t) and int(r.edited_fingerprint, 16) == slow_simhash(edited)
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == like(fps[i], int(r.edited_fingerprint, 16)) and r.near_next == like(fps[i], fps[j])
        assert r.n_near == (sum(bin(fps[i] ^ f).count("1") <= 3 for f in fps.values()) - 1 if i % 100 == 0 else None)


def test_reading_has_tasks_for_the_bytes(spark, monkeypatch):
    index = W.write(spark.createDataFrame([(i, f"http://a/{i}", f"page {i} " * 50) for i in range(400)], SCHEMA))
    total = sum(r.length for r in index.select("length").collect())
    monkeypatch.setattr(W, "TASK", total // 20)
    monkeypatch.setattr(W, "STRETCH", 512)
    assert W.read(index).rdd.getNumPartitions() >= 20 and W.read(index).count() == 400

