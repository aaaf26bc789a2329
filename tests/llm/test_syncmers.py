"""Closed syncmers by definition, in Python."""

import hashlib
import random

import pytest
import xxhash

from reliefgrid.llm import syncmers
from reliefgrid.llm.queries import QUERIES
from reliefgrid.runtime import local_table

SCHEMA = "doc_id long, text string, next string, fingerprint string"


def h64(text):
    v = xxhash.xxh64_intdigest(text.encode(), 42)
    return v - (1 << 64) if v >> 63 else v


def chain(values):
    """Hash of several longs: each seeds the next."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest((v % (1 << 64)).to_bytes(8, "little"), seed)
    return seed


def brute_anchors(t):
    out = []
    for i in range(len(t) - syncmers.K + 1):
        s = [h64(t[i + j : i + j + syncmers.S]) for j in range(syncmers.WINDOW)]
        if min(s) in (s[0], s[-1]):
            out.append((i, chain([s[0], s[8], s[-1]]) & 0xFFFFFFFF))
    return out


def brute_sketch(t):
    anchors = sorted({h for _, h in brute_anchors(t)})[: syncmers.SKETCH]
    return anchors or ([h64(t) & 0xFFFFFFFF] if t else [])


def like(a, b):
    u = sorted(set(a) | set(b))[: syncmers.SKETCH]
    return len(set(u) & set(a) & set(b)) / len(u) if u else 1.0


def want(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
    out = []
    for k, (i, t) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + other[:half]
        f, e = brute_sketch(t), brute_sketch(edited)
        text = lambda s: "".join(f"{h:08x}" for h in s)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(f), text(e), like(f, e), like(f, brute_sketch(other))))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def some(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    return [(r.doc_id, r.text) for r in docs if len(r.text) < 4000][:60]


def test_by_definition(spark, some):
    odd = [(None, None), (None, "no id"), (-5, ""), (-6, "a"), (-7, "é😀" * 40), (-7, "é😀" * 40), (-7, "other"), (-8, "x" * 500), (-9, "b" * 23), (-10, "c" * 24), (-11, "d" * 25), (2**62, "big id " * 9)]
    rows = some + odd
    frame = local_table(spark, [(i, t, "n", "f") for i, t in rows], SCHEMA).repartition(4)
    got = sorted((tuple(r) for r in syncmers.fingerprints(frame).collect()), key=str)
    for a, b in zip(got, want(rows), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-12 and abs(a[6] - b[6]) < 1e-12, (a[0], b[0])
    found = sorted((r.doc_id, r.place, r.hash) for r in syncmers.anchor_rows(frame.filter("doc_id < 40 and doc_id >= 0")).collect())
    assert found == sorted((i, p, h) for i, t in rows if i is not None and 0 <= i < 40 for p, h in brute_anchors(t))
    one = frame.filter("doc_id = -6")
    assert [tuple(r)[:2] for r in syncmers.fingerprints(one).collect()] == [(-6, 1)]
    assert syncmers.fingerprints(frame.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    frame = QUERIES["op2_closed_syncmers"](spark, sf)
    plan = frame._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    rows = {r.doc_id: r for r in frame.collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert rows.keys() == docs.keys()
    ids = sorted(docs, reverse=True)
    for i, j in zip(ids, ids[1:] + ids[:1]):
        half = len(docs[i]) // 2
        assert rows[i].edited_sha256 == hashlib.sha256((docs[i][: len(docs[i]) - half] + docs[j][:half]).encode()).hexdigest()
        assert rows[i].n_chars == len(docs[i]) and 0 <= rows[i].near_edited <= 1
    long = [r for r in rows.values() if r.n_chars > 500]
    assert sum(0.15 < r.near_edited < 0.6 and r.near_next < 0.1 for r in long) > 0.9 * len(long)


def test_short_texts_without_anchors(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choices("abcdefgh é", k=n)) for n in range(20, 42) for _ in range(4)]
    rows = list(enumerate(texts)) + [(1000, "")]
    bare = {t for t in texts if len(t) >= syncmers.K and not brute_anchors(t)}
    assert len(bare) > 20
    whole = lambda t: [h64(t) & 0xFFFFFFFF] if t and not brute_anchors(t) else sorted({h for _, h in brute_anchors(t)})
    frame = local_table(spark, [(i, t, "n", "f") for i, t in rows], SCHEMA).repartition(4)
    got = {r.doc_id: r for r in syncmers.fingerprints(frame).collect()}
    order = sorted(rows, reverse=True)
    for (i, t), (_, other) in zip(order, order[1:] + order[:1]):
        edited = t[: len(t) - len(t) // 2] + other[: len(t) // 2]
        want = [whole(t), whole(edited), whole(other)]
        assert [got[i].fingerprint, got[i].edited_fingerprint] == ["".join(f"{h:08x}" for h in w) for w in want[:2]]
        assert abs(got[i].near_edited - like(*want[:2])) < 1e-12 and abs(got[i].near_next - like(want[0], want[2])) < 1e-12
    assert all(got[i].fingerprint for i, t in enumerate(texts)) and not got[1000].fingerprint
