"""Vantage-point SimHash against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from reliefgrid.llm import simhash
from reliefgrid.llm.queries import QUERIES
from reliefgrid.llm.tables import one_per_key
from reliefgrid.runtime import local_table

SCHEMA = "doc_id long, text string, shard int, fp string"


def table(spark, texts, ids=None):
    return local_table(spark, [(i, t, 1, "x") for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    found = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))


def brute_components(fps, ids, radius):
    roots = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if bin(fps[i] ^ fps[j]).count("1") <= radius and roots[i] != roots[j]:
                    roots[i] = roots[j] = min(roots[i], roots[j])
                    changed = True
    return [min(ids[j] for j in range(len(fps)) if roots[j] == r) for r in roots]


def test_query_is_brute_force(spark):
    got = {r[0]: (r[1], r[2]) for r in QUERIES["op3_simhash_components"](spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    fps = [brute_fingerprint(r.text) for r in docs]
    want = brute_components(fps, [r.doc_id for r in docs], 2)
    assert got == {r.doc_id: (f"{f:016x}", c) for r, f, c in zip(docs, fps, want)}


def test_odd_rows(spark):
    texts = [None, "", " \t\n", "One two", "one\x0btwo", "one two three", "a" * 3_000_000 + " b c d", "a b", "a b", "é A\x85b"]
    got = simhash.components(table(spark, texts)).collect()
    fps = {r.doc_id: r.fingerprint % (1 << 64) for r in got}
    assert fps == {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    comp = {r.doc_id: r.component_id for r in got}
    assert comp[0] == comp[1] == comp[2] == 0 and comp[3] == comp[4] == 3 and comp[7] == comp[8] == 7
    assert simhash.components(table(spark, [])).count() == 0
    twice = simhash.components(table(spark, ["x y z", "x y z"], [None, None])).collect()
    assert [r.component_id for r in twice] == [None, None]


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_shards_and_trees_lose_no_link(spark, radius, monkeypatch):
    rnd = random.Random(radius)
    base = [rnd.getrandbits(64) for _ in range(400)]
    points = set(base)
    for b in base[:150]:
        for _ in range(rnd.randint(1, 4)):
            points.add(b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(1, 4))))
    points = sorted(points)
    signed = [int(np.uint64(p).astype(np.int64)) for p in points]
    rows = [(s, s) for s in signed]
    nodes = local_table(spark, rows, "node long, by long").repartition(3)
    edges = simhash.links(nodes, "by", radius, shard_rows=40, sample=2000)
    found = dict(simhash.connected_components(edges).collect())
    want = brute_components(points, signed, radius)
    assert [found.get(s, s) for s in signed] == want
    monkeypatch.setattr(simhash, "BRUTE_ROWS", 16)
    arr = np.array(points, np.uint64)
    inside = simhash.linked_sets(arr, radius)
    assert [min(s for s, k in zip(signed, inside) if k == i) for i in inside] == want


def test_near_duplicates(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(3000)]
    texts = [" ".join(rnd.choices(words, k=300)) for _ in range(30)]
    near = []
    for t in texts[:10]:
        w = t.split()
        w[rnd.randrange(300)] = "changed"
        near.append(" ".join(w))
    all_texts = texts + near + texts[:5] + [None, ""]
    docs = table(spark, all_texts)
    marks = simhash.near_duplicates(docs).collect()
    assert len(marks) == len(all_texts)
    kept = sorted(r._id for r in marks if r._keep)
    assert set(range(30)) <= set(kept) and not set(kept) & {40, 41, 42, 43, 44, 46}
    assert len(set(kept) & set(range(30, 40))) <= 2
    stayed = one_per_key(docs, simhash.near_duplicates(docs).filter("_keep"))
    assert stayed.columns == docs.columns and sorted(r.doc_id for r in stayed.collect()) == kept


def five_words(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} - {()}


def test_near_duplicates_are_jaccard_of_five_words(spark):
    rnd = random.Random(8)
    words = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(5000)]
    texts, block = [], rnd.choices(words, k=120)
    for k in range(60):
        base = rnd.choices(words, k=rnd.randint(100, 500)) + (block if k % 2 else [])
        texts.append(base)
        texts.append(base + rnd.choices(words, k=int(len(base) * rnd.choice([0.1, 0.2, 0.24, 0.3]))))  # appended blocks
        for share in (0.02, 0.04):  # 0.82 and 0.7
            texts.append([rnd.choice(words) if rnd.random() < share else w for w in base])
    hot = rnd.choices(words, k=200)
    for _ in range(60):  # a large group, not all of it near to one text
        at = rnd.randrange(200)
        texts.append(hot[:at] + rnd.choices(words, k=rnd.randint(1, 12)) + hot[at:])
    texts = [" ".join(t) for t in texts]
    sets = [five_words(t) for t in texts]
    root = list(range(len(texts)))
    pairs = 0
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                pairs += 1
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert pairs > 150
    group = {r._id: r._group for r in simhash.near_duplicates(table(spark, texts)).collect()}
    first = {}
    assert [first.setdefault(group[i], i) for i in range(len(texts))] == root


def test_crowds_cost_no_pairs(spark, monkeypatch):
    """Texts that share a passage, or descend from one text with too many changes, meet few others each."""
    rnd = random.Random(9)
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randint(3, 7))) for _ in range(6000)]
    passage, base = rnd.choices(words, k=70), rnd.choices(words, k=150)
    pool = [rnd.choices(words, k=15) for _ in range(60)]
    texts = [" ".join(passage + sum(rnd.sample(pool, 2), [])) for _ in range(1000)]  # 0.6 or so to each other
    for _ in range(1000):
        t = list(base)
        for at in rnd.sample(range(150), rnd.randint(1, 7)):
            t[at] = rnd.choice(words)
        texts.append(" ".join(t))
    texts.append(" ".join(base))
    seen = []
    real = simhash._near_pairs
    monkeypatch.setattr(simhash, "_near_pairs", lambda pairs, *rest: (seen.append(pairs.count()), real(pairs, *rest))[1])
    group = {r._id: r._group for r in simhash.near_duplicates(table(spark, texts)).collect()}
    sets = [five_words(t) for t in texts]
    near_base = [i for i in range(1000, 2001) if len(sets[i] & sets[2000]) >= 0.8 * len(sets[i] | sets[2000])]
    assert len(near_base) > 300 and {group[i] for i in near_base} == {group[2000]}
    assert sum(seen) < 40 * len(texts), seen  # of 1,000,000 pairs within the two crowds


def test_trees_link_near_copies_first(spark, monkeypatch):
    """The trees propose before any shingle meets another, and what they propose is confirmed."""
    rnd = random.Random(12)
    words = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(3000)]
    texts = [" ".join(rnd.choices(words, k=4000)) for _ in range(10)]
    for t in texts[:10]:
        w = t.split()
        w[rnd.randrange(4000)] = "changed"
        texts.append(" ".join(w))
    radii, proposed = [], []
    links, near = simhash.links, simhash._near_pairs
    monkeypatch.setattr(simhash, "links", lambda nodes, by, radius, *rest: (radii.append(radius), links(nodes, by, radius, *rest))[1])
    monkeypatch.setattr(simhash, "_near_pairs", lambda pairs, *rest: (proposed.append(pairs.count()), near(pairs, *rest))[1])
    group = {r._id: r._group for r in simhash.near_duplicates(table(spark, texts)).collect()}
    assert all(group[i] == group[i + 10] for i in range(10)) and len(set(group.values())) == 10
    assert radii == [2] and 3 <= proposed[0] <= 10


def test_few_pairs_left_are_compared_at_once(spark, monkeypatch):
    """A large linked set and some texts that share its rarest shingles but fall short of it cost few rounds, not one per doubling."""
    rnd = random.Random(15)
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randint(3, 7))) for _ in range(4000)]
    base = rnd.choices(words, k=150)
    texts = [" ".join(base)]
    for _ in range(200):
        t = list(base)
        t[rnd.randrange(150)] = rnd.choice(words)
        texts.append(" ".join(t))
    for _ in range(60):  # the first 133 words and others: 0.79 to the first text and to each other
        texts.append(" ".join(base[:133] + rnd.choices(words, k=17)))
    rounds = []
    real = simhash._near_pairs
    monkeypatch.setattr(simhash, "_near_pairs", lambda pairs, *rest: (rounds.append(1), real(pairs, *rest))[1])
    group = {r._id: r._group for r in simhash.near_duplicates(table(spark, texts)).collect()}
    sets = [five_words(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    first = {}
    assert [first.setdefault(group[i], i) for i in range(len(texts))] == root
    assert len(set(root)) > 30 and len(rounds) <= 3, len(rounds)
