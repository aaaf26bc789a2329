"""Repeated passages against all runs of fifty words."""

import random
from collections import defaultdict

import numpy as np

from reliefgrid.llm import suffixes
from reliefgrid.llm.queries import QUERIES
from reliefgrid.runtime import local_table


def brute(docs, length=50):
    texts = defaultdict(list)
    for i, t in docs:
        texts[(t or "")].append(i)
    words = {t: t.encode().split() for t in texts}
    held = defaultdict(set)
    for t, w in words.items():
        for s in range(len(w) - length + 1):
            held[tuple(w[s : s + length])].add(t)
    out = []
    for t, w in words.items():
        marks = [len(texts[t]) > 1 or len(held[tuple(w[s : s + length])]) > 1 for s in range(len(w) - length + 1)]
        spans = []
        for s in (s for s, m in enumerate(marks) if m):
            if spans and s <= spans[-1][1]:
                spans[-1][1] = s + length
            else:
                spans.append([s, s + length])
        out += [(i, a, b - a) for i in texts[t] for a, b in spans]
    return sorted(out, key=str)


def test_query_is_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op5_sparse_suffixes"](spark, sf).collect()), key=str)
    assert got == brute(docs) and len(got) > 5


def test_planted_and_odd_rows(spark):
    rnd = random.Random(2)
    vocab = ["".join(rnd.choices("abcdefgh", k=3)) for _ in range(500)]
    passages = [rnd.choices(vocab, k=k) for k in (49, 50, 51, 60, 75, 120)]
    docs = []
    for k in range(60):
        w = rnd.choices(vocab, k=rnd.randint(0, 120))
        for p in rnd.sample(passages, rnd.randint(0, 3)):
            lo = rnd.choice([0, 0, rnd.randint(0, 20)])
            at = rnd.randint(0, len(w))
            w[at:at] = p[lo : len(p) - rnd.choice([0, 0, rnd.randint(0, 15)])]
        docs.append((k, rnd.choice(["\n", " ", "\t "]).join(w)))
    docs += [(100, "go " * 300), (101, None), (102, ""), (103, docs[7][1]), (None, docs[8][1]), (9, docs[9][1]), (104, "x y " * 40), (105, "x y " * 45), (106, "a " * 20000 + " ".join(passages[4]))]
    frame = local_table(spark, [(i, t, 0, "s") for i, t in docs], "doc_id long, text string, start_word int, _text string").repartition(3)
    got = sorted((tuple(r) for r in suffixes.repeated_passages(frame).collect()), key=str)
    assert got == brute(docs)
    assert suffixes.repeated_passages(frame.limit(0)).count() == 0


def test_runs():
    words = suffixes.word_hashes(b"a b c a b c d")
    h = suffixes.run_hashes(words, 3)
    assert h[0] == h[3] and len(set(h.tolist())) == 4 and len(suffixes.run_hashes(words, 8)) == 0
    values = np.array([5, 1, 1, 7, 0, 9], np.uint64)
    assert suffixes.minimisers(values, 3).tolist() == [1, 1, 4, 4]


def test_neighbours_across_partitions(spark):
    """Stretches of one key over many partitions, of one text and of several."""
    rnd = random.Random(6)
    for shape in ([(1, 400)], [(1, 200), (1, 200)], [(5, 60), (9, 3), (40, 1)], [(300, 1)], [(1, 30)] * 12):
        rows, text = [], 0
        for key, (n_texts, per) in enumerate(shape):
            for _ in range(n_texts):
                text += 1
                rows += [(key % 7 - 3, key, text, at) for at in range(rnd.randint(1, per))]
        rows += [(9, 9, 1, 0), (9, 10, 2, 0), (10, 0, 3, 1), (10, 0, 3, 2)]
        texts = defaultdict(set)
        for a, b, t, _ in rows:
            texts[a, b].add(t)
        want = sorted((t, at) for a, b, t, at in rows if len(texts[a, b]) > 1)
        frame = local_table(spark, rows, "_head long, _h long, _text long, _place int").repartition(3)
        for parts in ("1", "2", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            try:
                assert sorted(map(tuple, suffixes.neighbours(frame, ["_head", "_h"], "_place").collect())) == want
            finally:
                spark.conf.set("spark.sql.shuffle.partitions", "4")
                spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
