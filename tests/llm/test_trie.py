"""The prefix trie against a dictionary of prefixes, and its parts."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from check import compare
from reliefgrid.llm import trie
from reliefgrid.llm.order import running
from reliefgrid.llm.queries import QUERIES, SQL
from reliefgrid.runtime import local_table
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string, depth int, x1 string"


def brute(rows, rebuild=True):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    told = {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: x[:3])] for c, v in turns.items()}
    if rebuild:
        made = {}
        for c, v in told.items():
            h = zlib.crc32(str(c).encode()) % 9
            donor = c - (c % 5 if c >= 0 else -(-c % 5))
            made[c] = told.get(donor, [])[:h] + v[h:]
        told = made
    nodes = defaultdict(list)
    for c, v in told.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    children = defaultdict(list)
    for n in nodes:
        if n:
            children[n[:-1]].append(n)
    out = []
    for n, members in nodes.items():
        todo, leaves, saved = [n], 0, 0
        while todo:
            m = todo.pop()
            leaves += not children[m]
            saved += (len(nodes[m]) - 1) * (len(m[-1][1].encode()) if m else 0)
            todo += children[m]
        ends = ",".join(map(str, sorted(c for c in members if len(told[c]) == len(n))))
        out.append((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), len(children[n]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def some_rows(rnd, n):
    texts = ["yes", "no", "über", "a longer text " * 3, "", None]
    rows = []
    for c in rnd.sample(range(-20, 3 * n), n):
        for turn in range(rnd.choice([1, 2, 5, 9, 12])):
            rows.append((c, turn, rnd.choice(["user", "assistant", None]) if rnd.random() < 0.2 else "user", texts[rnd.randint(0, 1)] if rnd.random() < 0.7 else rnd.choice(texts)))
    return rows


def test_query_is_sql(spark):
    result, _ = compare(spark, "/root/testdata/sf0.001", "op13", QUERIES["op13_prefix_trie"], SQL["op13_prefix_trie"])
    assert result.startswith("ok"), result


@pytest.mark.parametrize("seed", [1, 2])
def test_by_definition(spark, seed, monkeypatch):
    rnd = random.Random(seed)
    rows = some_rows(rnd, 120)
    copy = [r for r in rows if r[0] == rows[0][0]]
    rows += [(5000 + 5 * k, *r[1:]) for k in range(150) for r in copy]  # a crowd of equal conversations
    rows += [(7, None, "user", "first"), (None, 0, "user", "lost"), (8, None, None, None), (9000, 3, "user", "z" * 100_000)]
    rows.append((9000, 3, "user", "z" * 100_000))  # repeated rows are turns of their own
    frame = local_table(spark, [(*r, 1, "x") for r in rows], SCHEMA).repartition(4)
    if seed == 2:  # salts, several slices, a sketch that is full
        monkeypatch.setattr(trie, "CHUNK", 4)
        monkeypatch.setattr(trie, "SKETCH_CELLS", 1 << 7)
        monkeypatch.setattr(trie, "SLICE", 64)
        monkeypatch.setattr(trie, "BLOCK_BYTES", 50)
    got = trie.prefix_trie(trie.rebuilt(trie.numbered(frame)))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    plain = trie.prefix_trie(trie.as_told(trie.numbered(frame)))
    assert sorted(map(tuple, plain.collect()), key=str) == brute(rows, rebuild=False)


def test_odd_tables(spark):
    empty = local_table(spark, [], SCHEMA)
    assert trie.prefix_trie(trie.rebuilt(trie.numbered(empty))).count() == 0
    lost = local_table(spark, [(None, 0, "user", "x", 1, "x")], SCHEMA)
    assert trie.prefix_trie(trie.rebuilt(trie.numbered(lost))).count() == 0
    # conversations that lose all their turns: the root is the only node, and a leaf
    silent = [c for c in range(1, 400) if zlib.crc32(str(c).encode()) % 9 >= 2 and c % 5][:6]
    rows = [(c, 0, "user", "gone") for c in silent]
    got = trie.prefix_trie(trie.rebuilt(trie.numbered(local_table(spark, [(*r, 1, "x") for r in rows], SCHEMA)))).collect()
    assert [tuple(r) for r in got] == brute(rows) and got[0].n_leaves == 1 and got[0].n_convs == 6


def test_sketch_never_estimates_too_little(spark):
    g = np.random.default_rng(3)
    values = g.integers(-(1 << 62), 1 << 62, (300, 2))
    rows = [tuple(map(int, values[i])) for i in g.integers(0, 300, 3000) ** 2 % 300]
    frame = local_table(spark, rows, "x1 long, x2 long").repartition(5).withColumns({"p1": F.col("x1"), "p2": F.col("x2")})
    exact = {(r.x1, r.x2): r["count"] for r in frame.groupBy("x1", "x2").count().collect()}
    for width in (1 << 6, 1 << 12):
        sketch = trie.count_min(frame, width)
        assert sketch.sum() == trie.SKETCH_ROWS * 3000
        for r in trie.screened(frame, sketch).distinct().collect():
            assert r.est >= exact[r.x1, r.x2] and r.above == r.est
            assert width < 1000 or r.est == exact[r.x1, r.x2]


def test_running_totals_over_partitions(spark):
    g = np.random.default_rng(4)
    rows = [(int(k), int(i), int(g.integers(-5, 50)), int(g.integers(0, 1 << 60))) for k, n in ((-3, 5), (0, 900), (1, 1), (2, 700), (9, 40)) for i in range(n)]
    frame = local_table(spark, rows, "k long, i long, n long, x long").repartition(6)
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for by in ("k", None):
            got = running(frame, by, ["i"] if by else ["k", "i"], {"s": F.col("n")}, {"z": F.col("x")}).collect()
            assert len(got) == len(rows)
            total = defaultdict(lambda: [0, 0])
            for r in sorted(got, key=lambda r: (r.k, r.i)):
                t = total[r.k if by else 0]
                t[0], t[1] = t[0] + r.n, t[1] ^ r.x
                assert [r.s, r.z] == t
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
