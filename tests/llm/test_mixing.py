"""Raking against NumPy, the query against SQL, defined results for odd rows."""

import numpy as np
from pyspark.sql import functions as F

from check import compare
from reliefgrid.llm import mixing
from reliefgrid.llm.queries import QUERIES, SQL
from reliefgrid.runtime import local_table

SCHEMA = "doc_id long, text string, lang string, source string, probability string"


def test_query_is_sql(spark):
    result, _ = compare(spark, "/root/testdata/sf0.001", "op4_mix_sources", QUERIES["op4_mix_sources"], SQL["op4_mix_sources"])
    assert result.startswith("ok"), result


def test_given_targets(spark, monkeypatch):
    rng = np.random.default_rng(3)
    table = rng.integers(1, 50, (3, 2, 2)).astype(float)
    rows = [(f"s{i}", f"l{j}", f"t{k}", int(table[i, j, k])) for i in range(3) for j in range(2) for k in range(2)]
    cells = local_table(spark, rows, "source string, lang string, topic string, tokens long")
    goals = {"source": [("s0", 2.0), ("s1", 1.0), ("s2", 1.0), ("gone", 4.0)], "lang": [("l0", 0.5), ("l1", 0.5)], "topic": [("t0", 0.9), ("t1", 0.1)]}
    got = mixing.rake(cells, {d: local_table(spark, g, "value string, share double") for d, g in goals.items()}).collect()
    monkeypatch.setattr(mixing, "LOCAL_CELLS", 5)
    joined = {r[:3]: r.weight for r in mixing.rake(cells, {d: local_table(spark, g, "value string, share double") for d, g in goals.items()}).collect()}
    assert all(abs(joined[r[:3]] - r.weight) < 1e-6 for r in got)
    monkeypatch.undo()
    w = table.copy()
    share = [np.array([0.5, 0.25, 0.25]), np.array([0.5, 0.5]), np.array([0.9, 0.1])]
    for _ in range(300):
        for axis, s in enumerate(share):
            m = w.sum(axis=tuple(a for a in range(3) if a != axis))
            w *= (s * table.sum() / m).reshape([-1 if a == axis else 1 for a in range(3)])
    for r in got:
        assert abs(r.weight - w[int(r.source[1]), int(r.lang[1]), int(r.topic[1])]) < 1e-6
    only = local_table(spark, [("s0", 1.0)], "value string, share double")
    some = {r.source: r.weight for r in mixing.rake(cells, {"source": only}).groupBy("source").agg(F.sum("weight").alias("weight")).collect()}
    assert some["s1"] == some["s2"] == 0 and some["s0"] > 0


def test_sample_and_odd_rows(spark):
    rows = [(i, "the ing ing words " * 5, "en", "big" if i % 3 else "small", "x") for i in range(300)]
    rows += [(None, None, None, None, None), (1000, "", "en", "empty", "x"), (1001, " \t", "de", "empty", "x"), (5, rows[5][1], "en", "big", "x")]
    docs = local_table(spark, rows, SCHEMA).repartition(2)
    marks = mixing.mix(docs).collect()
    assert len(marks) == len(rows)
    chance = {r.source: r.probability for r in marks if r.topic == "short" and r.source in ("big", "small")}
    assert chance["small"] == 1 and abs(chance["big"] - 2.01 ** (mixing.TEMPER - 1)) < 1e-6
    kept = [r for r in marks if r.kept]
    assert {r.doc_id for r in kept} >= {None, 1000, 1001} and abs(sum(r.source == "big" for r in kept) / 200 - chance["big"]) < 0.1
    assert len({r.kept for r in marks if r.doc_id == 5}) == 1
    out = mixing.sampled(docs)
    assert out.columns == docs.columns and sorted((r.doc_id for r in out.collect()), key=str) == sorted((r.doc_id for r in kept), key=str)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.sampled(docs.limit(0)).count() == 0
    assert mixing.sampled(docs.filter("doc_id >= 1000")).count() == 2


def test_shares_reach_their_targets(spark):
    """The call with which the pipeline and the query mix: expected shares are the targets, drawn ones near them."""
    rng = np.random.default_rng(5)
    marks = {"table": "a | b", "short": "a b c", "figures": "a b 123"}
    rows = []
    for s, l, t in [(s, l, t) for s in range(3) for l in range(3) for t in range(3)]:
        n = int(400 * rng.random() ** 3 * (4 if s == l else 1)) + 3
        rows += [(len(rows) + k, list(marks.values())[t], f"l{l}", f"s{s}", None) for k in range(n)]
    docs = local_table(spark, rows, SCHEMA).repartition(2)
    cells = mixing.mix(docs).groupBy(*mixing.DIMENSIONS).agg(F.sum("tokens").alias("tokens"), F.first("probability").alias("p"), F.sum(F.when(F.col("kept"), F.col("tokens")).otherwise(0)).alias("kept")).collect()
    total, expected, drawn = sum(r.tokens for r in cells), sum(r.tokens * r.p for r in cells), sum(r.kept for r in cells)
    assert all(0 < r.p <= 1 for r in cells) and max(r.p for r in cells) == 1 and expected > 0.5 * total
    for d in mixing.DIMENSIONS:
        aim = {v: sum(r.tokens**mixing.TEMPER for r in cells if r[d] == v) for v in {r[d] for r in cells}}
        for v, goal in ((v, a / sum(aim.values())) for v, a in aim.items()):
            assert abs(sum(r.tokens * r.p for r in cells if r[d] == v) / expected - goal) < 1e-8, (d, v)
            assert abs(sum(r.kept for r in cells if r[d] == v) / drawn - goal) < 0.03, (d, v)
