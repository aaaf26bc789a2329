"""Centroid clustering against plain Python integers; the bounds against all distances."""

import hashlib
import math

import numpy as np

from check import compare
from reliefgrid.llm import centroids
from reliefgrid.llm.queries import QUERIES, SQL
from reliefgrid.runtime import local_table

SCHEMA = "vec_id long, embedding array<float>, cluster string, v int"


def brute(rows, k, rounds, size):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    rank = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centres = [list(v) for _, v in sorted(kept, key=rank)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for step in range(rounds + 1):
        where = [min(range(len(centres)), key=lambda c: (far(v, centres[c]), c)) for _, v in kept]
        if step < rounds:
            for c in range(len(centres)):
                own = [v for (_, v), w in zip(kept, where) if w == c]
                if own:
                    centres[c] = [sum(x) // len(own) for x in zip(*own)]
    d = [far(v, centres[w]) for (_, v), w in zip(kept, where)]
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    per = [sum(x for x, w in zip(d, where) if w == c) for c in range(len(centres))]
    return sorted(((i, w, x, per[w], sum(d), name[w]) for (i, _), w, x in zip(kept, where, d)), key=str)


def test_query_is_sql(spark):
    result, _ = compare(spark, "/root/testdata/sf0.001", "op11", QUERIES["op11_ptolemaic_clusters"], SQL["op11_ptolemaic_clusters"])
    assert result.startswith("ok"), result


def test_by_definition(spark):
    g = np.random.default_rng(1)
    middle = g.normal(0, 1, (6, 4))
    rows = [(int(i), [float(x) for x in middle[i % 6] + g.normal(0, 0.2, 4)]) for i in range(150)]
    rows += [(3, rows[3][1]), (3, rows[3][1]), (5, rows[8][1]), (None, rows[9][1]), (None, [0.0] * 4), (900, [0.5] * 4), (901, [0.5] * 4), (902, [-0.0001, 0.0, -0.5, 1.0])]
    odd = [(1000, None), (1001, []), (1002, [1.0, None, 0.0, 0.0]), (1003, [1.0, float("nan"), 0.0, 0.0]), (1004, [float("inf"), 0.0, 0.0, 0.0]), (1005, [1.0] * 5)]
    frame = local_table(spark, [(i, v, "x", 1) for i, v in rows + odd], SCHEMA).repartition(4)
    for k, rounds in ((8, 10), (3, 0), (1, 2)):
        got = centroids.clusters(frame, k, rounds, size=4).drop("compared")
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows, k, rounds, 4)
    few = local_table(spark, [(i, v, "x", 1) for i, v in rows[:3]], SCHEMA)
    assert sorted(map(tuple, centroids.clusters(few, 8, 4, size=4).drop("compared").collect()), key=str) == brute(rows[:3], 8, 4, 4)
    none = centroids.clusters(frame.limit(0), size=4)
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "compared"]


def test_bounds_hold_and_prune():
    g = np.random.default_rng(2)
    for spread in (3, 1000, centroids.LIMIT // 2):
        points = g.integers(-spread, spread + 1, (300, 8))
        centres = np.concatenate([points[:6], g.integers(-spread, spread + 1, (6, 8))])
        pivot_points, pairs = centroids.pivots(points[:100], 4)
        to_pivots = np.sqrt(np.stack([centroids.squared(points, p) for p in pivot_points], 1).astype(float))
        centre_to = np.sqrt(centroids.squared(centres[:, None], pivot_points[None]).astype(float))
        between = np.sqrt(centroids.squared(pivot_points[pairs[:, 0]], pivot_points[pairs[:, 1]]).astype(float))
        exact = centroids.squared(points[:, None], centres[None])
        assert (centroids.lower_bounds(to_pivots, centre_to, between, pairs) <= exact).all()
        nearest, distance, _ = centroids.assign(points, to_pivots, centres, pivot_points, pairs)
        assert (nearest == exact.argmin(1)).all() and (distance == exact.min(1)).all()
    # clusters that are apart: most centroids are never looked at
    middle = g.integers(-5000, 5000, (20, 8))
    points = np.repeat(middle, 50, 0) + g.integers(-100, 100, (1000, 8))
    pivot_points, pairs = centroids.pivots(points[::7], 8)
    to_pivots = np.sqrt(np.stack([centroids.squared(points, p) for p in pivot_points], 1).astype(float))
    _, _, compared = centroids.assign(points, to_pivots, middle, pivot_points, pairs)
    assert compared.mean() < 4
