"""Nearest vertices, crossing triangles, orientation: against plain NumPy."""

import numpy as np
import pytest

from reliefgrid.operators import inspect as I
from reliefgrid.operators.crossings import apart, crossing_triangles
from reliefgrid.operators.mesh import Mesh, side_walls
from reliefgrid.operators.nearest import nearest_vertices, outline_edges
from reliefgrid.runtime import local_table

V, T = "mesh_id string, vid long, x double, y double, z double", "mesh_id string, tid long, v0 long, v1 long, v2 long"


def mesh(spark, parts):
    """{mesh_id: (points, triangles)} -> Mesh"""
    v = [(m, i, *map(float, p)) for m, (ps, _) in parts.items() for i, p in enumerate(ps)]
    t = [(m, i, *map(int, f)) for m, (_, fs) in parts.items() for i, f in enumerate(fs)]
    return Mesh(local_table(spark, v, V).repartition(3), local_table(spark, t, T).repartition(3))


@pytest.mark.parametrize("axes", [("x", "y"), ("x", "y", "z")])
def test_nearest_by_brute_force(spark, axes):
    g = np.random.default_rng(3)
    sets = {
        "even": g.uniform(0, 30, (400, 3)),
        "crowd": np.concatenate([g.normal(5, 1e-4, (300, 3)), [[900.0, -700.0, 3.0]]]),
        "line": np.stack([np.arange(50.0), np.zeros(50), np.zeros(50)], 1),
        "one": np.array([[2.0, 2.0, 2.0]]),
        "same": np.array([[1.0, 1.0, 1.0]] * 4 + [[3.0, 1.0, 1.0]] * 3),
        "lattice": np.array([(i % 9, i // 9, 0) for i in range(81)], float),
    }
    rows = [(m, 1000 - i, *map(float, p)) for m, ps in sets.items() for i, p in enumerate(ps)]
    rows.append(("even", 5000, None, 1.0, 1.0))
    vertices = local_table(spark, rows, V).repartition(3)
    asked = np.concatenate([g.uniform(-20, 60, (60, 3)), g.uniform(4.9, 5.1, (30, 3)), np.round(g.uniform(0, 9, (60, 3))) + 0.5, [[1e4, -1e5, 7.0], [2.0, 1.0, 1.0]]])
    points = [(m, i, *map(float, p)) for m in [*sets, "none"] for i, p in enumerate(asked)] + [("even", 9_000, None, 0.0, 0.0)]
    got = nearest_vertices(local_table(spark, points, "mesh_id string, pid long, x double, y double, z double").repartition(4), vertices, axes).collect()
    assert len(got) == len(points)
    k = len(axes)
    for r in got:
        if r.mesh_id == "none" or r.pid == 9_000:
            assert r.vid is None and r.distance is None
            continue
        d = ((sets[r.mesh_id][:, :k] - asked[r.pid, :k]) ** 2)
        d = sum(d[:, i] for i in range(k))
        assert r.vid == 1000 - max(np.nonzero(d == d.min())[0]), (r, d.min())
        assert r.distance == pytest.approx(d.min() ** 0.5, rel=1e-12)


def test_nearest_keeps_rows_few(spark):
    """A crowd of vertices far from the points, and points far from the vertices, meet without all pairs."""
    g = np.random.default_rng(4)
    crowd = g.normal(0, 1e-3, (4_000, 2))
    vertices = local_table(spark, [("m", i, *map(float, p), 0.0) for i, p in enumerate(crowd)], V).repartition(4)
    asked = g.uniform(500, 900, (300, 2))
    points = local_table(spark, [("m", i, *map(float, p), 0.0) for i, p in enumerate(asked)], "mesh_id string, pid long, x double, y double, z double").repartition(4)
    from reliefgrid.operators import nearest

    seen = []
    real = nearest._descended

    def counted(open_, leaf, axes):
        out = real(open_, leaf, axes)
        seen.append(out.count())
        return out

    nearest._descended = counted
    try:
        got = {r.pid: r.vid for r in nearest.nearest_vertices(points, vertices).collect()}
    finally:
        nearest._descended = real
    d = ((asked[:, None] - crowd[None]) ** 2).sum(2)
    assert all(d[p, v] == d[p].min() for p, v in got.items()) and len(got) == 300
    assert seen[0] < 64 * 300  # of 1.2 million pairs


def test_walls_on_an_outline_off_the_lattice(spark):
    cover = mesh(spark, {"m": ([(c, r, 0) for r in range(4) for c in range(4)], [(0, 1, 4)])})
    ring = [(-0.2, 0.1), (3.1, -0.3), (3.2, 3.4), (3.2, 3.3), (0.1, 2.9)]
    rows = [("m", *ring[i], *ring[(i + 1) % 5]) for i in range(5)]
    edges = outline_edges(local_table(spark, rows, "mesh_id string, x double, y double, nx double, ny double"), cover)
    assert sorted((r.a, r.b) for r in edges.collect()) == [(0, 3), (3, 15), (12, 0), (15, 12)]
    assert side_walls(edges).count() == 8


# ---- crossings -------------------------------------------------------------------------------


def meets(p, q):
    """By definition: some side of one triangle meets the other, or both lie in one plane and overlap (rational arithmetic)."""
    from fractions import Fraction as Q

    def vec(a, b):
        return [y - x for x, y in zip(a, b)]

    def cross(a, b):
        return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]

    def dot(a, b):
        return sum(x * y for x, y in zip(a, b))

    p, q = [[Q(x) for x in c] for c in p], [[Q(x) for x in c] for c in q]

    def inside(x, t, n):
        s = [dot(cross(vec(t[i], t[(i + 1) % 3]), vec(t[i], x)), n) for i in range(3)]
        return all(v >= 0 for v in s) or all(v <= 0 for v in s)

    def flat(a, b, c, d, n):
        def o(u, v, w):
            r = dot(cross(vec(u, v), vec(u, w)), n)
            return (r > 0) - (r < 0)

        def on(u, v, w):
            return o(u, v, w) == 0 and all(min(u[k], v[k]) <= w[k] <= max(u[k], v[k]) for k in range(3))

        if o(a, b, c) * o(a, b, d) < 0 and o(c, d, a) * o(c, d, b) < 0:
            return True
        return on(a, b, c) or on(a, b, d) or on(c, d, a) or on(c, d, b)

    for s, t in ((p, q), (q, p)):
        n = cross(vec(t[0], t[1]), vec(t[0], t[2]))
        for i in range(3):
            a, b = s[i], s[(i + 1) % 3]
            da, db = dot(n, vec(t[0], a)), dot(n, vec(t[0], b))
            if da * db > 0:
                continue
            if da == 0 and db == 0:
                if inside(a, t, n) or any(flat(a, b, t[j], t[(j + 1) % 3], n) for j in range(3)):
                    return True
                continue
            w = da / (da - db)
            if inside([x + w * (y - x) for x, y in zip(a, b)], t, n):
                return True
    return False


def test_apart_by_definition():
    g = np.random.default_rng(5)
    a, b = g.integers(0, 6, (3000, 3, 3)), g.integers(0, 6, (3000, 3, 3))
    b[:600, :, 2] = a[:600, :, 2] = 2  # in one plane
    real = [i for i in range(len(a)) if all(np.cross(t[1] - t[0], t[2] - t[0]).any() for t in (a[i], b[i]))]
    got = apart(a.astype(float), b.astype(float))
    want = [not meets(a[i].tolist(), b[i].tolist()) for i in real]
    assert got[real].tolist() == want and 100 < sum(want) < len(want) - 100


def test_crossing_triangles_of_many_sizes(spark):
    g = np.random.default_rng(6)
    points, faces = [], []
    for size, n in ((1, 100), (3, 40), (20, 6), (0, 5)):
        for _ in range(n):
            base = g.integers(-4, 4, 3)
            points += [tuple(base + g.integers(0, size + 1, 3)) for _ in range(3)]
            faces.append((len(points) - 3, len(points) - 2, len(points) - 1))
    faces.append((0, 1, 4))  # shares vertices with two others
    got = {(r.a, r.b) for r in crossing_triangles(mesh(spark, {"m": (points, faces), "empty": ([(0, 0, 0)], [])})).collect()}
    p = np.array(points, float)[np.array(faces)]
    i, j = np.triu_indices(len(faces), 1)
    near = ~apart(p[i], p[j])
    want = {(a, b) for a, b in zip(i[near].tolist(), j[near].tolist()) if not set(faces[a]) & set(faces[b])}
    assert got == want and len(want) > 30


def test_a_large_triangle_costs_no_more_rows(spark):
    from pyspark.sql import functions as F

    from reliefgrid.operators.boxes import box_pairs

    rows = [("m", i, float(i), 0.0, 0.0, i + 0.5, 0.5, 0.5) for i in range(2000)] + [("m", 9999, 0.0, 0.0, 0.0, 2000.0, 1.0, 1.0)]
    names = [f"{e}_{c}" for e in ("lo", "hi") for c in "xyz"]
    boxes = local_table(spark, rows, "mesh_id string, tid long, " + ", ".join(f"{n} double" for n in names))
    pairs = box_pairs(boxes).groupBy((F.greatest("a.tid", "b.tid") == 9999).alias("large")).count().collect()
    assert {r["large"]: r["count"] for r in pairs} == {True: 2000}


# ---- orientation -----------------------------------------------------------------------------


def band(n, twist, flips=()):
    """A closed strip of ``n`` squares, with or without half a turn; ``flips`` are triangles turned over."""
    faces = []
    for i in range(n):
        a, b = 2 * i, 2 * i + 1
        c, d = (2 * i + 2, 2 * i + 3) if i < n - 1 else ((1, 0) if twist else (0, 1))
        faces += [(a, b, c), (c, b, d)]
    faces = [f[::-1] if k in flips else f for k, f in enumerate(faces)]
    return [(k // 2, k % 2, 0) for k in range(2 * n)], faces


def test_orientable(spark):
    g = np.random.default_rng(7)
    some = {f"{'moebius' if t else 'ring'} {n} {k}": band(n, t, set(np.nonzero(g.random(2 * n) < k / 3)[0].tolist())) for t in (0, 1) for n in (3, 4, 17, 60) for k in range(3)}
    some["strip"] = ([(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0)], [(0, 1, 2), (1, 2, 3)])
    some["book"] = ([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 1, 1)], [(0, 1, 2), (0, 1, 3), (0, 1, 4)])
    some["single"] = ([(0, 0, 0), (1, 0, 0), (0, 1, 0)], [(0, 1, 2)])
    some["degenerate"] = ([(0, 0, 0), (1, 0, 0), (0, 1, 0)], [(0, 1, 2), (0, 0, 1)])
    some["two parts"] = (lambda a, b: (a[0] + b[0], a[1] + [tuple(v + len(a[0]) for v in f) for f in b[1]]))(band(5, 0), band(5, 1))
    m = mesh(spark, some)
    want = {k: not (k.startswith("moebius") or k in ("book", "two parts")) for k in some}
    bad = {r.mesh_id for r in I.unorientable(m).collect()}
    assert bad == {k for k, fine in want.items() if not fine}
    info = {r.mesh_id: r.is_orientable for r in I.mesh_info(m).collect()}
    assert {k: v for k, v in info.items() if k != "degenerate"} == {k: v for k, v in want.items() if k != "degenerate"}


def test_undecodable_pictures_are_named(spark, tmp_path):
    from reliefgrid.sources import images

    (tmp_path / "broken.png").write_bytes(b"no picture")
    with pytest.raises(Exception, match="cannot read image .*broken.png"):
        images.image_info(spark, str(tmp_path)).collect()
