import numpy as np
import pytest
from pyspark.sql import functions as F

from reliefgrid.operators import compat, contour, grid, polygons, regions, rings, simplify
from reliefgrid.operators.polygons import with_next
from reliefgrid.runtime import local_table


def lv(spark, *t):
    return grid.levels_table(spark, list(t))


def steps():
    a = np.zeros((20, 20))
    a[5:15, 5:15], a[8:12, 8:12], a[9:11, 9:11] = 1, 2, 3
    return a


def noisy(seed=1, n=23, m=31):
    return np.random.default_rng(seed).integers(0, 10, (n, m)).astype(float)


def test_step_areas(make, spark):
    out = contour.level_outline(make(steps()), lv(spark, 0.5, 1.5, 2.5)).orderBy("level_idx").collect()
    assert [r["area"] for r in out] == [99.5, 15.5, 3.5]
    hole = np.ones((3, 3))
    hole[1, 1] = 0
    for a, want in ((np.ones((1, 1)), 0.5), (np.ones((3, 3)), 8.5), (hole, 8.0)):
        assert contour.level_outline(make(a), lv(spark, 0.5)).first()["area"] == want


def test_missing_cells_count_as_low(make, spark):
    a = np.ones((3, 3))
    a[1, 1] = np.nan
    assert contour.level_outline(make(a), lv(spark, 0.5)).first()["area"] == 8.0


def test_tiles_do_not_change_results(make, spark):
    cells, levels = make(noisy(1, 13, 19)), lv(spark, 3, 6)
    for saddles in ("low",):
        seen = []
        for bits in (2, 7):
            r = rings.trace_rings(cells, levels, saddles, tile_bits=bits)
            seen.append(sorted(map(tuple, r.select("level_idx", "ring_id", "seq", "x1", "y1", "x2", "y2").collect())))
        assert seen[0] == seen[1]
    for conn, high in ((8, True), (4, False)):
        seen = [
            sorted(map(tuple, regions.label_components(cells, levels, conn, high, bits).collect())) for bits in (2, 7)
        ]
        assert seen[0] == seen[1]


def test_rings_close_and_cover(make, spark):
    cells, levels = make(noisy(4)), lv(spark, 5)
    r = rings.trace_rings(cells, levels, tile_bits=3, keep_frame=True)
    p = r.toPandas().sort_values(["ring_id", "seq"])
    for ring_id, g in p.groupby("ring_id"):
        assert (g["seq"].to_numpy() == np.arange(len(g))).all()
        assert (np.roll(g["x1"], -1) == g["x2"]).all() and (np.roll(g["y1"], -1) == g["y2"]).all()
        keys = (g["y1"].to_numpy(np.int64) + 4 << 32) + g["x1"] + 4
        assert ring_id == keys.min() == keys.iloc[0]
    assert len(p) == contour.contour_segments(cells, levels).count()


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7)]
    df = local_table(spark, [("g", a, b) for a, b in edges] + [("h", 3, 2)], "k string, a long, b long")
    got = {(r["k"], r["node"]): r["root"] for r in regions.connected_components(df, ["k"]).collect()}
    assert all(got[("g", i)] == 0 for i in range(41))
    assert got[("g", 102)] == 100 and got[("h", 3)] == 2 and len(got) == 46


def test_many_levels_are_labelled_in_parts(make, spark, monkeypatch):
    cells, levels = make(noisy(2, 9, 9)), lv(spark, 2, 4, 6)
    want = sorted(map(tuple, regions.label_components(cells, levels).collect()))
    monkeypatch.setattr(regions, "LEVELS_PER_CALL", 2)
    assert sorted(map(tuple, regions.label_components(cells, levels).collect())) == want


def test_flat_grid_gives_nothing(make, spark):
    assert polygons.slice_polygons(make(np.ones((10, 10))), lv(spark, 0.5)).isEmpty()
    assert not rings.trace_rings(make(np.ones((10, 10))), lv(spark, 0.5), keep_frame=True).isEmpty()


def test_slice_with_hole_and_island(make, spark):
    a = np.zeros((13, 13))
    a[1:12, 1:12] = 1
    a[3:10, 3:10] = 0
    a[5:8, 5:8] = 1
    m = polygons.polygon_measures(polygons.slice_polygons(make(a), lv(spark, 0.5), tile_bits=2)).orderBy("area").collect()
    assert [r["holes"] for r in m] == [0, 1] and m[0]["area"] == 8.5
    assert m[1]["area"] == contour.level_outline(make(a), lv(spark, 0.5)).first()["area"] - 8.5
    assert (m[1]["centroid_x"], m[1]["centroid_y"]) == pytest.approx((6.0, 6.0))


def poly(spark, *ring_list):
    rows = []
    for pid, rid, role, pts in ring_list:
        rows += [(pid, rid, role, i, float(x), float(y)) for i, (x, y) in enumerate(pts)]
    return local_table(spark, rows, "poly_id long, ring_id long, role string, seq int, x double, y double")


SQUARE = [(0, 0), (2, 0), (2, 2), (0, 2)]


def test_polygon_validity(spark):
    tie = [(0, 0), (1, 1), (1, 0), (0, 1)]
    tiny = [(0, 0), (0.1, 0), (0.1, 0.1), (0, 0.1)]
    line = [(0, 0), (1, 0), (2, 0)]
    touch = [(0, 0), (4, 0), (4, 4), (2, 0), (0, 4)]
    r = poly(spark, (1, 1, "exterior", SQUARE), (2, 2, "exterior", tie), (3, 3, "exterior", tiny),
             (4, 4, "exterior", line), (5, 5, "exterior", touch))
    got = {x["poly_id"]: x["valid"] for x in polygons.is_valid_polygon(r, 1.0).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_contour_to_polygon(spark):
    rows = [(1, i, r, c) for i, (r, c) in enumerate([(1, 1), (1, 4), (4, 4), (4, 1), (1, 1)])] + [(2, 0, 1, 1), (2, 1, 2, 2)]
    out = polygons.contour_to_polygon(local_table(spark, rows, "contour_id long, seq int, row int, col int"))
    m = polygons.polygon_measures(out).collect()
    assert len(m) == 1 and abs(m[0]["area"]) == 9.0 and m[0]["points"] == 4


def test_point_in_polygon(spark):
    r = poly(spark, (1, 1, "exterior", [(0, 0), (8, 0), (8, 8), (0, 8)]), (1, 2, "hole", [(2, 2), (4, 2), (4, 4), (2, 4)]))
    pts = [(x / 2, y / 2) for x in range(-1, 18) for y in range(-1, 18)]
    df = local_table(spark, [(1, float(x), float(y)) for x, y in pts], "poly_id long, x double, y double")
    got = {(p["x"], p["y"]) for p in polygons.point_in_polygon(df, r).collect()}
    want = {(x, y) for x, y in pts if 0 < x < 8 and 0 < y < 8 and not (2 <= x <= 4 and 2 <= y <= 4)}
    assert got == want


def test_hole_cleanup_branches(spark):
    big = [(0, 0), (10, 0), (10, 10), (0, 10)]
    r = poly(spark, (1, 1, "exterior", SQUARE), (1, 2, "hole", big), (2, 3, "exterior", big), (2, 4, "hole", [(0, 0), (8, 0), (8, 8), (0, 8)]),
             (3, 5, "exterior", big), (3, 6, "hole", SQUARE))
    got = {(x["poly_id"], x["ring_id"], x["role"]) for x in polygons.hole_share_cleanup(r).select("poly_id", "ring_id", "role").distinct().collect()}
    assert got == {(1, 2, "exterior"), (1, 1, "hole"), (2, 3, "exterior"), (3, 5, "exterior"), (3, 6, "hole")}


def test_drop_collinear(spark):
    pts = [(0, 0), (1, 0), (2, 0), (2, 2), (0, 2), (0, 1)]
    out = rings.drop_collinear(with_next(poly(spark, (1, 1, "exterior", pts))), ["poly_id", "ring_id"])
    assert {(r["x"], r["y"]) for r in out.collect()} == {(0, 0), (2, 0), (2, 2), (0, 2)}


# ---- simplification ----------------------------------------------------------------------------


def wavy(n=400):
    t = np.linspace(0, 2 * np.pi, n, endpoint=False)
    rad = 50 + 4 * np.sin(9 * t) + np.random.default_rng(2).normal(0, 0.8, n)
    return list(zip(rad * np.cos(t), rad * np.sin(t)))


def test_simplify_reaches_the_limit(spark):
    r = poly(spark, (1, 1, "exterior", wavy()), (1, 2, "hole", [(x / 4, y / 4) for x, y in wavy(90)]), (2, 3, "exterior", SQUARE))
    out = simplify.simplify_rings(r, 0.5, 60)
    n = {x["ring_id"]: x["count"] for x in out.groupBy("ring_id").count().collect()}
    assert n[1] <= 59 and n[2] < 90 and n[3] >= 3
    area = {x["poly_id"]: x["area"] for x in polygons.polygon_measures(r.filter("role = 'exterior'")).collect()}
    new = {x["poly_id"]: x["area"] for x in polygons.polygon_measures(out.filter("role = 'exterior'")).collect()}
    assert abs(new[1] - area[1]) / area[1] < 0.05
    assert simplify.simplify_rings(r, 0.5, 1000).count() == r.count()


def test_long_rings_simplify_like_short_ones(spark, monkeypatch):
    r = poly(spark, (1, 1, "exterior", wavy()), (1, 2, "hole", [(x / 4, y / 4) for x, y in wavy(90)]))
    want = sorted(map(tuple, simplify.simplify_rings(r, 0.5, 60).select("ring_id", "seq", "x", "y", "nx", "ny").collect()))
    monkeypatch.setattr(simplify, "CHAIN_POINTS", 70)
    got = sorted(map(tuple, simplify.simplify_rings(r, 0.5, 60).select("ring_id", "seq", "x", "y", "nx", "ny").collect()))
    assert got == want
    once = simplify.simplify_once(r, 1.0).filter("ring_id = 1").orderBy("seq").collect()
    x, y = map(np.array, zip(*wavy()))
    idx = simplify.simplify_ring(x, y, 1.0)
    assert [(p["x"], p["y"]) for p in once] == list(zip(x[idx], y[idx]))


# ---- the original chain of steps ---------------------------------------------------------------


def test_compat_blocks(make, spark):
    blocks = {}
    for name, n in (("three", 3), ("five", 5)):
        blocks[name] = np.zeros((n + 4, n + 4))
        blocks[name][2 : n + 2, 2 : n + 2] = 1
    blocks["hole"] = np.zeros((13, 13))
    blocks["hole"][2:11, 2:11] = 1
    blocks["hole"][5:8, 5:8] = 0
    cells = None
    for name, a in blocks.items():
        cells = make(a, name) if cells is None else cells.unionByName(make(a, name))
    m = polygons.polygon_measures(polygons.slice_polygons(cells, lv(spark, 0.5), 1e-2, 0.01, mode="compat"))
    got = sorted((r["raster_id"], r["area"], r["holes"]) for r in m.collect())
    # the corners of a hole's centre border are cut
    assert got == [("five", 24.5, 0), ("hole", 14.0, 0), ("hole", 80.5, 0), ("three", 8.5 - 4.0, 1)]


def _inside(px, py, pts):
    x, y = pts[:, 0], pts[:, 1]
    nx, ny = np.roll(x, -1), np.roll(y, -1)
    odd = np.zeros(px.shape, dtype=bool)
    for a, b, c, d in zip(x, y, nx, ny):
        if b != d:
            odd ^= ((b > py) != (d > py)) & (px < a + (py - b) * (c - a) / (d - b))
    return odd


def _by_ring(df, key):
    p = df.toPandas().sort_values([*key, "seq"])
    return {k: g for k, g in p.groupby(key)}


@pytest.mark.parametrize("seed,share", [(0, 0.75)])
def test_compat_pieces_match_the_definition(make, spark, seed, share):
    """Sample points: in some outline, and in no region whose centre border is a simple ring."""
    rng = np.random.default_rng(seed)
    a = np.zeros((18, 18))
    a[1:17, 1:17] = np.kron(rng.random((8, 8)) < share, np.ones((2, 2)))
    cells, levels = make(a), lv(spark, 0.5)
    ys, xs = np.mgrid[-1:18:0.25, -1:18:0.25] + 0.11
    want = np.zeros(xs.shape, dtype=bool)
    for g in _by_ring(rings.trace_rings(cells, levels), ["ring_id"]).values():
        want |= _inside(xs, ys, g[["x1", "y1"]].to_numpy() / 2)
    high = rings.trace_rings(cells, levels, "high")
    borders = _by_ring(compat.centre_borders(high), ["ring_id"])
    area = {r["ring_id"]: r["area"] for r in rings.ring_table(high).collect()}
    labels = regions.label_components(cells, levels, 8).toPandas().set_index(["row", "col"])["region"]
    owner = {k[0]: labels[(int(g["y"].iloc[0]), int(g["x"].iloc[0]))] for k, g in borders.items()}
    for k, g in borders.items():
        k = k[0]
        if area[k] < 0 or len(g) < 3 or g.duplicated(["x", "y"]).any():
            continue
        cut = _inside(xs, ys, g[["x", "y"]].to_numpy())
        for h, gh in borders.items():
            if area[h[0]] < 0 and owner[h[0]] == owner[k]:
                cut &= ~_inside(xs, ys, gh[["x", "y"]].to_numpy())
        want &= ~cut
    got = np.zeros(xs.shape, dtype=bool)
    pieces = compat.compat_polygons(cells, levels)
    for (pid,), _ in _by_ring(pieces, ["poly_id"]).items():
        one = pieces.filter(F.col("poly_id") == int(pid)).toPandas().sort_values(["ring_id", "seq"])
        inside = np.zeros(xs.shape, dtype=bool)
        for role in ("exterior", "hole"):
            for _, g in one[one["role"] == role].groupby("ring_id"):
                hit = _inside(xs, ys, g[["x", "y"]].to_numpy())
                inside = inside | hit if role == "exterior" else inside & ~hit
        got |= inside
    assert (got != want).mean() < 0.02


def test_one_long_edge_among_many_short_ones(spark):
    """A staircase closed by one diagonal: rows in proportion to the edges, and the right answer."""
    from reliefgrid.operators.boxes import box_pairs

    n = 1500
    steps = [(k, k + j) for k in range(n) for j in (0, 1)]  # ends at (n-1, n); the closing edge runs along all steps
    rows = [(1, 1, "exterior", k, float(x), float(y)) for k, (x, y) in enumerate(steps)]
    rows += [(2, 2, "exterior", k, float(x), float(y) - (0.5 if k == 0 else 0)) for k, (x, y) in enumerate(steps)]
    schema = "poly_id long, ring_id long, role string, seq int, x double, y double"
    rings = local_table(spark, rows, schema).repartition(3)
    e = polygons.with_next(rings)
    ends = [f(p, q).alias(f"{b}_{p}") for b, f in (("lo", F.least), ("hi", F.greatest)) for p, q in (("x", "nx"), ("y", "ny"))]
    assert box_pairs(e.select("ring_id", "seq", *ends), ["ring_id"], "xy", "seq").count() < 2 * 2 * (2 * 2 * n)
    assert polygons.invalid_rings(rings).count() == 2
    fine = [(1, 1, "exterior", k, float(x), float(y)) for k, (x, y) in enumerate([*steps, (n, -1)])]
    assert polygons.invalid_rings(local_table(spark, fine, schema)).count() == 0


def even_odd(x, y, ring):
    inside = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        side = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        if side == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return None
        if (ay > y) != (by > y) and ((side > 0) if by > ay else (side < 0)):
            inside = not inside
    return inside


@pytest.mark.parametrize("limit", [64, 0])
def test_point_in_polygon_by_definition(spark, limit, monkeypatch):
    """Combs, slanted combs, spirals, crossing rings and holes; with ``limit`` 0 all go by dyadic intervals."""
    monkeypatch.setattr(polygons, "BAND_EDGES", limit)
    g = np.random.default_rng(8)
    comb = [p for k in range(150) for p in ((k, 0.0), (k, 8.0), (k + 0.5, 8.0), (k + 0.5, 0.0))] + [(150.0, 0.0), (150.0, -1.0), (0.0, -1.0)]
    slant = [p for k in range(120) for p in ((k, 0.0), (k + 2.5, 8.0 + k % 3))] + [(125.0, -1.0), (0.0, -1.0)]
    star = [(float(x), float(y)) for x, y in g.integers(0, 30, (40, 2))]  # crosses itself
    parts = [(1, 1, "exterior", comb), (2, 2, "exterior", slant), (3, 3, "exterior", star), (4, 4, "exterior", [(0, 0), (20, 0), (20, 20), (0, 20)]), (4, 5, "hole", [(5, 5), (25, 6), (9, 15)]), (4, 6, "hole", [(1, 1), (1, 3), (3, 3), (3, 1)])]
    rings = poly(spark, *parts).repartition(3)
    points = [(k, float(x), float(y)) for k in (1, 2, 3, 4) for x, y in np.concatenate([g.integers(-2, 300, (200, 2)) / [2, 30], g.uniform(-1, 30, (100, 2)), g.integers(0, 26, (150, 2))])]
    points += [(k, float(x), float(y)) for k, _, _, ring in parts for x, y in ring[:20]] + [(9, 1.0, 1.0), (1, None, 2.0)]
    frame = local_table(spark, points, "poly_id long, x double, y double").repartition(3)
    got = sorted(tuple(r) for r in polygons.point_in_polygon(frame, rings).collect())
    want = []
    for k, x, y in points:
        if x is not None:
            inside = [even_odd(x, y, ring) for p, _, role, ring in parts if p == k and role == "exterior"]
            holes = [even_odd(x, y, ring) for p, _, role, ring in parts if p == k and role == "hole"]
            if None not in inside + holes and sum(inside) % 2 == 1 and sum(holes) % 2 == 0:
                want.append((k, x, y))
    assert got == sorted(want) and len(want) > 300


def test_a_comb_costs_no_pairs(spark, monkeypatch):
    """Of 100,000 teeth a point meets those it stands between."""
    from reliefgrid.operators import containment

    n = 100_000
    teeth = spark.range(n).select(F.lit(1).cast("long").alias("poly_id"), F.lit(1).cast("long").alias("ring_id"), F.lit("exterior").alias("role"), F.posexplode(F.array(*[F.struct((F.col("id") + a).alias("x"), F.lit(b).alias("y")) for a, b in ((0.0, 0.0), (0.0, 8.0), (0.5, 8.0), (0.5, 0.0))])).alias("j", "p"), "id")
    base = local_table(spark, [(1, 1, "exterior", 4 * n, float(n), 0.0), (1, 1, "exterior", 4 * n + 1, float(n), -1.0), (1, 1, "exterior", 4 * n + 2, 0.0, -1.0)], "poly_id long, ring_id long, role string, seq int, x double, y double")
    rings = teeth.select("poly_id", "ring_id", "role", (F.col("id") * 4 + F.col("j")).cast("int").alias("seq"), "p.x", "p.y").unionByName(base)
    points = spark.range(2000).select(F.lit(1).cast("long").alias("poly_id"), (F.col("id") * 49.99 + 0.25 * (F.col("id") % 4)).alias("x"), (F.col("id") % 9 - 0.5).alias("y"))
    rows = []
    real = containment.cut
    monkeypatch.setattr(containment, "cut", lambda df: (lambda out: (rows.append((out.columns, out.count())), out)[1])(real(df)))
    got = {(r.x, r.y) for r in polygons.point_in_polygon(points, rings).collect()}
    want = {(r.x, r.y) for r in points.collect() if -1 < r.y < 0 or (0 < r.y < 8 and 0 < r.x % 1 < 0.5)}
    assert got == {p for p in want if p[0] > 0}
    asks = [c for names, c in rows if "_pid" in names and "_k" in names]
    assert asks and asks[0] < 40 * 2000


def crossings(rings):
    """Pairs of edges of all rings (lists of points) that meet elsewhere than at common ends."""
    e = np.array([(*p, *q) for r in rings for p, q in zip(r, r[1:] + r[:1])])
    i, j = np.triu_indices(len(e), 1)
    a, b = e[i], e[j]
    turn = lambda px, py, qx, qy, tx, ty: np.sign((qx - px) * (ty - py) - (qy - py) * (tx - px))
    d1, d2 = turn(*a.T, b[:, 0], b[:, 1]), turn(*a.T, b[:, 2], b[:, 3])
    d3, d4 = turn(*b.T, a[:, 0], a[:, 1]), turn(*b.T, a[:, 2], a[:, 3])
    boxes = np.ones(len(a), bool)
    for k in (0, 1):
        boxes &= (np.maximum(a[:, k], a[:, k + 2]) >= np.minimum(b[:, k], b[:, k + 2])) & (np.maximum(b[:, k], b[:, k + 2]) >= np.minimum(a[:, k], a[:, k + 2]))
    joined = np.zeros(len(a), bool)
    for p in (0, 2):
        for q in (0, 2):
            joined |= (a[:, p] == b[:, q]) & (a[:, p + 1] == b[:, q + 1])
    return int((boxes & (d1 * d2 <= 0) & (d3 * d4 <= 0) & ~joined).sum())


def test_simplified_rings_stay_valid(spark):
    """Wiggly rings with holes and neighbours close to them, at tolerances that make them cross."""
    g = np.random.default_rng(12)
    t = np.linspace(0, 2 * np.pi, 240, endpoint=False)
    parts = []
    for k in range(3):
        wave = 1.5 * np.sin(17 * t + k) + 0.8 * np.sin(41 * t)
        ring = lambda r, cx=60.0 * k: [(float(cx + a), float(b)) for a, b in zip((r + wave) * np.cos(t), (r + wave) * np.sin(t))]  # noqa: E731, B023
        parts += [(10 * k, 10 * k, "exterior", ring(20)), (10 * k, 10 * k + 1, "hole", ring(19.4)[::-1]), (10 * k + 5, 10 * k + 5, "exterior", ring(21.0 + 0.4 * g.random()))]
        parts += [(10 * k + 6, 10 * k + 6, "exterior", ring(18.9))] if k else []
    rings = poly(spark, *parts).repartition(3)
    assert crossings([p[3] for p in parts]) == 0
    loose = simplify.simplify_rings(rings, 0.5, 40, valid=False)
    tight = simplify.simplify_rings(rings, 0.5, 40)
    as_lists = lambda df: {k: [(r.x, r.y) for r in sorted(rows, key=lambda r: r.seq)] for k, rows in by_ring(df).items()}
    found, before = as_lists(tight), as_lists(loose)
    assert crossings(list(before.values())) > 10 and crossings(list(found.values())) == 0
    assert polygons.invalid_rings(tight).count() == 0
    for poly_id, ring_id, role, ring in parts:
        have = found[poly_id, ring_id]
        assert set(before[poly_id, ring_id]) <= set(have) <= set(ring) and [p for p in ring if p in set(have)] == have
        if role == "hole":
            assert all(even_odd(x, y, found[poly_id, poly_id]) for x, y in have)
    assert sum(map(len, found.values())) < 0.9 * sum(len(p[3]) for p in parts)
    assert {(r.x, r.y, r.nx, r.ny) for r in tight.collect()} == {(*p, *q) for r in found.values() for p, q in zip(r, r[1:] + r[:1])}


def test_holes_stay_inside(spark):
    """A pocket that simplification cuts off, with a hole in it that no edge crosses."""
    outer = [(0, 0), (20, 0), (20, 9), (20.4, 9), (20.4, 11), (20, 11), (20, 20), (0, 20)] + [(0, float(y)) for y in range(19, 0, -1)]
    hole = [(20.1, 9.5), (20.1, 10.5), (20.3, 10.5), (20.3, 9.5)]
    r = poly(spark, (1, 1, "exterior", outer), (1, 2, "hole", hole))
    loose = by_ring(simplify.simplify_rings(r, 0.5, 12, valid=False))
    assert (20.4, 9.0) not in {(p.x, p.y) for p in loose[1, 1]}
    tight = by_ring(simplify.simplify_rings(r, 0.5, 12))
    ring = [(p.x, p.y) for p in sorted(tight[1, 1], key=lambda p: p.seq)]
    assert all(even_odd(p.x, p.y, ring) for p in tight[1, 2])


def by_ring(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.poly_id, r.ring_id), []).append(r)
    return out
