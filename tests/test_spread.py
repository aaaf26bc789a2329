"""Work on polygons is spread over tasks, and a point of a triangulation costs the triangles near it."""

import time

import numpy as np
from pyspark.sql import functions as F

from reliefgrid.config import ContourSettings, MeshSettings
from reliefgrid.operators import cleanup, fill, grid, mesh, polygons, regions, triangulate
from reliefgrid.plans.pipelines import level_solids
from reliefgrid.runtime import attach, cut, local_table

RINGS = "poly_id long, ring_id long, role string, seq int, x double, y double"


def squares(spark, n):
    rows = [(p, p, "exterior", k, float(4 * p + x), float(y)) for p in range(n) for k, (x, y) in enumerate([(0, 0), (1, 0), (2, 0), (2, 2), (0, 2)])]
    return local_table(spark, rows, RINGS)


def test_polygons_are_triangulated_by_many_tasks(spark):
    vertices, triangles, _ = triangulate.delaunay(squares(spark, 40), None)
    assert len(vertices.inputFiles()) > 1
    assert {r["count"] for r in vertices.groupBy("poly_id").count().collect()} == {5} and triangles.select("poly_id").distinct().count() == 40


def test_delaunay_by_definition():
    g = np.random.default_rng(3).random((60, 2))
    tri = triangulate._delaunay(g[:, 0], g[:, 1])
    assert len(tri) > 90
    for t in tri:
        a, b, c = g[t]
        m = np.linalg.solve(2 * np.array([b - a, c - a]), [b @ b - a @ a, c @ c - a @ a])
        assert (np.hypot(*(g - m).T) > np.hypot(*(a - m)) - 1e-5).all()


def test_delaunay_of_many_points():
    g = np.random.default_rng(5).random((20_000, 2))
    g = g[np.argsort(np.floor(g[:, 0] * 140) + g[:, 1])]
    t = time.time()
    tri = triangulate._delaunay(g[:, 0], g[:, 1])
    assert len(tri) > 39_900 and time.time() - t < 12  # all triangles looked at for every point take 30 s


def test_cleaning_steps_are_not_repeated(spark):
    """What a step reads more than once is written: places of vertices, and triangles whose vertices are kept."""
    v = local_table(spark, [("m", i, float(i), 0.0, 0.0) for i in range(4)], "mesh_id string, vid long, x double, y double, z double")
    t = local_table(spark, [("m", 0, 0, 1, 2)], "mesh_id string, tid long, v0 long, v1 long, v2 long")
    once = cleanup.remove_duplicate_vertices(mesh.Mesh(v, t))
    assert once.vertices.inputFiles() and once.vertices.count() == 4 and once.triangles.collect() == t.collect()
    used = cleanup.remove_unreferenced(mesh.Mesh(v, t))
    assert used.triangles.inputFiles() and sorted(r.vid for r in used.vertices.collect()) == [0, 1, 2]


def stacked_squares(spark, n=12):
    """Two sheets of ``n`` by ``n`` squares, one on top of the other, as meshes of their own with the same ids."""
    v = [(f"m/{k}", i * (n + 1) + j, j / 2, i / 2, 0.5) for k in (0, 1) for i in range(n + 1) for j in range(n + 1)]
    t = [(f"m/{k}", i * n + j, a, a + 1, a + n + 1) for k in (0, 1) for i in range(n) for j in range(n) for a in (i * (n + 1) + j,)]
    return mesh.Mesh(
        local_table(spark, v, "mesh_id string, vid long, x double, y double, z double"),
        local_table(spark, t, "mesh_id string, tid long, v0 long, v1 long, v2 long"),
    )


def test_round_places_lie_in_one_cell(spark):
    v = stacked_squares(spark).vertices.filter("mesh_id = 'm/0'")
    assert cleanup.company_cells(v, 1e-6).count() == v.count() == 169
    assert cleanup.with_company(v, 1e-6).isEmpty()


def test_combined_triangles_are_moved_once(spark, monkeypatch):
    m, calls, remap = stacked_squares(spark), [], cleanup.remap
    monkeypatch.setattr(cleanup, "remap", lambda *a: calls.append(1) or remap(*a))
    out = cleanup.combine_meshes(m, mesh_id=F.lit("m"))
    assert len(calls) == 1
    steps = cleanup.merge_close_vertices(cleanup.concat_meshes(m, F.lit("m")))
    assert sorted(out.triangles.collect()) == sorted(steps.triangles.collect())
    used = {c for r in steps.triangles.collect() for c in (r.v0, r.v1, r.v2)}
    assert sorted(out.vertices.collect()) == sorted(r for r in steps.vertices.collect() if r.vid in used)


def test_border_cells_are_marked_among_all(make, spark):
    cells, lv = make(np.random.default_rng(11).integers(0, 9, (21, 19)), "r"), grid.levels_table(spark, [3, 6])
    every, border = [regions.region_labels(cells, lv, 4, (True,), border_only=b, tile_bits=3) for b in (False, True)]
    some = sorted(every.filter("border").collect())
    assert some == sorted(border.collect()) and 0 < len(some) < every.count()


def test_regions_are_searched_once_for_faces_and_stages(make, spark, tmp_path, monkeypatch):
    cells, lv = make(np.random.default_rng(12).integers(0, 9, (20, 23)), "r"), grid.levels_table(spark, [3, 6])
    contour = ContourSettings(min_polygon_area=0.6, min_area_fraction=0.02)
    plain = level_solids(cells, lv, MeshSettings(contour=contour))
    want = sorted(plain.triangles.collect())
    rings = sorted(polygons.slice_polygons(cells, lv, 0.6, 0.02).collect())
    calls, labels = [], polygons.region_labels
    monkeypatch.setattr(polygons, "region_labels", lambda *a, **k: calls.append(1) or labels(*a, **k))
    staged = level_solids(cells, lv, MeshSettings(contour=contour, stages_path=str(tmp_path)))
    assert len(calls) == 1 and sorted(staged.triangles.collect()) == want
    columns = ["raster_id", "level_idx", "poly_id", "ring_id", "role", "seq", "x", "y", "nx", "ny"]
    assert sorted(spark.read.parquet(f"{tmp_path}/contours").select(*columns).collect()) == rings


def test_filled_cells_are_not_collected(spark):
    """Files of cells are small and their rows are many: neither gap cells nor new heights are broadcast."""
    cells = cut(spark.range(40_000).selectExpr("'r' as raster_id", "cast(id div 100 as int) as row", "cast(id % 100 as int) as col", "if(id % 3 = 0, null, 1.0D) as value"))
    for mode in ("frontier", "scan"):
        filled = fill.fill_missing(cells, mode, max_iterations=1, tile_bits=6)
        assert "BroadcastHashJoin" not in filled._jdf.queryExecution().toString()
        assert filled.filter("value = 1.0").count() == 40_000


def around(t):
    """Triangles from their smallest corner on."""
    return sorted(tuple(r[k:] + r[:k]) for r in map(list, t) for k in (r.index(min(r)),))


def test_large_polygons_are_triangulated_in_cells(spark, monkeypatch):
    """Cells give the triangles, vertices and edges that one task gives, on a lattice with a straight border and on a bare circle too."""
    comb = [(x + 0.0, y + 0.0) for k in range(30) for x, y in ((4 * k, 0), (4 * k + 1, 0), (4 * k + 1, 9), (4 * k + 3, 9), (4 * k + 3, 0))] + [(120.0, 0.0), (120.0, 30.0)]
    comb += [(120.0 - k, 30.0) for k in range(1, 121)]
    bare = [(np.cos(a), np.sin(a)) for a in np.arange(150) / 150 * 2 * np.pi]
    hole = [(20.0, 12.0), (20.0, 20.0), (60.0, 25.0), (60.0, 12.0)]
    rows = [(p, p + 5, role, k, *map(float, xy)) for p, role, ring in ((1, "exterior", comb), (2, "exterior", bare), (4, "exterior", hole)) for k, xy in enumerate(ring)]
    rows += [(1, 0, "hole", k, *xy) for k, xy in enumerate(hole)]
    rings = local_table(spark, rows, RINGS)

    def solved():
        v, t, e = triangulate.delaunay(rings, 1.0)
        tri = t.collect()
        assert len({(r.poly_id, r.tid) for r in tri}) == len(tri)
        middle = sorted((r.poly_id, round(r.x, 9), round(r.y, 9)) for r in tri)
        return sorted(v.collect()), [around((r.v0, r.v1, r.v2) for r in tri if r.poly_id == p) for p in (1, 2, 4)], middle, sorted(e.collect())

    whole = solved()
    assert all(whole[1])
    monkeypatch.setattr(triangulate, "DELAUNAY_POINTS", 130)
    monkeypatch.setattr(triangulate, "CELL_POINTS", 40)
    assert solved() == whole


def test_triangles_along_a_straight_border_are_not_turned():
    g = np.array([(i / 2, j / 2) for i in range(12) for j in range(250)])
    tri = triangulate._delaunay(g[:, 0].copy(), g[:, 1].copy())
    shift = np.random.default_rng(7).uniform(-1e-7, 1e-7, (len(g), 2)) * np.ptp(g[:, 1])
    a, b, c = ((g + shift)[tri[:, k]] for k in range(3))
    assert ((b - a)[:, 0] * (c - a)[:, 1] - (b - a)[:, 1] * (c - a)[:, 0] > 0).all()


def test_growing_sides_of_shared_steps_are_not_broadcast(spark, tmp_path):
    from catalog.fixtures import summed_heights

    spark.range(900).selectExpr("id as p_partkey", "cast(id % 50 as int) as p_size").write.parquet(str(tmp_path / "part.parquet"))
    summed = summed_heights(spark, str(tmp_path))
    assert "BroadcastHashJoin" not in summed._jdf.queryExecution().toString() and summed.count() == 900
    per_raster = spark.range(50).selectExpr("cast(id as string) as raster_id", "id as v")
    cells = spark.range(500).selectExpr("cast(id % 50 as string) as raster_id", "id as row")
    joined = attach(cells, per_raster, ["raster_id"], limit=10)
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().toString()
    assert joined.filter("v = row % 50").count() == 500
