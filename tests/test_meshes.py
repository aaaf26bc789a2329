import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import to_array
from reliefgrid.config import CleanupSettings, HeightmapSettings, ImageSettings, MeshSettings, TerrainSettings, TriangulationSettings
from reliefgrid.operators import cleanup, grid, inspect, mesh, triangulate
from reliefgrid.operators.mesh import Mesh
from reliefgrid.operators.polygons import polygon_measures
from reliefgrid.plans import pipelines
from reliefgrid.runtime import local_table
from reliefgrid.sources import images, mesh_files, npy, tables
from test_contours import SQUARE, noisy, poly


def build(spark, points, faces, mesh_id="m"):
    v = [(mesh_id, i, *map(float, p)) for i, p in enumerate(points)]
    t = [(mesh_id, i, *f) for i, f in enumerate(faces)]
    return Mesh(
        local_table(spark, v, "mesh_id string, vid long, x double, y double, z double"),
        local_table(spark, t, "mesh_id string, tid long, v0 long, v1 long, v2 long"),
    )


CUBE = [(x, y, z) for z in (0, 1) for y in (0, 1) for x in (0, 1)]
CUBE_FACES = [(0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4), (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5)]


def vertices(m):
    return np.array([(r["x"], r["y"], r["z"]) for r in m.vertices.orderBy("vid").collect()])


def test_surface_examples(make, spark):
    m = mesh.surface_mesh(make([[0, 1, 0], [1, 2, 1], [0, 1, 0]]))
    v = vertices(m)
    assert len(v) == 9 and m.triangles.count() == 8 and tuple(v[4]) == (1, 1, 2)
    m = mesh.surface_mesh(make([[1, 2], [3, 4]]), (2.0, 3.0, 0.5))
    assert [tuple(p) for p in vertices(m)] == [(0, 0, 0.5), (2, 0, 1), (0, 3, 1.5), (2, 3, 2)] and m.triangles.count() == 2
    m = mesh.surface_mesh(make([[5.0]]))
    assert m.triangles.isEmpty() and vertices(m)[0, 2] == 5.0
    a = np.ones((5, 5))
    a[2, 2] = np.nan
    with pytest.raises(ValueError):
        mesh.surface_mesh(make(a))


def test_surface_on_axes(make, spark):
    ax = [("r", "x", i, x) for i, x in enumerate(np.linspace(-2, 2, 3))] + [("r", "y", i, y) for i, y in enumerate(np.linspace(-1, 1, 2))]
    table = local_table(spark, [(a, b, c, float(d)) for a, b, c, d in ax], "raster_id string, axis string, idx int, coord double")
    v = vertices(mesh.surface_mesh(make(np.zeros((2, 3))), axes=table))
    assert [tuple(p[:2]) for p in v] == [(-2, -1), (0, -1), (2, -1), (-2, 1), (0, 1), (2, 1)]


def test_cube_and_triangle_info(spark):
    i = inspect.mesh_info(build(spark, CUBE, CUBE_FACES), fans=True).first()
    assert (i["num_vertices"], i["num_triangles"], i["is_watertight"], i["is_orientable"]) == (8, 12, True, True)
    assert i["bounding_box_min"] == [0, 0, 0] and i["bounding_box_max"] == [1, 1, 1] == i["bounding_box_extent"]
    assert inspect.mesh_volume(build(spark, CUBE, CUBE_FACES)).first()["volume"] == pytest.approx(1.0)
    one = build(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0)], [(0, 1, 2)])
    assert not inspect.mesh_info(one).first()["is_watertight"]
    with pytest.raises(ValueError, match="Cannot get info from empty mesh"):
        inspect.require_mesh(Mesh(one.vertices.limit(0), one.triangles.limit(0)))


def test_two_cubes_at_one_vertex_are_not_watertight(spark):
    other = [(x - 1, y - 1, z - 1) for x, y, z in CUBE]
    both = build(spark, CUBE + other, CUBE_FACES + [tuple(v + 8 for v in f) for f in CUBE_FACES])
    merged = cleanup.remove_duplicate_vertices(both)
    assert inspect.mesh_info(merged).first()["is_watertight"] and not inspect.mesh_info(merged, fans=True).first()["is_watertight"]


def test_normals_of_a_cube(spark):
    m = build(spark, CUBE, CUBE_FACES)
    n = mesh.triangle_normals(m).collect()
    assert all(abs(abs(r["nx"]) + abs(r["ny"]) + abs(r["nz"]) - 1) < 1e-12 for r in n)
    for r in mesh.vertex_normals(m).collect():
        d = np.array([r["x"], r["y"], r["z"]]) - 0.5
        assert np.dot(d, [r["nx"], r["ny"], r["nz"]]) > 0
    lone = Mesh(m.vertices, m.triangles.limit(0))
    assert {(r["nx"], r["ny"], r["nz"]) for r in mesh.vertex_normals(lone).collect()} == {(0.0, 0.0, 1.0)}


def test_grid_solid_is_closed_and_has_the_right_volume(make, spark):
    cells = make(noisy(3))
    levels = grid.levels_table(spark, [3, 6], 1.0, 0.5)
    m = mesh.grid_solid(cells, levels, 0.5, tile_bits=3)
    from reliefgrid.operators.contour import level_outline

    want = {f"r/{r['level_idx']}": r["area"] * 0.5 for r in level_outline(cells, levels).collect()}
    got = {r["mesh_id"]: r["volume"] for r in inspect.mesh_volume(m).collect()}
    assert got == pytest.approx(want)
    for r in inspect.mesh_info(m).collect():
        assert r["is_watertight"] and r["is_orientable"]
    z = {(r["mesh_id"], r["z"]) for r in m.vertices.select("mesh_id", "z").distinct().collect()}
    assert z == {("r/0", 1.0), ("r/0", 1.5), ("r/1", 1.5), ("r/1", 2.0)}
    mesh.check_faces(m)
    with pytest.raises(ValueError, match="Invalid face"):
        mesh.check_faces(Mesh(m.vertices.filter("z > 1.4"), m.triangles))


def test_exterior_walls_only(make, spark):
    a = np.ones((7, 7))
    a[3, 3] = 0
    lv = grid.levels_table(spark, [0.5])
    full, outer = (mesh.grid_solid(make(a), lv, 1.0, walls=w).triangles.count() for w in ("all", "exterior"))
    assert full - outer == 2 * 4


# ---- triangulation -----------------------------------------------------------------------------


def areas(cover):
    t = triangulate_area(cover)
    return {r["mesh_id"]: r["area"] for r in t.collect()}


def triangulate_area(cover):
    m = Mesh(cover.vertices.withColumn("z", F.lit(0.0)), cover.triangles)
    return mesh.triangle_normals(m).groupBy("mesh_id").agg(F.sum("area").alias("area"))


def test_delaunay_covers(spark):
    t = np.linspace(0, 2 * np.pi, 8, endpoint=False)
    big = [(0, 0), (4, 0), (4, 2), (0, 2)]
    r = poly(
        spark,
        (1, 1, "exterior", SQUARE), (1, 2, "hole", [(0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5)]),
        (2, 3, "exterior", [(0, 0), (1, 0), (0.5, 1)]),
        (3, 4, "exterior", list(zip(np.cos(t), np.sin(t)))),
        (4, 5, "exterior", [(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2)]),
        (5, 6, "exterior", big), (5, 7, "hole", [(0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5)]), (5, 8, "hole", [(2.5, 0.5), (3.5, 0.5), (3.5, 1.5), (2.5, 1.5)]),
    )
    want = {str(m["poly_id"]): m["area"] for m in polygon_measures(r).collect()}
    bare, _ = triangulate.triangulate_polygons(r, density=None)
    assert areas(bare) == pytest.approx(want)
    n = {x["mesh_id"]: x["count"] for x in bare.triangles.groupBy("mesh_id").count().collect()}
    assert n["2"] == 1 and n["3"] == 6 and n["1"] == 8
    filled, edges = triangulate.triangulate_polygons(r, density=1.0)
    got = areas(filled)
    # edges are not enforced: near the border single triangles may be missing
    assert set(got) == set(want) and all(0.8 < got[k] / want[k] < 1.02 for k in want), (got, want)
    per = triangulate.interior_points(r).groupBy("poly_id").count().collect()
    assert all(50 < x["count"] < 140 for x in per)
    assert edges.filter("a = b").isEmpty() and edges.count() == r.count()


def test_bad_polygons_are_refused(spark):
    with pytest.raises(ValueError, match="not valid"):
        triangulate.triangulate_polygons(poly(spark, (1, 1, "exterior", [(0, 0), (1, 1), (1, 0), (0, 1)])))
    with pytest.raises(ValueError):
        triangulate.triangulate_polygons(poly(spark, (1, 1, "exterior", [(0, 0), (1, 0), (2, 0), (3, 0)])), check_valid=False)


# ---- cleanup -----------------------------------------------------------------------------------


def test_merge_close_is_exact_and_transitive(spark):
    rng = np.random.default_rng(0)
    pts = np.round(rng.random((300, 3)) * 3, 3)
    pts = np.concatenate([pts, pts[:40]])
    m = build(spark, pts, [(0, 1, 2)])
    for eps in (0.15, 0.3):
        d = np.linalg.norm(pts[:, None] - pts[None], axis=2) <= eps
        label = np.arange(len(pts))
        while True:
            new = np.where(d, label[None], len(pts)).min(axis=1)
            if (new == label).all():
                break
            label = new
        want = sorted(tuple(np.round(pts[label == k].mean(axis=0), 6)) for k in np.unique(label))
        got = sorted((round(r["x"], 6), round(r["y"], 6), round(r["z"], 6)) for r in cleanup.merge_close_vertices(m, eps).vertices.collect())
        assert len(got) == len(want) and np.allclose(got, want, atol=2e-6)


def test_many_copies_of_one_place(spark):
    v = spark.range(3000).select(F.lit("m").alias("mesh_id"), F.col("id").alias("vid"), *[F.lit(1.0).alias(c) for c in "xyz"])
    out = cleanup.merge_close_vertices(Mesh(v, build(spark, CUBE, [(0, 1, 2)]).triangles), 0.5)
    assert out.vertices.count() == 1 and tuple(out.triangles.select("v0", "v1", "v2").first()) == (0, 0, 0)


def test_combine(spark):
    a, b = build(spark, CUBE, CUBE_FACES, "a"), build(spark, [(x + 1, y, z) for x, y, z in CUBE], CUBE_FACES, "b")
    m = cleanup.combine_meshes([a, b])
    assert m.vertices.count() == 12 and m.triangles.count() == 24
    with pytest.raises(ValueError, match="No meshes provided"):
        cleanup.combine_meshes([])
    empty = Mesh(a.vertices.limit(0), a.triangles.limit(0))
    assert cleanup.combine_meshes([empty, empty]).vertices.isEmpty()


def test_cleanup_is_idempotent(make, spark):
    m = mesh.grid_solid(make(noisy(5, 9, 9)), grid.levels_table(spark, [5]), 1.0)
    once = cleanup.quick_cleanup(m)
    twice = cleanup.quick_cleanup(once)
    assert sorted(map(tuple, once.triangles.collect())) == sorted(map(tuple, twice.triangles.collect()))


def test_reductions(make, spark):
    m = mesh.surface_mesh(make(np.fromfunction(lambda i, j: np.sin(i / 5) * 4, (30, 30))))
    small = cleanup.decimate_to(m, 300)
    assert 0 < small.triangles.count() <= 300
    mesh.check_faces(small)
    assert cleanup.cluster_vertices(m, 3.0).vertices.count() < 300
    with pytest.raises(ValueError):
        cleanup.clean_mesh(m, CleanupSettings(simplification="other"))


# ---- files -------------------------------------------------------------------------------------


def test_stl(spark, tmp_path):
    path = str(tmp_path / "deep" / "er" / "cube.stl")
    mesh_files.write_mesh(build(spark, CUBE, CUBE_FACES), path)
    data = open(path, "rb").read()
    n = struct.unpack("<I", data[80:84])[0]
    assert n == 12 and len(data) == 84 + 50 * 12
    rec = np.frombuffer(data[84:], dtype=[("f", "<f4", 12), ("a", "<u2")])["f"]
    tri = rec[:, 3:].reshape(-1, 3, 3).astype(float)
    volume = np.einsum("ij,ij->i", tri[:, 0], np.cross(tri[:, 1], tri[:, 2])).sum() / 6
    assert volume == pytest.approx(1.0)
    normal = np.cross(tri[:, 1] - tri[:, 0], tri[:, 2] - tri[:, 0])
    assert np.allclose(normal / np.linalg.norm(normal, axis=1)[:, None], rec[:, :3])
    assert mesh_files.stl_lines(build(spark, CUBE, CUBE_FACES)).count() == 84


def test_text_formats(spark, tmp_path):
    m = build(spark, CUBE, CUBE_FACES)
    for suffix, head, body in ((".obj", 0, 20), (".off", 2, 20), (".ply", 9, 20)):
        path = str(tmp_path / f"c{suffix}")
        mesh_files.write_mesh(m, path)
        lines = open(path).read().splitlines()
        assert len(lines) == head + body
        assert lines[head] in ("v 0.0 0.0 0.0", "0.0 0.0 0.0")
    assert open(str(tmp_path / "c.off")).readline() == "OFF\n"


def test_export_errors(spark, tmp_path):
    m = build(spark, CUBE, CUBE_FACES)
    with pytest.raises(ValueError, match="Unsupported"):
        mesh_files.write_mesh(m, str(tmp_path / "c.unsupported"))
    with pytest.raises(ValueError, match="Cannot export empty mesh"):
        mesh_files.write_mesh(Mesh(m.vertices.limit(0), m.triangles.limit(0)), str(tmp_path / "e.stl"))


def test_npy(make, spark, tmp_path):
    a = noisy(2)
    a[3, 4] = np.nan
    np.save(tmp_path / "grid.npy", a)
    cells = npy.read_npy(spark, str(tmp_path / "grid.npy"))
    assert np.array_equal(to_array(cells), a, equal_nan=True)
    npy.write_npy(cells.withColumn("raster_id", F.lit("copy")).filter("row <> 0 or col <> 0"), str(tmp_path / "out"))
    b = np.load(tmp_path / "out" / "copy.npy")
    a[0, 0] = np.nan
    assert np.array_equal(a, b, equal_nan=True)
    np.save(tmp_path / "flat.npy", np.arange(3.0))
    with pytest.raises(Exception, match="must be 2D"):
        npy.read_npy(spark, str(tmp_path / "flat.npy")).collect()


def test_stored_cells_window(make, spark, tmp_path):
    a = noisy(2)
    tables.write_cells(make(a), str(tmp_path / "c"))
    part = tables.read_cells(spark, str(tmp_path / "c"), (2, 3, 10, 9))
    assert part.count() == 8 * 6 and part.agg(F.sum("value")).first()[0] == a[3:9, 2:10].sum()
    assert "tile_r" in part._jdf.queryExecution().executedPlan().toString()


def write_png(path, a):
    h, w = a.shape[:2]
    kind = {2: 0, 3: 2, 4: 6}[2 if a.ndim == 2 else a.shape[2]]
    raw = b"".join(b"\0" + a[i].astype(np.uint8).tobytes() for i in range(h))

    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    head = struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images(spark, tmp_path):
    rng = np.random.default_rng(0)
    rgb, rgba, grey = rng.integers(0, 256, (7, 5, 3)), rng.integers(0, 256, (4, 6, 4)), rng.integers(0, 256, (3, 3))
    for name, a in (("rgb", rgb), ("rgba", rgba), ("grey", grey)):
        write_png(tmp_path / f"{name}.png", a)
    px = images.read_images(spark, str(tmp_path)).toPandas()
    for name, a in (("rgb", rgb), ("rgba", rgba), ("grey", grey)):
        g = px[px["image_id"].str.contains(f"/{name}.png")].sort_values(["row", "col"])
        want = np.repeat(a[..., None], 3, axis=2) if a.ndim == 2 else a[..., :3]
        assert np.array_equal(g[["r", "g", "b"]].to_numpy().reshape(want.shape), want)
    info = {os.path.basename(r["file_path"]): r for r in images.image_info(spark, str(tmp_path)).collect()}
    r = info["rgba.png"]
    assert (r["width"], r["height"], r["mode"], r["format"], r["has_transparency"], r["total_pixels"]) == (6, 4, "RGBA", "PNG", True, 24)
    assert info["grey.png"]["mode"] == "L" and not info["rgb.png"]["size_mismatch"]
    stripes = np.zeros((20, 30, 3), dtype=int)
    for i in range(3):
        stripes[:, 10 * i : 10 * i + 10, i] = 255
    write_png(tmp_path / "rgb.png", stripes)
    cfg = ImageSettings(color_map={"#ff0000": 1.0, "#00ff00": 2.0, "#0000ff": 3.0}, default_fuzziness=20.0)
    cells = pipelines.image_file_to_heightmap(spark, str(tmp_path / "rgb.png"), cfg, str(tmp_path / "heights"))
    assert (to_array(cells) == np.repeat([1, 2, 3], 10)).all()
    assert tables.read_cells(spark, str(tmp_path / "heights")).count() == 600


# ---- whole jobs --------------------------------------------------------------------------------


def test_mesh_types(make, spark, tmp_path):
    cells = make(noisy(7, 8, 9))
    assert set(vertices(pipelines.make_mesh(cells, "FLAT", height=2.5))[:, 2]) == {2.5}
    box = pipelines.make_mesh(cells, "extruded", base_height=1.0, thickness=2.0)
    i = inspect.mesh_info(box).first()
    assert i["is_watertight"] and (i["bounding_box_min"][2], i["bounding_box_max"][2]) == (1.0, 3.0)
    assert inspect.mesh_volume(box).first()["volume"] == pytest.approx(8 * 7 * 2)
    assert pipelines.make_mesh(cells, "contour").triangles.count() > 0
    path = str(tmp_path / "s.stl")
    pipelines.make_mesh(cells, "surface", save_path=path)
    assert os.path.getsize(path) == 84 + 50 * 7 * 8 * 2
    with pytest.raises(ValueError):
        pipelines.make_mesh(cells, "other")
    with pytest.raises(ValueError, match="threshold"):
        pipelines.make_mesh(cells, "flat", use_contours=True)
    with pytest.raises(ValueError, match="At least one threshold"):
        pipelines.multi_level_mesh(cells, [])
    assert pipelines.supported_mesh_types() == ["flat", "extruded", "surface", "contour"]


def test_stacked_mesh_with_units(make, spark):
    h = HeightmapSettings(thresholds=(2.0, 6.0), exterior_buffer_width=2, exterior_buffer_value=0.0, layer_thickness=0.5)
    m = pipelines.heightmap_to_mesh(make(noisy(7, 8, 9)), MeshSettings(heightmap=h))
    i = inspect.mesh_info(m).first()
    assert i["mesh_id"] == "r" and i["has_vertex_normals"] and i["bounding_box_extent"][2] == 1.0


def test_delaunay_and_compat_jobs(make, spark, tmp_path):
    a = np.zeros((16, 16))
    a[2:13, 2:13] = 5
    a[5:9, 5:9] = 0
    h = HeightmapSettings(thresholds=(3.0,), layer_thickness=0.5)
    cfg = MeshSettings(heightmap=h, triangulation=TriangulationSettings(method="delaunay"), stages_path=str(tmp_path / "st"))
    m = pipelines.heightmap_to_mesh(make(a), cfg)
    i = inspect.mesh_info(m).first()
    assert i["is_watertight"] and i["is_orientable"]
    assert inspect.mesh_volume(m).first()["volume"] == pytest.approx((121 - 0.5 - (16 + 0.5 - 1)) * 0.5, rel=0.02)
    assert os.path.isdir(tmp_path / "st" / "contours" / "level_idx=0")
    compat = pipelines.heightmap_to_mesh(make(a), MeshSettings(heightmap=h, mode="compat", triangulation=TriangulationSettings(method="delaunay")))
    assert inspect.mesh_info(compat).first()["bounding_box_extent"][2] == 1.0


def test_thresholds_from_data(make, spark):
    cells = make(noisy(1, 8, 9) - 5, "one").unionByName(make(noisy(2, 6, 7), "two"))
    m = pipelines.grid_to_mesh(cells, 3, MeshSettings(heightmap=HeightmapSettings(exterior_buffer_width=1, exterior_buffer_value=-1.0)))
    assert {r["mesh_id"] for r in inspect.mesh_info(m).collect()} == {"one", "two"}


def test_quick_run(spark, tmp_path):
    r = pipelines.quick_run(spark, terrain=TerrainSettings(size=12), output_path=str(tmp_path / "q.stl"))
    assert "Debug Workflow Results" in r.summary() and "(16, 16)" in r.summary()
    assert r.info.first()["num_vertices"] == 256 and os.path.exists(tmp_path / "q.stl")
    flat = pipelines.quick_run(spark, generator=lambda s: grid.synth_heightmap(s, TerrainSettings(size=5, add_zero_border=False)))
    assert flat.stats.first()["height"] == 5
    with pytest.raises(ValueError, match="Cannot provide both"):
        pipelines.quick_run(spark, pipelines.QuickSettings(), mesh_type="flat")
