"""Nothing is lost without a word, and nothing grows beyond its input."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from reliefgrid.operators import cleanup, mesh, pixels, polygons, simplify
from reliefgrid.operators.inspect import vertex_fans
from reliefgrid.operators.mesh import Mesh, surface_mesh
from reliefgrid.runtime import cut, local_table
from reliefgrid.sources import images, npy

RINGS = "poly_id long, ring_id long, role string, seq int, x double, y double"


def square(poly, ring, role, lo, hi):
    return [(poly, ring, role, k, x, y) for k, (x, y) in enumerate([(lo, lo), (hi, lo), (hi, hi), (lo, hi)])]


def test_unreadable_image_fails_by_name(spark, tmp_path):
    (tmp_path / "bad.png").write_bytes(b"\x89PNG\r\n\x1a\nnothing")
    with pytest.raises(Exception, match="cannot read image .*bad.png"):
        images.read_images(spark, str(tmp_path)).count()


def test_npy_keeps_ids_that_are_no_file_names(make, spark, tmp_path):
    name = "file:/a b/c%d.bmp"
    npy.write_npy(make(np.arange(6.0).reshape(2, 3), name), str(tmp_path))
    back = npy.read_npy(spark, str(tmp_path)).collect()
    assert {r.raster_id for r in back} == {name} and sorted(r.value for r in back) == [0, 1, 2, 3, 4, 5]


def test_simplify_once_keeps_rings(spark):
    diamond = [(1, 1, "exterior", k, x, y) for k, (x, y) in enumerate([(0.0, 0.5), (0.5, 0.0), (1.0, 0.5), (0.5, 1.0)])]
    big = square(2, 2, "exterior", 0.0, 10.0)
    got = simplify.simplify_once(local_table(spark, diamond + big, RINGS), 5.0).groupBy("poly_id").count().collect()
    assert {r.poly_id: r["count"] for r in got} == {1: 3, 2: 4}
    flat = simplify.simplify_once(local_table(spark, diamond, RINGS), 0.6).orderBy("seq").collect()
    assert len(flat) == 3 and [r.seq for r in flat] == [0, 1, 2]


def test_flat_picture_cannot_shrink_to_nothing(spark):
    px = spark.range(100).select(F.lit("i").alias("image_id"), F.lit(0).alias("row"), F.col("id").cast("int").alias("col"), *[F.lit(1).alias(c) for c in "rgb"])
    with pytest.raises(Exception, match="shrink to 0 pixels"):
        pixels.resample(px, 10).count()


def test_picture_of_no_columns_has_no_rows(spark, tmp_path):
    from catalog import load_all

    query = load_all()["resample_pixels"]
    for name, last, step in (("narrow", 620_000, 17), ("wide", 7_000, 1)):
        keys = spark.range(0, last, step).select(F.col("id").alias("o_orderkey"))
        keys.coalesce(1).write.parquet(str(tmp_path / name / "orders.parquet"))
        con = duckdb.connect()
        con.execute(f"create view orders as select * from '{tmp_path}/{name}/orders.parquet/*.parquet'")
        want = con.execute(query.sql).fetchall()
        got = [(r.image_id, r.row, r.col, r.r, r.g, r.b) for r in query.build(spark, str(tmp_path / name)).collect()]
        assert sorted(got) == sorted(want) and bool(got) == (name == "wide")


def test_vanished_pictures_leave_the_others(spark):
    px = spark.range(100).select(F.expr("if(id < 20, 'small', 'flat')").alias("image_id"), F.lit(0).alias("row"), F.expr("cast(if(id < 20, id % 5, id) as int)").alias("col"), *[F.lit(1).alias(c) for c in "rgb"])
    px = px.withColumn("row", F.expr("if(image_id = 'small', col div 2, row)").cast("int"))
    left = pixels.resample(px, 10, vanished="empty")
    assert [r.image_id for r in left.select("image_id").distinct().collect()] == ["small"] and left.count() == 20
    with pytest.raises(ValueError, match="vanished"):
        pixels.resample(px, 10, vanished="other")


def test_many_shared_rules_go_in_parts(spark, monkeypatch):
    monkeypatch.setattr(pixels, "SMALL_TABLE_ROWS", 4)
    codes = [f"#{v:02x}0000" for v in range(0, 250, 20)]
    rules = pixels.prepare_rules(local_table(spark, [(k, c, float(k), None) for k, c in enumerate(codes)], "priority int, hex string, value double, fuzziness double"), 3.0)
    px = local_table(spark, [("i", 0, v, v * 20, 0, 0) for v in range(len(codes))] + [("i", 1, 0, 0, 255, 0)], "image_id string, row int, col int, r int, g int, b int")
    got = {(r.row, r.col): r.value for r in pixels.match_rules(px, rules).collect()}
    want = {(r.row, r.col): r.value for r in pixels.match_rules(px, pixels.compile_rules({c: k for k, c in enumerate(codes)}, 3.0)).collect()}
    assert got == want and got[(1, 0)] is None and got[(0, 5)] is not None


def test_dominant_colors_of_a_sample(spark):
    px = spark.range(1000).select(F.lit("i").alias("image_id"), F.lit(0).alias("row"), F.col("id").cast("int").alias("col"), F.when(F.col("id") % 4 == 0, 200).otherwise(10).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"))
    coarse = pixels.dominant_colors(px, 2, 0.5, clustered=False).collect()
    assert [r.hex for r in coarse] == ["#000000", "#c00000"] and sum(r.pixels for r in coarse) == 500
    assert {r.hex for r in pixels.dominant_colors(px, 2, 0.5).collect()} == {"#0a0000", "#c80000"}


def test_hole_beyond_its_exterior_leaves_nothing(spark):
    rings = local_table(spark, square(1, 1, "exterior", 0.0, 8.0) + square(1, 2, "hole", 0.0, 9.0) + square(2, 3, "exterior", 0.0, 8.0) + square(2, 4, "hole", 0.0, 4.0), RINGS)
    points = local_table(spark, [(p, v, v) for p in (1, 2) for v in (1.0, 5.0, 8.5)], "poly_id long, x double, y double")
    assert [tuple(r) for r in polygons.point_in_polygon(points, rings).collect()] == [(2, 5.0, 5.0)]


def grid_mesh(spark, name, n, step):
    v = [(name, i * (n + 1) + j, j * step, i * step, float((i * j) % 3) * step) for i in range(n + 1) for j in range(n + 1)]
    t = []
    for i in range(n):
        for j in range(n):
            a = i * (n + 1) + j
            t += [(name, len(t), a, a + 1, a + n + 2), (name, len(t) + 1, a, a + n + 2, a + n + 1)]
    return v, t


def test_meshes_are_reduced_each_on_its_own(spark):
    parts = [grid_mesh(spark, "a", 12, 1.0), grid_mesh(spark, "b", 12, 0.01), grid_mesh(spark, "small", 3, 1.0)]
    v = local_table(spark, [r for p in parts for r in p[0]], "mesh_id string, vid long, x double, y double, z double")
    t = local_table(spark, [r for p in parts for r in p[1]], "mesh_id string, tid long, v0 long, v1 long, v2 long")
    out = cleanup.decimate_to(Mesh(v, t), 100)
    n = {r.mesh_id: r["count"] for r in out.triangles.groupBy("mesh_id").count().collect()}
    assert n["small"] == 18 and 30 < n["a"] <= 100 and 30 < n["b"] <= 100


def test_lonely_vertices_enter_no_pair_search(spark):
    v, t = grid_mesh(spark, "a", 10, 1.0)
    frame = local_table(spark, v + [("a", 1000, 3.0 + 5e-7, 3.0, 0.0)], "mesh_id string, vid long, x double, y double, z double")
    near = cleanup.with_company(frame, 1e-6).collect()
    assert sorted(r.vid for r in near) == [36, 1000]
    plan = mesh.Mesh(frame, local_table(spark, t, "mesh_id string, tid long, v0 long, v1 long, v2 long"))
    assert cleanup.merge_close_vertices(plan).vertices.count() == 121


def test_large_sides_are_not_broadcast(spark, tmp_path, capsys):
    # a compressed file of regular rows looks small, and the corners of its faces are many more
    path = str(tmp_path / "cells")
    spark.range(900).select(F.lit("m").alias("raster_id"), F.expr("int(id div 30)").alias("row"), F.expr("int(id % 30)").alias("col"), F.lit(1.0).alias("value")).write.parquet(path)
    fans = vertex_fans(surface_mesh(spark.read.parquet(path), validate=False))
    assert fans.filter("fans = 1").count() == 900
    capsys.readouterr()
    fans.explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "BroadcastHashJoin [mesh_id" not in plan


def test_a_cut_forgets_the_estimate_of_its_plan(spark, capsys):
    a = spark.range(50).withColumn("v", F.col("id"))
    for _ in range(4):
        a = cut(a.join(a.withColumnRenamed("v", "w"), "id").select("id", F.col("w").alias("v")))
    a.explain(mode="cost")
    told = re.findall(r"sizeInBytes=([0-9.]+) (\w+)", capsys.readouterr().out)
    assert told and all(unit in ("B", "KiB") for _, unit in told)
    assert a.count() == 50
