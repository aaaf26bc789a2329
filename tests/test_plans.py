"""Plans that must not get worse: exchanges, pushed filters, no products of large sides."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reliefgrid.operators import contour, grid, mesh
from reliefgrid.operators.pixels import compile_rules, map_colors
from reliefgrid.sources import tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, make, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "cells")
    tables.write_cells(make(np.arange(100.0).reshape(10, 10)), path)
    return path


def test_outline_shuffles_cells_once(spark, stored):
    p = plan(contour.level_outline(tables.read_cells(spark, stored), grid.levels_table(spark, [5.0, 50.0])))
    # cells by tile, then one row per level and task
    assert p.count("Exchange hashpartitioning") == 2
    assert p.count("REPARTITION_BY_COL") == 1 and "CartesianProduct" not in p and "SortMergeJoin" not in p


def test_constant_raster_id_keeps_the_tile_exchange(spark):
    cells = spark.range(100).select(
        F.lit("a").alias("raster_id"), (F.col("id") / 10).cast("int").alias("row"), (F.col("id") % 10).cast("int").alias("col"),
        F.col("id").cast("double").alias("value"),
    )
    p = plan(contour.level_outline(cells, grid.levels_table(spark, [5.0])))
    assert p.count("Exchange hashpartitioning") == 2


def test_colour_mapping_has_no_shuffle(spark):
    px = spark.range(10).select(F.lit("i").alias("image_id"), *[F.col("id").cast("int").alias(c) for c in ("row", "col", "r", "g", "b")])
    p = plan(map_colors(px, compile_rules({"#0000ff": 1.0, "#00ff00": 2.0})))
    assert "Exchange" not in p and "Python" not in p


def test_grid_triangles_stay_in_the_jvm(spark, stored):
    p = plan(mesh.triangulate_grid(tables.read_cells(spark, stored), grid.levels_table(spark, [5.0])))
    assert "Python" not in p and p.count("Exchange hashpartitioning") == 1


def test_window_reaches_the_scan(spark, stored):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    p = plan(tables.read_cells(spark, stored, (2, 3, 10, 9)))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PartitionFilters: [isnotnull(tile_r" in p and "GreaterThanOrEqual(row,3)" in p
    assert "ReadSchema: struct<raster_id:string,row:int,col:int,value:double,tile_c:int>" in p


def test_one_raster_reads_one_folder(spark, stored):
    one = tables.read_cells(spark, stored, raster_id="r")
    assert one.count() == 100 and tables.read_cells(spark, stored, raster_id="s").count() == 0
    assert "PartitionFilters: [isnotnull(folder" in plan(one)


def test_rules_are_literals_in_the_plan(spark):
    """Twenty rules: a plan that grows by a few numbers per rule, built at once."""
    import time

    px = spark.range(10).select(F.lit("i").alias("image_id"), *[F.col("id").cast("int").alias(c) for c in ("row", "col", "r", "g", "b")])
    sizes = []
    for n in (5, 20):
        t = time.perf_counter()
        p = map_colors(px, compile_rules({f"#{k:02x}{7 * k:02x}30": float(k) for k in range(n)}))._jdf.queryExecution().optimizedPlan().toString()
        sizes.append(len(p))
        assert time.perf_counter() - t < 10
    assert sizes[1] - sizes[0] < 15 * 600, sizes
