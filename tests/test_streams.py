"""Streams give the rows of the batch, and nothing runs while their plans are built."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reliefgrid.operators import grid, pixels
from reliefgrid.operators.triangulate import interior_points, paired_crossings
from reliefgrid.runtime import local_table, salted_join
from reliefgrid.streaming import heights

RULES = [(0, "#ff0000", 1.0, 20.0), (1, "#00ff00", 2.0, 20.0), (2, "#fe0000", 9.0, 60.0)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Pixels of three images in several files."""
    path = str(tmp_path_factory.mktemp("stream") / "pixels")
    rng = np.random.default_rng(4)
    colours = [(255, 0, 0), (0, 255, 0), (0, 0, 255), (250, 20, 10)]
    rows = [
        (name, i, j, *colours[rng.integers(4)])
        for name, h, w in (("a", 6, 9), ("b", 5, 4), ("c", 1, 1)) for i in range(h) for j in range(w)
    ]
    local_table(spark, rows, "image_id string, row int, col int, r int, g int, b int").repartition(3).write.parquet(path)
    return path


def both(spark, folder, build, monkeypatch, tmp_path):
    """Rows of ``build`` on the stream and on the table, sorted."""
    batch = spark.read.parquet(folder)
    want = sorted(map(tuple, build(batch).collect()), key=repr)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    with monkeypatch.context() as m:
        for action in ("count", "collect", "first", "toPandas", "checkpoint", "isEmpty"):
            m.setattr(type(stream), action, lambda *a, **k: pytest.fail("an action while the plan is built"))
        out = build(stream)
    assert out.isStreaming
    query = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start(str(tmp_path / "out"))
    assert query.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*out.columns).collect()), key=repr)
    return got, want


def rules(spark):
    return pixels.prepare_rules(local_table(spark, RULES, "priority int, hex string, value double, fuzziness double"))


def levels(spark):
    return grid.levels_table(spark, [0.5, 1.5, 3.0])


@pytest.mark.parametrize("case", ["window", "share", "rules", "rules per image", "levels", "levels per raster"])
def test_stream_equals_batch(spark, folder, monkeypatch, tmp_path, case):
    sizes = local_table(spark, [("a", 6, 9), ("b", 5, 4)], "image_id string, height int, width int")
    table, marks = rules(spark), levels(spark)
    own = table.filter("priority <> 1").withColumn("image_id", F.lit("a")).unionByName(table.withColumn("image_id", F.lit("b")))
    per_raster = local_table(spark, [("a", 0, 1.5), ("b", 0, 0.5), ("b", 1, 3.0)], "raster_id string, level_idx int, threshold double")

    def cells(px):
        return heights.heights_from_pixels(px, table, 2.0, 1.0)

    build = {
        "window": lambda px: heights.window_of_pixels(px, (1, 2, 4, 5)),
        "share": lambda px: heights.window_of_pixels(px, (0.25, 0.0, 1.0, 0.5), sizes),
        "rules": cells,
        "rules per image": lambda px: heights.heights_from_pixels(px, own),
        "levels": lambda px: heights.masks_from_cells(cells(px), marks),
        "levels per raster": lambda px: heights.masks_from_cells(cells(px), per_raster),
    }[case]
    if case == "share":
        batch_only = spark.read.parquet(folder).filter("image_id <> 'c'")
        assert sorted(map(tuple, pixels.crop(batch_only, (0.25, 0.0, 1.0, 0.5)).collect())) == sorted(
            map(tuple, build(spark.read.parquet(folder)).collect())
        )
    got, want = both(spark, folder, build, monkeypatch, tmp_path)
    assert want and got == want


def test_shares_need_sizes(spark, folder):
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    with pytest.raises(ValueError, match="sizes"):
        pixels.crop(stream, (0.0, 0.0, 0.5, 0.5))


def test_join_without_keys_meets_all(spark, make):
    cells = make(np.arange(12.0).reshape(3, 4))
    many = local_table(spark, [(i, float(i)) for i in range(7)], "level_idx int, threshold double")
    assert salted_join(cells, many, []).count() == 84
    want = {tuple(r) for r in grid.join_levels(cells, many, F.col("value") >= F.col("threshold")).collect()}
    small, grid.bounded_rows = grid.bounded_rows, lambda df: None
    try:
        joined = grid.join_levels(cells, many, F.col("value") >= F.col("threshold"))
        plan = joined._jdf.queryExecution().toString()
        assert {tuple(r) for r in joined.collect()} == want and "Cartesian" not in plan and "NestedLoop" not in plan
    finally:
        grid.bounded_rows = small


def test_crossings_of_one_row_are_spread(spark):
    n = 20_000
    cuts = spark.range(2 * n).select(
        F.lit(7).alias("p"), F.lit(1).alias("j"), ((F.col("id") * 7919) % (2 * n)).cast("double").alias("cx"), F.lit(0.5).alias("s")
    )
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = cuts.repartitionByRange("p", "j", "cx").groupBy(F.spark_partition_id()).count().collect()
        spans = paired_crossings(cuts, ["p", "j"], ["s"])
        ends = spans.agg(F.count("*").alias("n"), F.countDistinct("a").alias("d"), F.max(F.abs(F.col("b") - F.col("a") - 1)).alias("off"), F.sum(F.col("a") % 2).alias("odd")).first()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(tasks) > 2 and max(t["count"] for t in tasks) < n
    assert tuple(ends) == (n, n, 0.0, 0.0)


def test_interior_points_of_a_comb(spark):
    teeth = 40
    outline = [(0.0, 0.0), (2.0 * teeth, 0.0), (2.0 * teeth, 1.0)]
    for t in reversed(range(teeth)):
        outline += [(2.0 * t + 1.5, 1.0), (2.0 * t + 1.0, 9.0), (2.0 * t + 0.5, 1.0)]
    outline.append((0.0, 1.0))
    rings = local_table(
        spark, [(1, 1, "exterior", k, x, y) for k, (x, y) in enumerate(outline)],
        "poly_id long, ring_id long, role string, seq int, x double, y double",
    )
    got = interior_points(rings, 20.0).collect()
    area = 2.0 * teeth + teeth * 0.5 * 1.0 * 8.0
    s = (area / 2000.0) ** 0.5

    def inside(x, y):
        if y < 1.0:
            return 0 < x < 2.0 * teeth and y > 0
        return abs((x % 2.0) - 1.0) < 0.5 * (9.0 - y) / 8.0

    want = {
        (i, j) for i in range(int(2 * teeth / s) + 2) for j in range(int(9 / s) + 2) if inside(s / 2 + i * s, s / 2 + j * s)
    }
    assert {(r.i, r.j) for r in got} == want and len(got) == len(want)
