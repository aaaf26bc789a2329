"""Operators on ``cells(raster_id, row, col, value)``; a missing height is NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefgrid.runtime import SALTS, attach, bounded_rows, local_table, salted_join

#: Border cells generated per row of the intermediate chunk table.
BORDER_CHUNK = 65_536


def to_cells(
    df: DataFrame,
    row: str | Column,
    col: str | Column,
    value: str | Column,
    raster_id: str | Column | None = None,
) -> DataFrame:
    """Any table with a row, a column and a height becomes cells; NaN turns into NULL."""

    def c(x):
        return F.col(x) if isinstance(x, str) else x

    v = c(value).cast("double")
    return df.select(
        (F.lit("raster") if raster_id is None else c(raster_id).cast("string")).alias("raster_id"),
        c(row).cast("int").alias("row"),
        c(col).cast("int").alias("col"),
        F.when(~F.isnan(v), v).alias("value"),
    )


def raster_meta(cells: DataFrame) -> DataFrame:
    """Height and width per raster."""
    return cells.groupBy("raster_id").agg(
        (F.max("row") + 1).cast("int").alias("height"), (F.max("col") + 1).cast("int").alias("width")
    )


def grid_stats(cells: DataFrame) -> DataFrame:
    """Extremes, mean, spread, shape and count of present cells per raster."""
    return cells.groupBy("raster_id").agg(
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        (F.max("value") - F.min("value")).alias("range"),
        (F.max("row") + 1).cast("int").alias("height"),
        (F.max("col") + 1).cast("int").alias("width"),
        F.count("value").alias("present"),
        F.count("*").alias("cells"),
    )


def grid_summary(cells: DataFrame) -> DataFrame:
    """Smallest and largest height and number of present cells per raster."""
    return cells.groupBy("raster_id").agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("present")
    )


def grid_problems(cells: DataFrame) -> DataFrame:
    """Per raster: cells, positions, missing, infinite and repeated cells, expected cells, verdict.

    Repeats are found by counting cells per position first, so partial counts are formed before
    the shuffle and a raster of any size stays spread out.
    """
    v = F.col("value")
    per_position = cells.groupBy("raster_id", "row", "col").agg(
        F.count("*").alias("n"),
        F.count_if(v.isNull() | F.isnan(v)).alias("missing"),
        F.count_if(F.abs(v) == float("inf")).alias("infinite"),
    )
    out = per_position.groupBy("raster_id").agg(
        F.sum("n").alias("cells"),
        F.count("*").alias("positions"),
        F.sum("missing").alias("missing"),
        F.sum("infinite").alias("infinite"),
        F.count_if(F.col("n") > 1).alias("repeated"),
        ((F.max("row") + 1).cast("long") * (F.max("col") + 1)).alias("expected"),
    )
    return out.withColumn(
        "verdict",
        F.when(F.col("missing") + F.col("infinite") > 0, "non-finite")
        .when((F.col("repeated") > 0) | (F.col("positions") != F.col("expected")), "must be 2D")
        .otherwise("ok"),
    )


def validate_cells(cells: DataFrame) -> DataFrame:
    """Return ``cells``; raise if empty, not a full 2-D grid, or holding non-finite heights."""
    require_2d(cells)
    bad = grid_problems(cells).filter("verdict <> 'ok'").select("verdict").limit(1).collect()
    if bad:
        text = {"non-finite": "Heightmap contains non-finite values", "must be 2D": "Heightmap must be 2D"}
        raise ValueError(text[bad[0]["verdict"]])
    if cells.isEmpty():
        raise ValueError("Heightmap is empty")
    return cells


def require_2d(cells: DataFrame) -> DataFrame:
    """Reject tables without both a row and a column."""
    if not {"row", "col", "value"} <= set(cells.columns):
        raise ValueError(f"Heightmap must be 2D, got columns {cells.columns}")
    return cells


def normalize_cells(cells: DataFrame, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Min-max scaling per raster; a constant raster becomes the middle of the range."""
    if lo >= hi:
        raise ValueError("Invalid target range: minimum must be below maximum")
    stats = cells.groupBy("raster_id").agg(F.min("value").alias("_min"), F.max("value").alias("_max"))
    v, a, b = F.col("value"), F.col("_min"), F.col("_max")
    scaled = F.when(v.isNull(), None).when(a == b, (lo + hi) / 2).otherwise(
        F.lit(lo) + (v - a) / (b - a) * (hi - lo)
    )
    return attach(cells, stats, ["raster_id"]).withColumn("value", scaled).select(*cells.columns)


def scale_offset(cells: DataFrame, scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    return cells.withColumn("value", F.col("value") * scale + offset)


def auto_offset(cells: DataFrame, factor: float = -1.1) -> DataFrame:
    """Offset per raster that lifts the lowest height: minimum times ``factor``."""
    return cells.groupBy("raster_id").agg((F.min("value") * factor).alias("offset"))


def apply_offsets(cells: DataFrame, offsets: DataFrame, scale: float = 1.0) -> DataFrame:
    """Scale all heights and add each raster's own offset."""
    return (
        attach(cells, offsets.select("raster_id", "offset"), ["raster_id"])
        .withColumn("value", F.col("value") * scale + F.col("offset"))
        .select(*cells.columns)
    )


def fill_constant(cells: DataFrame, value: float = 0.0) -> DataFrame:
    return cells.withColumn("value", F.coalesce("value", F.lit(float(value))))


def pad(cells: DataFrame, width: int, value: float | None = 0.0, meta: DataFrame | None = None) -> DataFrame:
    """A constant border on all four sides; row and column numbers move by ``width``.

    Border cells are generated from the raster sizes in two steps, so the border of a very large
    raster is produced by many tasks.
    """
    if width <= 0:
        return cells
    meta = raster_meta(cells) if meta is None else meta
    w = F.lit(width).cast("long")
    band = (F.col("width") + 2 * width) * w  # cells of the top band
    side = F.col("height") * w
    total = band * 2 + side * 2
    chunks = meta.select(
        "raster_id", "height", "width",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((total - 1) / BORDER_CHUNK))).alias("chunk"),
    ).repartition("raster_id", "chunk")
    first = F.col("chunk") * BORDER_CHUNK
    last = F.least(first + BORDER_CHUNK, total) - 1
    i = F.col("i")
    full = F.col("width") + 2 * width

    def split(n: Column, per_row: Column):
        return F.floor(n / per_row), F.pmod(n, per_row)

    tr, tc = split(i, full)
    br, bc = split(i - band, full)
    lr, lc = split(i - band * 2, w)
    rr, rc = split(i - band * 2 - side, w)
    zone = F.when(i < band, 0).when(i < band * 2, 1).when(i < band * 2 + side, 2).otherwise(3)
    border = chunks.withColumn("i", F.explode(F.sequence(first, last))).withColumn("_z", zone)
    z = F.col("_z")
    border = border.select(
        "raster_id",
        F.when(z == 0, tr).when(z == 1, br + F.col("height") + width).when(z == 2, lr + width)
        .otherwise(rr + width).cast("int").alias("row"),
        F.when(z == 0, tc).when(z == 1, bc).when(z == 2, lc)
        .otherwise(rc + F.col("width") + width).cast("int").alias("col"),
        F.lit(value).cast("double").alias("value"),
    )
    moved = cells.select(
        "raster_id",
        (F.col("row") + width).cast("int").alias("row"),
        (F.col("col") + width).cast("int").alias("col"),
        "value",
    )
    return moved.unionByName(border)


def complete_cells(cells: DataFrame, meta: DataFrame) -> DataFrame:
    """Every position of each raster once; positions without a row become missing cells."""
    chunked = meta.withColumn(
        "_band", F.explode(F.sequence(F.lit(0), F.floor((F.col("height") - 1) / 64).cast("int")))
    ).repartition("raster_id", "_band")
    rows = F.sequence(F.col("_band") * 64, F.least(F.col("_band") * 64 + 63, F.col("height") - 1))
    full = (
        chunked.withColumn("row", F.explode(rows))
        .withColumn("col", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
        .select("raster_id", "row", "col")
    )
    return full.join(cells, ["raster_id", "row", "col"], "left").select("raster_id", "row", "col", "value")


# ---- height levels -------------------------------------------------------------------------


def levels_linspace(a: float, b: float, n: int) -> list[float]:
    """``n`` evenly spaced thresholds from ``a`` to ``b``."""
    if n == 1:
        return [float(a)]
    return [a + (b - a) * i / (n - 1) for i in range(n)]


def levels_linspace_by(bounds: DataFrame, n: int) -> DataFrame:
    """The same per raster, from a table with ``raster_id``, ``lo`` and ``hi``."""
    i = F.col("level_idx")
    step = F.lit(0.0) if n == 1 else (F.col("hi") - F.col("lo")) * i / (n - 1)
    return bounds.withColumn("level_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(
        "raster_id", "level_idx", (F.col("lo") + step).alias("threshold")
    )


def level_heights(
    levels: DataFrame, base: float = 0.0, thickness: float = 0.5, spacing: float | None = None
) -> DataFrame:
    """Base height of each level: stacked by thickness, or by ``spacing`` if given."""
    step = thickness if spacing is None else spacing
    return levels.withColumn("base_z", F.lit(float(base)) + F.col("level_idx") * F.lit(float(step)))


def levels_table(
    spark: SparkSession,
    thresholds: Sequence[float],
    base: float = 0.0,
    thickness: float = 0.5,
    spacing: float | None = None,
) -> DataFrame:
    """Threshold list -> ``levels(level_idx, threshold, base_z)``."""
    if not thresholds:
        raise ValueError("At least one threshold is required")
    rows = [(i, float(t)) for i, t in enumerate(thresholds)]
    return level_heights(local_table(spark, rows, "level_idx int, threshold double"), base, thickness, spacing)


def join_levels(df: DataFrame, levels: DataFrame, condition: Column) -> DataFrame:
    """Pair each row of ``df`` (alias columns as is) with the levels that satisfy ``condition``.

    ``levels`` common to all rasters is a short list: its size is checked and it is broadcast. A longer one,
    or that of a stream, is repeated in as many tasks as a shuffle has.
    Levels per raster are joined on ``raster_id``. ``condition`` may use ``threshold``.
    """
    if "raster_id" in levels.columns:
        return attach(df, levels, ["raster_id"]).filter(condition)
    rows = None if df.isStreaming else bounded_rows(levels)
    if rows is None:
        salts = max(SALTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        return salted_join(df, levels, [], salts=salts).filter(condition)
    small = F.broadcast(local_table(df.sparkSession, rows, levels.schema))
    return df.join(small, condition)


def threshold_mask(cells: DataFrame, levels: DataFrame) -> DataFrame:
    """One row per cell and level with ``mask`` = height at or above the threshold."""
    joined = join_levels(cells, levels.select(*[c for c in ("raster_id", "level_idx", "threshold") if c in levels.columns]), F.lit(True))
    return joined.select(
        "raster_id", "level_idx", "row", "col",
        F.coalesce(F.col("value") >= F.col("threshold"), F.lit(False)).alias("mask"),
    )


# ---- generated terrain ---------------------------------------------------------------------


def synth_heightmap(spark: SparkSession, config=None, raster_id: str = "terrain") -> DataFrame:
    """Test terrain: a broad central peak, a narrow second peak, a wave and optional noise."""
    from reliefgrid.config import TerrainSettings

    cfg = config or TerrainSettings()
    n = cfg.size
    (xa, xb), (ya, yb) = cfg.x_range, cfg.y_range
    last = max(n - 1, 1)
    base = spark.range(n * n).select(
        F.lit(raster_id).alias("raster_id"),
        F.floor(F.col("id") / n).cast("int").alias("row"),
        F.pmod(F.col("id"), F.lit(n)).cast("int").alias("col"),
    )
    x = F.lit(xa) + F.col("col") * ((xb - xa) / last)
    y = F.lit(ya) + F.col("row") * ((yb - ya) / last)
    height = (
        F.lit(cfg.central_peak) * F.exp(-(x * x + y * y) * 2.0)
        + F.lit(cfg.secondary_peak)
        * F.exp(-((x - 0.5) * (x - 0.5) + (y - 0.5) * (y - 0.5)) * 10.0)
        + F.lit(cfg.wave_pattern) * F.sin(x * 4.0) * F.cos(y * 4.0) * 0.1
    )
    if cfg.noise_level:
        # noise from the position, so a recomputed partition repeats it
        unit = F.pmod(F.xxhash64("row", "col", F.lit(cfg.seed)), F.lit(1 << 20)) / float(1 << 20)
        height = height + F.lit(cfg.noise_level) * unit
    cells = base.withColumn("value", height)
    if cfg.add_zero_border:
        meta = local_table(spark, [(raster_id, n, n)], "raster_id string, height int, width int")
        cells = pad(cells, cfg.border_width, 0.0, meta)
    return cells


def from_generator(spark: SparkSession, fn) -> DataFrame:
    """Cells from a caller's function ``SparkSession -> DataFrame``."""
    return require_2d(fn(spark))
