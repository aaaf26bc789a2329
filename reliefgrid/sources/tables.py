"""Cells in tiled Parquet, the hand-off between the stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefgrid.operators.grid import to_cells

#: Rows and columns per storage tile: 2**9 = 512.
STORE_BITS = 9
#: Folders that the rasters of a store are dealt to.
STORE_FOLDERS = 64


def folder_of(raster_id: Column) -> Column:
    return F.pmod(F.xxhash64(raster_id), F.lit(STORE_FOLDERS)).cast("int")


def write_cells(cells: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet partitioned by a hash of the raster and by tile row; ``tile_c`` is kept for file skipping.

    The raster's id is a data column, so it comes back as it is, whatever it looks like. Each tile row
    is spread over its tile columns, so a wide raster is written by many tasks.
    """
    (
        cells.withColumn("tile_r", F.shiftright("row", STORE_BITS))
        .withColumn("tile_c", F.shiftright("col", STORE_BITS))
        .withColumn("folder", folder_of(F.col("raster_id")))
        .repartition("folder", "tile_r", "raster_id", "tile_c")
        .sortWithinPartitions("folder", "tile_r", "raster_id", "tile_c", "row", "col")
        .write.mode(mode)
        .partitionBy("folder", "tile_r")
        .parquet(path)
    )


def read_cells(
    spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None, raster_id: str | None = None
) -> DataFrame:
    """Cells from ``write_cells``; ``window`` (x0, y0, x1, y1 in pixels) and ``raster_id`` prune while reading."""
    df = spark.read.parquet(path)
    if raster_id is not None:
        df = df.filter((F.col("folder") == folder_of(F.lit(raster_id))) & (F.col("raster_id") == raster_id))
    if window is not None:
        x0, y0, x1, y1 = window
        df = df.filter(
            F.col("tile_r").between(y0 >> STORE_BITS, (y1 - 1) >> STORE_BITS)
            & F.col("tile_c").between(x0 >> STORE_BITS, (x1 - 1) >> STORE_BITS)
            & (F.col("row") >= y0) & (F.col("row") < y1) & (F.col("col") >= x0) & (F.col("col") < x1)
        )
    return df.select("raster_id", "row", "col", "value")
