"""Iso-lines of the height mask as directed segments.

Coordinates are doubled integers: cell (row, col) sits at x = 2*col, y = 2*row, the middle between
two cells at an odd coordinate. The high side lies to the left of every segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefgrid.operators.grid import join_levels
from reliefgrid.operators.tiles import TILE_BITS, TILE_KEY, blocks
from reliefgrid.runtime import local_table

# Crossed edges (start, end) per corner pattern; upper-left 1, upper-right 2,
# lower-left 4, lower-right 8; T, B, L, R are the middles of the block's sides.
SEGMENT_TABLE = {
    1: ("TL",), 2: ("RT",), 3: ("RL",), 4: ("LB",), 5: ("TB",), 6: ("RT", "LB"), 7: ("RB",),
    8: ("BR",), 9: ("TL", "BR"), 10: ("BT",), 11: ("BL",), 12: ("LR",), 13: ("TR",), 14: ("LT",),
}
SADDLES_JOINED = {6: ("LT", "RB"), 9: ("TR", "BL")}
SIDE_OFFSET = {"T": (1, 0), "L": (0, 1), "R": (2, 1), "B": (1, 2)}
# Each side's two corners, as pattern bits, and the corners' doubled offsets.
SIDE_CORNERS = {"T": (1, 2), "L": (1, 4), "R": (2, 8), "B": (4, 8)}
CORNER_OFFSET = {1: (0, 0), 2: (2, 0), 4: (0, 2), 8: (2, 2)}


def corner_case(threshold: Column) -> Column:
    """4-bit pattern of the corners at or above the threshold; missing corners count as below."""
    bits = [F.when(F.col(c) >= threshold, bit).otherwise(0) for c, bit in (("ul", 1), ("ur", 2), ("ll", 4), ("lr", 8))]
    return bits[0] + bits[1] + bits[2] + bits[3]


def level_keys(levels: DataFrame) -> DataFrame:
    """Only the columns that tell levels apart; a base height in a key would not group well."""
    return levels.select(*[c for c in ("raster_id", "level_idx", "threshold") if c in levels.columns])


def crossing() -> Column:
    """Does a block have corners on both sides of the threshold?"""
    threshold = F.col("threshold")
    corners = [F.col(c) for c in ("ul", "ur", "ll", "lr")]
    gap = corners[0].isNull() | corners[1].isNull() | corners[2].isNull() | corners[3].isNull()
    return (threshold <= F.greatest(*corners)) & (gap | (threshold > F.least(*corners)))


def _segment_rows(spark, saddles: str) -> DataFrame:
    table = dict(SEGMENT_TABLE)
    if saddles == "high":
        table.update(SADDLES_JOINED)
    rows = []
    for case, segments in table.items():
        for start, end in segments:
            high = [next(c for c in SIDE_CORNERS[s] if case & c) for s in (start, end)]
            low = next(c for c in SIDE_CORNERS[start] if not case & c)
            rows.append(
                (case, *SIDE_OFFSET[start], *SIDE_OFFSET[end], *CORNER_OFFSET[high[0]], *CORNER_OFFSET[high[1]],
                 *CORNER_OFFSET[low])
            )
    return local_table(
        spark,
        rows,
        "case int, ax int, ay int, bx int, by int, h1x int, h1y int, h2x int, h2y int, lx int, ly int",
    )


def contour_segments(
    cells: DataFrame,
    levels: DataFrame,
    saddles: str = "low",
    keep_frame: bool = True,
    tile_bits: int = TILE_BITS,
    detail: bool = False,
) -> DataFrame:
    """Directed boundary segments of ``value >= threshold`` for all levels at once.

    Blocks are formed once from the raw heights; each is then paired only with the levels that
    cross it, so the number of levels multiplies the contour, not the grid.
    ``saddles="low"`` separates diagonal high cells, ``"high"`` joins them. With
    ``keep_frame=False`` segments between a cell and the outside of the grid are left out.
    ``detail`` adds the tile and the bordering high and low cells (doubled coordinates).
    """
    b = blocks(cells, tile_bits)
    if not keep_frame:
        b = b.filter("inside = 4")
    hits = join_levels(b, level_keys(levels), crossing()).withColumn("case", corner_case(F.col("threshold")))
    table = F.broadcast(_segment_rows(cells.sparkSession, saddles))
    x, y = F.col("col") * 2, F.col("row") * 2
    out = hits.join(table, "case").select(
        *TILE_KEY,
        "level_idx",
        "threshold",
        *[(base + F.col(c)).alias(n) for base, c, n in (
            (x, "ax", "x1"), (y, "ay", "y1"), (x, "bx", "x2"), (y, "by", "y2"),
            (x, "h1x", "hx1"), (y, "h1y", "hy1"), (x, "h2x", "hx2"), (y, "h2y", "hy2"),
            (x, "lx", "lx"), (y, "ly", "ly"),
        )],
    )
    if detail:
        return out
    return out.select("raster_id", "level_idx", "threshold", "x1", "y1", "x2", "y2")


def contour_segments_interp(cells: DataFrame, levels: DataFrame, tile_bits: int = TILE_BITS) -> DataFrame:
    """Segments whose ends lie where the height, taken as linear along a side, meets the level.

    Only blocks with four present corners take part. Coordinates are plain x = col, y = row.
    """
    b = blocks(cells, tile_bits).filter("ul is not null and ur is not null and ll is not null and lr is not null")
    hits = join_levels(b, level_keys(levels), crossing()).withColumn("case", corner_case(F.col("threshold")))
    rows = [
        (case, n, start, end) for case, segs in SEGMENT_TABLE.items() for n, (start, end) in enumerate(segs)
    ]
    table = F.broadcast(local_table(cells.sparkSession, rows, "case int, n int, a string, b string"))
    t = F.col("threshold")

    def along(p: str, q: str) -> Column:
        return (t - F.col(p)) / (F.col(q) - F.col(p))

    def point(side: Column) -> tuple[Column, Column]:
        c, r = F.col("col").cast("double"), F.col("row").cast("double")
        px = F.when(side == "T", c + along("ul", "ur")).when(side == "B", c + along("ll", "lr")).when(
            side == "L", c).otherwise(c + 1.0)
        py = F.when(side == "L", r + along("ul", "ll")).when(side == "R", r + along("ur", "lr")).when(
            side == "T", r).otherwise(r + 1.0)
        return px, py

    x1, y1 = point(F.col("a"))
    x2, y2 = point(F.col("b"))
    return hits.join(table, "case").select(
        "raster_id", "level_idx", "threshold", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")
    )


def segment_measures(segments: DataFrame, by=("raster_id", "level_idx")) -> DataFrame:
    """Number of segments, enclosed area and outline length per group, exact on the lattice.

    Area is the shoelace sum; a segment is one cell side long or half a cell's diagonal, so lengths
    are counted, not added up, and the result does not depend on the order of rows.
    """
    cross = F.col("x1").cast("long") * F.col("y2") - F.col("x2").cast("long") * F.col("y1")
    diagonal = (F.col("x1") != F.col("x2")) & (F.col("y1") != F.col("y2"))
    return segments.groupBy(*by).agg(
        F.count("*").alias("segments"),
        (F.sum(cross) / 8.0).alias("area"),
        (F.count_if(~diagonal) + F.count_if(diagonal) * (0.5**0.5)).alias("perimeter"),
    )


def level_outline(cells: DataFrame, levels: DataFrame, tile_bits: int = TILE_BITS) -> DataFrame:
    """What area and outline length does each height level have?"""
    return segment_measures(contour_segments(cells, levels, tile_bits=tile_bits), ("raster_id", "level_idx", "threshold"))


def mask_runs(cells: DataFrame, levels: DataFrame, span: int = 4096) -> DataFrame:
    """Pieces of rows of consecutive high cells, cut at every ``span`` columns.

    The cut keeps each window within one row and one span, whatever the width of the raster.
    """
    from pyspark.sql import Window

    lv = level_keys(levels)
    high = join_levels(cells.filter("value is not null"), lv, F.col("value") >= F.col("threshold"))
    high = high.withColumn("_span", F.floor(F.col("col") / span).cast("int"))
    w = Window.partitionBy("raster_id", "level_idx", "row", "_span").orderBy("col")
    grouped = high.withColumn("_g", F.col("col") - F.row_number().over(w))
    return (
        grouped.groupBy("raster_id", "level_idx", "row", "_span", "_g")
        .agg(F.min("col").alias("col_from"), F.max("col").alias("col_to"), F.count("*").alias("cells"))
        .select("raster_id", "level_idx", "row", "col_from", "col_to", "cells")
    )
