"""Tiles: how a grid is spread over tasks.

Neighbourhood work needs cells that touch to meet in one task. Cells are keyed by square tiles and
the cells within reach of a tile's edge are repeated in the tiles beyond it, so one exchange on the
tile key is enough and no group ever exceeds one tile, however large a raster or how long a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A tile is 2**TILE_BITS cells wide and high.
TILE_BITS = 8
#: ``tile`` is a hash of the other three: rows are placed by it, and it stays a plain column even
#: where the raster id is a constant the optimizer would fold away.
TILE_KEY = ["tile", "raster_id", "tile_r", "tile_c"]


def tile_of(index: Column, bits: int = TILE_BITS) -> Column:
    return F.shiftright(index, bits)


def tiled(
    cells: DataFrame, before: int, after: int, bits: int = TILE_BITS, skew: int = 0, skew_reach: int = 0
) -> DataFrame:
    """Repeat each cell in every tile that reaches it and place tiles together.

    A tile sees ``before`` cells above/left of itself and ``after`` cells below/right of itself.
    With ``skew`` the tiles are slanted: columns are counted as ``col + skew * row``, and a tile sees
    ``skew_reach`` more of them on both sides.
    """

    def tiles(index: Column, extra: int) -> Column:
        return F.sequence(tile_of(index - (after + extra), bits), tile_of(index + (before + extra), bits))

    column = F.col("col") + F.col("row") * skew if skew else F.col("col")
    return (
        cells.withColumn("tile_r", F.explode(tiles(F.col("row"), 0)))
        .withColumn("tile_c", F.explode(tiles(column, skew_reach)))
        .withColumn("tile", F.xxhash64("raster_id", "tile_r", "tile_c"))
        .repartition("tile")
    )


def blocks(cells: DataFrame, bits: int = TILE_BITS) -> DataFrame:
    """All 2x2 neighbourhoods, including those that overlap the frame by one cell.

    ``row``/``col`` name the upper-left cell (from -1); ``ul, ur, ll, lr`` are heights, NULL where
    missing or outside, and ``inside`` counts the positions that exist. One exchange by tile; the
    grouping by block runs within it, because the tile key is part of the block key.
    """
    # block (r, c) belongs to the tile of cell (r + 1, c + 1): a tile needs one cell above/left
    placed = tiled(cells, before=1, after=0, bits=bits)
    dr, dc = F.col("_d")["dr"], F.col("_d")["dc"]
    offsets = F.array(
        *[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r in (0, 1) for c in (0, 1)]
    )
    spread = placed.withColumn("_d", F.explode(offsets)).select(
        *TILE_KEY,
        (F.col("row") - dr).alias("row"),
        (F.col("col") - dc).alias("col"),
        (dr * 2 + dc).alias("_slot"),
        "value",
    )
    spread = spread.filter(
        (tile_of(F.col("row") + 1, bits) == F.col("tile_r"))
        & (tile_of(F.col("col") + 1, bits) == F.col("tile_c"))
    )

    def slot(i: int, name: str) -> Column:
        return F.max(F.when(F.col("_slot") == i, F.col("value"))).alias(name)

    return spread.groupBy(*TILE_KEY, "row", "col").agg(
        slot(0, "ul"), slot(1, "ur"), slot(2, "ll"), slot(3, "lr"), F.count("*").cast("int").alias("inside")
    )
