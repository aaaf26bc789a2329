"""Pixel and cell operators on streams; none of them keeps state.

Sizes, rules and levels are static tables beside the stream. They are joined without being counted or collected while
the plan is built; every batch is planned with the size the static side has. Batch tables give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from reliefgrid.operators.grid import scale_offset, threshold_mask
from reliefgrid.operators.pixels import crop, map_colors


def heights_from_pixels(
    pixels: DataFrame, rules: list[dict] | DataFrame, scale: float = 1.0, offset: float = 0.0
) -> DataFrame:
    """Streaming (or batch) pixels -> cells, row by row. ``rules`` is a list or a table from ``prepare_rules``."""
    return scale_offset(map_colors(pixels, rules), scale, offset)


def window_of_pixels(
    pixels: DataFrame, region: tuple[float, float, float, float], sizes: DataFrame | None = None
) -> DataFrame:
    """A window of each streaming image: in pixels, or in shares of the size that ``sizes(image_id, height, width)`` gives.

    Images without a row in ``sizes`` have no window and give no pixels.
    """
    return crop(pixels, region, "pixels" if sizes is None else "fraction", sizes)


def masks_from_cells(cells: DataFrame, levels: DataFrame) -> DataFrame:
    """Streaming cells -> one row per cell and level, whether the cell is at least that high."""
    return threshold_mask(cells, levels)
