"""Polygons as the original chain of steps leaves them.

There, outlines half a cell outside each region are united and the borders through the cell centres
are cut out of them again. What is left is, in closed form:

* for each outermost region its outline, with the centre border of the region as a hole;
* for each hole of a region the centre border of that hole;
* from each such piece the centre borders of the regions lying directly in it are cut out.

A region whose centre border meets itself is not cut out, so it stays solid, and what lies in it
belongs to the piece around it. Regions here join diagonally; centre borders come from the contour
that joins diagonals, by moving every point to the high cell beside it. A hole closed only by a
diagonal is open to the outside in the outlines; nothing covers it, so it gives no piece (the strip
half a cell wide that is left along its border is not kept).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliefgrid.operators.regions import framed, region_labels
from reliefgrid.operators.rings import RING_KEY, ring_table, trace_rings
from reliefgrid.operators.tiles import TILE_BITS
from reliefgrid.runtime import cut

_BY = ["raster_id", "level_idx"]


def centre_borders(rings: DataFrame) -> DataFrame:
    """Traced rings moved onto the centres of their high cells; steps within one cell vanish."""
    moves = rings.filter("hx1 <> hx2 or hy1 <> hy2")
    return moves.select(
        *RING_KEY, "seq",
        *[(F.col(a) / 2).alias(b) for a, b in (("hx1", "x"), ("hy1", "y"), ("hx2", "nx"), ("hy2", "ny"))],
    )


def border_facts(borders: DataFrame) -> DataFrame:
    """Per centre border: area, and whether it is a ring of at least three different cells."""
    per_cell = borders.groupBy(*RING_KEY, "x", "y").agg(
        F.count("*").alias("n"), F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y")).alias("cross")
    )
    return per_cell.groupBy(*RING_KEY).agg(
        F.count("*").alias("cells"),
        (F.abs(F.sum("cross")) / 2).alias("centre_area"),
        ((F.max("n") == 1) & (F.count("*") >= 3)).alias("simple"),
    )


def _labels(cells: DataFrame, levels: DataFrame, tile_bits: int) -> DataFrame:
    """High (8-connected) and low (4-connected) regions along the contours."""
    return cut(region_labels(framed(cells), levels, 8, (True, False), border_only=True, tile_bits=tile_bits))


def _with_region(table: DataFrame, labels: DataFrame, x: str, y: str, high: bool, name: str) -> DataFrame:
    side = labels.filter(F.col("high") == high).select(
        "tile", *_BY, (F.col("col") * 2).alias(x), (F.col("row") * 2).alias(y), F.col("region").alias(name)
    )
    return table.join(side, ["tile", *_BY, x, y])


def _nearest_valid(regions: DataFrame, holes: DataFrame, max_rounds: int = 40) -> DataFrame:
    """For each region the nearest enclosing region that is cut out, with the hole it lies in.

    Regions nest through holes: ``around`` is the region owning the hole a region lies in. Pointers
    skip over regions that stay solid, twice as far each round. ``top`` is the outermost region.
    """
    parent = regions.join(
        holes.select(*_BY, F.col("low").alias("low"), F.col("region").alias("around"), F.col("ring_id").alias("hole")),
        [*_BY, "low"], "left",
    )
    valid = regions.select(*_BY, F.col("region").alias("around"), F.col("valid").alias("around_valid"))
    state = cut(
        parent.join(valid, [*_BY, "around"], "left").select(
            *_BY, "region", "valid", "around", "hole",
            (F.col("around").isNull() | F.col("around_valid")).alias("settled"),
            F.coalesce("around", "region").alias("top"), F.col("around").isNull().alias("topped"),
        )
    )
    for _ in range(max_rounds):
        if state.filter("not settled or not topped").isEmpty():
            break
        up = state.select(
            *_BY, F.col("region").alias("_r"), F.col("around").alias("a2"), F.col("hole").alias("h2"),
            F.col("settled").alias("s2"), F.col("top").alias("t2"), F.col("topped").alias("d2"),
        )
        a = state.join(
            up.select(*_BY, F.col("_r").alias("around"), "a2", "h2", "s2"), [*_BY, "around"], "left"
        ).join(up.select(*_BY, F.col("_r").alias("top"), "t2", "d2"), [*_BY, "top"], "left")
        skip = ~F.col("settled")
        state = cut(
            a.select(
                *_BY, "region", "valid",
                F.when(skip, F.col("a2")).otherwise(F.col("around")).alias("around"),
                F.when(skip, F.col("h2")).otherwise(F.col("hole")).alias("hole"),
                F.when(skip, F.col("s2")).otherwise(F.lit(True)).alias("settled"),
                F.when(F.col("topped"), F.col("top")).otherwise(F.col("t2")).alias("top"),
                F.when(F.col("topped"), F.lit(True)).otherwise(F.col("d2")).alias("topped"),
            )
        )
    else:
        raise RuntimeError("regions nest too deeply; raise max_rounds")
    return state


def compat_polygons(cells: DataFrame, levels: DataFrame, min_area: float = 1e-2, tile_bits: int = TILE_BITS) -> DataFrame:
    """Ring points of all pieces: even ring ids are outlines, odd ones centre borders."""
    labels = _labels(cells, levels, tile_bits)
    outlines = cut(trace_rings(cells, levels, "low", tile_bits=tile_bits))
    joined = cut(trace_rings(cells, levels, "high", tile_bits=tile_bits))
    borders = centre_borders(joined)
    facts = border_facts(borders)

    # per-ring tables are read many times below, so each is written once
    table = _with_region(ring_table(joined), labels, "hx1", "hy1", True, "region")
    table = _with_region(table, labels, "lx", "ly", False, "low").join(facts, RING_KEY, "left")
    # low regions that reach the outside diagonally carry the frame's first cell as their name
    open_low = region_labels(framed(cells), levels, 4, (False,), border_only=True, tile_bits=tile_bits)
    table = cut(_with_region(table, open_low, "lx", "ly", False, "low8").withColumn("open", F.col("low8") == 0))
    whole = F.coalesce("simple", F.lit(False))
    regions = table.filter("area > 0").select(
        *_BY, "region", "low", F.col("ring_id").alias("border"), (whole & (F.col("centre_area") >= min_area)).alias("valid")
    )
    holes = table.filter("area < 0 and not open").select(*_BY, "region", "low", "ring_id", "cells")
    nest = _nearest_valid(regions.select(*_BY, "region", "low", "valid"), holes)
    nest = cut(nest.join(regions.select(*_BY, "region", "border"), [*_BY, "region"]))

    # exteriors: outlines of outermost regions ...
    lines = _with_region(ring_table(outlines).filter(F.col("area") > min_area), labels, "hx1", "hy1", True, "region")
    tops = nest.filter(F.col("top") == F.col("region")).select(*_BY, "region")
    lines = cut(lines.join(tops, [*_BY, "region"]).select(*_BY, "region", "ring_id", "area"))
    even = F.col("ring_id") * 2
    ext_lines = lines.select(*_BY, F.col("ring_id"), even.alias("poly_id"), F.lit("exterior").alias("role"))
    # ... and centre borders of the holes of regions that are cut out
    valid = nest.filter("valid").select(*_BY, "region", "around", "hole", "top", "border")
    ext_holes = holes.filter("cells >= 3").join(valid.select(*_BY, "region"), [*_BY, "region"], "left_semi").select(
        *_BY, "ring_id", (even + 1).alias("poly_id"), F.lit("exterior").alias("role")
    )
    # holes: the centre border of each such region, cut out of the piece around it
    largest = lines.groupBy(*_BY, F.col("region").alias("top")).agg(
        F.max_by("ring_id", F.struct("area", -F.col("ring_id"))).alias("line")
    )
    cuts = valid.join(largest, [*_BY, "top"], "left").select(
        *_BY, F.col("border").alias("ring_id"),
        F.coalesce(F.col("hole") * 2 + 1, F.col("line") * 2).alias("poly_id"), F.lit("hole").alias("role"),
    ).filter("poly_id is not null")

    plain = outlines.select(
        *RING_KEY, "seq", *[(F.col(a) / 2).alias(b) for a, b in (("x1", "x"), ("y1", "y"), ("x2", "nx"), ("y2", "ny"))]
    )
    from_lines = plain.join(ext_lines, RING_KEY).withColumn("ring_id", F.col("ring_id") * 2)
    from_borders = borders.join(ext_holes.unionByName(cuts), RING_KEY).withColumn("ring_id", F.col("ring_id") * 2 + 1)
    # vanished steps leave gaps in the numbering of centre borders
    from reliefgrid.operators.simplify import renumber

    key = [*_BY, "poly_id", "ring_id", "role"]
    cols = [*_BY, "poly_id", "ring_id", "role", "seq", "x", "y", "nx", "ny"]
    return from_lines.select(*cols).unionByName(renumber(from_borders.select(*cols), key).select(*cols))
