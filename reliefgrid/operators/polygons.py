"""Polygons with holes as ring points.

``rings`` tables hold one row per point: any of ``raster_id, level_idx`` plus ``poly_id, ring_id,
role ('exterior' | 'hole'), seq, x, y`` and, where known, the next point ``nx, ny``. A closing
point equal to the first one is not stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefgrid.operators.boxes import box_pairs
from reliefgrid.operators.containment import edges_to_the_right
from reliefgrid.operators.regions import region_labels
from reliefgrid.operators.rings import RING_KEY, ring_table, trace_rings
from reliefgrid.operators.tiles import TILE_BITS
from reliefgrid.runtime import attach, bounded_rows, cut, local_table, unbroadcast

#: Edges in a band from which a polygon is searched by dyadic intervals.
BAND_EDGES = 64
#: Share of hole area from which a polygon is taken as solid.
SOLID_SHARE = 0.60


def level_key(df: DataFrame) -> list[str]:
    return [c for c in ("raster_id", "level_idx") if c in df.columns]


def poly_key(df: DataFrame) -> list[str]:
    return [*level_key(df), "poly_id"]


def with_next(rings: DataFrame) -> DataFrame:
    """Add the following point of each ring; the last point is followed by the first.

    Matching on ring and place keeps a very long ring spread over tasks, which a window over the
    ring would not.
    """
    if "nx" in rings.columns:
        return rings
    key = [*poly_key(rings), "ring_id"]
    ahead = rings.select(
        *key, (F.col("seq") - 1).alias("seq"), F.col("x").alias("nx"), F.col("y").alias("ny")
    )
    # the first point has place -1 in ``ahead``; it follows the last point of its ring
    first = ahead.filter("seq = -1").withColumnsRenamed({"nx": "fx", "ny": "fy"}).drop("seq")
    linked = rings.join(unbroadcast(ahead), [*key, "seq"], "left")
    last = linked.filter("nx is null").drop("nx", "ny").join(unbroadcast(first), key)
    last = last.withColumnsRenamed({"fx": "nx", "fy": "ny"})
    return linked.filter("nx is not null").unionByName(last)


def _cross() -> Column:
    return F.col("x") * F.col("ny") - F.col("nx") * F.col("y")


def ring_measures(rings: DataFrame) -> DataFrame:
    """Per ring: points, signed area, outline length and bounds; sums do not depend on order."""
    r = with_next(rings)
    dx, dy = F.col("nx") - F.col("x"), F.col("ny") - F.col("y")
    return r.groupBy(*poly_key(rings), "ring_id", "role").agg(
        F.count("*").alias("points"),
        (F.sum(_cross()) / 2).alias("area"),
        F.sum(F.sqrt(dx * dx + dy * dy)).alias("perimeter"),
        F.min("x").alias("min_x"),
        F.min("y").alias("min_y"),
        F.max("x").alias("max_x"),
        F.max("y").alias("max_y"),
        (F.sum((F.col("x") + F.col("nx")) * _cross()) / 6).alias("moment_x"),
        (F.sum((F.col("y") + F.col("ny")) * _cross()) / 6).alias("moment_y"),
    )


def polygon_measures(rings: DataFrame) -> DataFrame:
    """Per polygon: area without holes, exterior and hole area, outline, bounds, centroid, counts."""
    m = ring_measures(rings)
    outer = F.col("role") == "exterior"
    sign = F.when(outer, 1).otherwise(-1) * F.signum("area")

    def ext(c: str) -> Column:
        return F.when(outer, F.col(c))

    out = m.groupBy(*poly_key(rings)).agg(
        F.sum(F.col("area") * sign).alias("area"),
        F.sum(F.abs(ext("area"))).alias("exterior_area"),
        F.coalesce(F.sum(F.when(~outer, F.abs("area"))), F.lit(0.0)).alias("hole_area"),
        F.sum("perimeter").alias("perimeter"),
        F.min(ext("min_x")).alias("min_x"),
        F.min(ext("min_y")).alias("min_y"),
        F.max(ext("max_x")).alias("max_x"),
        F.max(ext("max_y")).alias("max_y"),
        F.sum(F.col("moment_x") * sign).alias("_mx"),
        F.sum(F.col("moment_y") * sign).alias("_my"),
        F.sum("points").alias("points"),
        F.count_if(~outer).alias("holes"),
    )
    return out.withColumns(
        {"centroid_x": F.try_divide("_mx", "area"), "centroid_y": F.try_divide("_my", "area")}
    ).drop("_mx", "_my")


def min_area_filter(polygons: DataFrame, min_area: float = 1e-2, inclusive: bool = False) -> DataFrame:
    """Polygons (rows with ``area``) above the minimum area."""
    a = F.col("area")
    return polygons.filter(a >= min_area if inclusive else a > min_area)


def area_fraction_filter(polygons: DataFrame, fraction: float = 0.01) -> DataFrame:
    """Polygons with at least ``fraction`` of the largest area at their level."""
    by = level_key(polygons)
    largest = polygons.groupBy(*by).agg(F.max("area").alias("_max"))
    paired = attach(polygons, largest, by) if by else polygons.crossJoin(largest)
    return paired.filter(F.col("area") >= F.col("_max") * fraction).drop("_max")


def polygon_labels(cells: DataFrame, levels: DataFrame, tile_bits: int = TILE_BITS) -> DataFrame:
    """The high regions that are polygons, written for :func:`faces_of_polygons` and :func:`slice_polygons` to share."""
    return cut(region_labels(cells, levels, 4, (True,), tile_bits=tile_bits))


def faces_of_polygons(
    faces: DataFrame, cells: DataFrame, levels: DataFrame, min_area: float = 0.0, min_fraction: float = 0.0, tile_bits: int = TILE_BITS,
    labels: DataFrame | None = None,
) -> DataFrame:
    """The triangles of ``triangulate_grid`` that lie in polygons passing both area filters.

    Each triangle has a high cell among its corners, whose region is its polygon, and the areas of a
    polygon's triangles add up to its own, so no ring is traced. ``labels`` are those of :func:`polygon_labels`, if at hand.
    """
    def high(c: str) -> Column:
        # numbers, not a struct: the join also asks each for null, and with structs that is most of the join's time
        even = [(F.col(f"x{i}").bitwiseOR(F.col(f"y{i}"))).bitwiseAND(F.lit(1)) == 0 for i in range(3)]
        return F.coalesce(*[F.when(e, F.shiftright(F.col(f"{c}{i}"), 1)) for i, e in enumerate(even)]).cast("int")

    at = ["raster_id", "level_idx", "row", "col"]
    labels = region_labels(cells, levels, 4, (True,), tile_bits=tile_bits) if labels is None else labels
    labels = labels.filter("own").select(*at, F.col("region").alias("poly_id"))
    named = faces.withColumns({"row": high("y"), "col": high("x")}).join(unbroadcast(labels), at)
    double = (F.col("x1") - F.col("x0")) * (F.col("y2") - F.col("y0")) - (F.col("x2") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    named = cut(named.select(*faces.columns, "poly_id", (F.abs(double) / 8.0).alias("area")))
    polygons = named.groupBy("raster_id", "level_idx", "poly_id").agg(F.sum("area").alias("area"))
    kept = min_area_filter(polygons, min_area) if min_area > 0 else polygons
    kept = area_fraction_filter(kept, min_fraction) if min_fraction > 0 else kept
    key = ["raster_id", "level_idx", "poly_id"]
    rows = bounded_rows(kept := kept.select(*key))
    # few polygons go to the triangles, which then stay where they are
    kept = unbroadcast(kept) if rows is None else F.broadcast(local_table(cells.sparkSession, rows, kept.schema))
    return named.join(kept, key, "left_semi").select(*faces.columns)


def max_segments_per_level(rings: DataFrame) -> DataFrame:
    """Points of the longest exterior per level, counting the closing point."""
    counts = rings.filter("role = 'exterior'").groupBy(*poly_key(rings), "ring_id").agg(F.count("*").alias("n"))
    return counts.groupBy(*level_key(rings)).agg((F.max("n") + 1).alias("max_segments"))


def keep_polygons(rings: DataFrame, polygons: DataFrame) -> DataFrame:
    """Ring points of the polygons listed in ``polygons``."""
    key = poly_key(rings)
    return rings.join(unbroadcast(polygons.select(*key).distinct()), key, "left_semi")


def hole_share_cleanup(rings: DataFrame, solid_share: float = SOLID_SHARE) -> DataFrame:
    """Holes larger than the exterior swap roles with it; large hole shares make a polygon solid.

    Only ring areas are compared; points follow their ring's new role.
    """
    key = poly_key(rings)
    areas = ring_measures(rings).select(*key, "ring_id", "role", F.abs("area").alias("area"))
    hole = F.col("role") == "hole"
    per_poly = areas.groupBy(*key).agg(
        F.sum(F.when(hole, F.col("area"))).alias("_holes"),
        F.sum(F.when(~hole, F.col("area"))).alias("_outer"),
        F.max_by("ring_id", F.when(hole, F.struct("area", -F.col("ring_id")))).alias("_largest"),
    )
    role = (
        F.when(F.col("_holes").isNull(), F.col("role"))
        .when(
            F.col("_holes") > F.col("_outer"),
            F.when(hole & (F.col("ring_id") == F.col("_largest")), "exterior").otherwise("hole"),
        )
        .when(F.col("_holes") >= F.col("_outer") * solid_share, F.when(~hole, F.col("role")))
        .otherwise(F.col("role"))
    )
    new_roles = areas.join(per_poly, key).select(*key, "ring_id", role.alias("_role")).filter("_role is not null")
    return (
        rings.join(new_roles, [*key, "ring_id"])
        .withColumn("role", F.col("_role"))
        .select(*rings.columns)
    )


def contour_to_polygon(contours: DataFrame) -> DataFrame:
    """``contour_id, seq, row, col`` point lists -> rings with x = col, y = row.

    Lists with fewer than three points give nothing; a repeated closing point is dropped.
    """
    ends = contours.groupBy("contour_id").agg(
        F.count("*").alias("_n"),
        F.max("seq").alias("_last"),
        (
            (F.min_by("row", "seq") == F.max_by("row", "seq")) & (F.min_by("col", "seq") == F.max_by("col", "seq"))
        ).alias("_closed"),
    )
    return (
        attach(contours, ends, ["contour_id"])
        .filter((F.col("_n") >= 3) & ~(F.col("_closed") & (F.col("seq") == F.col("_last"))))
        .select(
            F.col("contour_id").alias("poly_id"),
            F.col("contour_id").alias("ring_id"),
            F.lit("exterior").alias("role"),
            "seq",
            F.col("col").cast("double").alias("x"),
            F.col("row").cast("double").alias("y"),
        )
    )


def bounding_polygon(meta: DataFrame, units_x: float = 1.0, units_y: float = 1.0) -> DataFrame:
    """The rectangle of each grid as a one-ring polygon."""
    corners = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))])
    return meta.select("raster_id", "height", "width", F.posexplode(corners).alias("seq", "_c")).select(
        "raster_id",
        F.lit(0).cast("long").alias("poly_id"),
        F.lit(0).cast("long").alias("ring_id"),
        F.lit("exterior").alias("role"),
        "seq",
        (F.col("_c.x") * (F.col("width") - 1) * units_x).cast("double").alias("x"),
        (F.col("_c.y") * (F.col("height") - 1) * units_y).cast("double").alias("y"),
    )


# ---- containment -----------------------------------------------------------------------------


def point_in_polygon(points: DataFrame, rings: DataFrame) -> DataFrame:
    """Points strictly inside their polygon, holes excluded; boundary points are not inside.

    ``points`` carries the polygon key and ``x, y``. Edges and points meet in horizontal bands as
    high as the polygon's mean edge height, so the edges are copied about twice in total, and a
    point meets only the edges of its band. Polygons with more than ``BAND_EDGES`` edges in a band, as in a comb, are
    searched by dyadic intervals (:func:`edges_to_the_right`), which meet few edges whatever lies beside them.
    """
    key = poly_key(rings)
    given = points.columns
    # equal points are searched once
    points = points.groupBy(*given).agg(F.count("*").alias("_times"))
    outer = (F.col("role") == "exterior").alias("_outer") if "role" in rings.columns else F.lit(True).alias("_outer")
    edges = with_next(rings).select(*key, outer, *[F.col(c).alias(f"e{c}") for c in ("x", "y", "nx", "ny")])
    edges = edges.filter("ex <> enx or ey <> eny")
    rise = F.abs(F.col("eny") - F.col("ey"))
    bands = edges.groupBy(*key).agg(F.avg(rise).alias("_h"), F.min("ey").alias("_y0"), F.max("ey").alias("_y1"), F.count("*").alias("_n"))
    bands = bands.withColumn("_h", F.when(F.col("_h") > 0, F.col("_h")).otherwise(1.0))
    # an edge is in two bands or so
    crowded = F.col("_n") * 2 > ((F.col("_y1") - F.col("_y0")) / F.col("_h") + 1) * BAND_EDGES
    bands = cut(bands.withColumn("_crowded", crowded).drop("_y1", "_n"))
    beside = None
    if not bands.filter("_crowded").isEmpty():
        many = bands.filter("_crowded").select(*key)
        listed = cut(points.join(many, key, "left_semi").dropna(subset=["x", "y"]).distinct().withColumn("_pid", F.monotonically_increasing_id()))
        found = edges_to_the_right(listed, edges.join(many, key, "left_semi"), key)
        beside = listed.join(unbroadcast(found.filter("_n % 2 = 1 and _h % 2 = 0 and not _on")), "_pid").select(*points.columns)
    bands = bands.filter("not _crowded").drop("_crowded")

    def band(y: Column) -> Column:
        return F.floor((y - F.col("_y0")) / F.col("_h"))

    spread = attach(edges, bands, key).withColumn(
        "_band",
        F.explode(F.sequence(band(F.least("ey", "eny")), band(F.greatest("ey", "eny")))),
    )
    pid = F.struct(*[F.col(c) for c in points.columns])
    located = attach(points.withColumn("_p", pid), bands, key).withColumn("_band", band(F.col("y")))
    dx, dy = F.col("enx") - F.col("ex"), F.col("eny") - F.col("ey")
    side = dx * (F.col("y") - F.col("ey")) - dy * (F.col("x") - F.col("ex"))
    on_edge = (
        (side == 0)
        & F.col("x").between(F.least("ex", "enx"), F.greatest("ex", "enx"))
        & F.col("y").between(F.least("ey", "eny"), F.greatest("ey", "eny"))
    )
    straddles = (F.col("ey") > F.col("y")) != (F.col("eny") > F.col("y"))
    left_of = F.when(dy > 0, side > 0).otherwise(side < 0)
    hits = (
        located.join(unbroadcast(spread.drop("_h", "_y0")), [*key, "_band"])
        .groupBy(*key, "_p")
        .agg(
            F.count_if(straddles & left_of & F.col("_outer")).alias("_n"),
            F.count_if(straddles & left_of & ~F.col("_outer")).alias("_h"),
            F.max(on_edge).alias("_on"),
        )
        # holes are counted apart: one may reach beyond its exterior
        .filter((F.col("_n") % 2 == 1) & (F.col("_h") % 2 == 0) & ~F.col("_on"))
    )
    inside = hits.select("_p.*")
    inside = inside if beside is None else inside.unionByName(beside)
    return inside.withColumn("_times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select(*given)


def invalid_rings(rings: DataFrame) -> DataFrame:
    """Rings that repeat a point or whose edges cross or touch elsewhere than at shared ends.

    Edges meet by their boxes, in cells as large as the larger of two (:func:`box_pairs`), so one long edge among many
    short ones costs a row for each of them and no more.
    """
    key = [*poly_key(rings), "ring_id"]
    r = with_next(rings)
    repeated = r.groupBy(*key, "x", "y").agg(F.count("*").alias("n")).filter("n > 1").select(*key)
    short = r.groupBy(*key).agg(F.count("*").alias("n")).filter("n < 3").select(*key)
    size = r.groupBy(*key).agg((F.max("seq") + 1).alias("_n"))
    ends = [f(p, q).alias(f"{e}_{p}") for e, f in (("lo", F.least), ("hi", F.greatest)) for p, q in (("x", "nx"), ("y", "ny"))]
    e = attach(r.select(*key, F.col("seq").alias("s"), "x", "y", "nx", "ny", *ends), size, key)
    # each pair of edges whose boxes meet once, the earlier edge first
    met = box_pairs(e, key, "xy", "s").withColumn("_f", F.col("a.s") < F.col("b.s"))
    first, second = (F.when(F.col("_f"), F.col(p)).otherwise(F.col(q)) for p, q in (("a", "b"), ("b", "a")))
    met = met.select(*key, first.alias("_a"), second.alias("_b"))
    pairs = met.select(*key, F.col("_a._n").alias("_n"), *[F.col(f"_{p}.{c}").alias(f"{p}_{c}") for p in "ab" for c in ("s", "x", "y", "nx", "ny")])

    def turn(p, q, t) -> Column:
        return F.signum(
            (F.col(f"{q[0]}") - F.col(f"{p[0]}")) * (F.col(f"{t[1]}") - F.col(f"{p[1]}"))
            - (F.col(f"{q[1]}") - F.col(f"{p[1]}")) * (F.col(f"{t[0]}") - F.col(f"{p[0]}"))
        )

    a0, a1 = ("a_x", "a_y"), ("a_nx", "a_ny")
    b0, b1 = ("b_x", "b_y"), ("b_nx", "b_ny")
    d1, d2, d3, d4 = turn(a0, a1, b0), turn(a0, a1, b1), turn(b0, b1, a0), turn(b0, b1, a1)
    boxes = (
        (F.greatest("a_x", "a_nx") >= F.least("b_x", "b_nx")) & (F.greatest("b_x", "b_nx") >= F.least("a_x", "a_nx"))
        & (F.greatest("a_y", "a_ny") >= F.least("b_y", "b_ny")) & (F.greatest("b_y", "b_ny") >= F.least("a_y", "a_ny"))
    )
    meet = boxes & (d1 * d2 <= 0) & (d3 * d4 <= 0)
    adjacent = (F.col("b_s") - F.col("a_s") == 1) | ((F.col("a_s") == 0) & (F.col("b_s") == F.col("_n") - 1))
    # neighbours share one end; they only clash when they fold back onto each other
    dot = (F.col("a_nx") - F.col("a_x")) * (F.col("b_nx") - F.col("b_x")) + (
        F.col("a_ny") - F.col("a_y")) * (F.col("b_ny") - F.col("b_y"))
    folded = (d1 == 0) & (d2 == 0) & (dot < 0)
    crossed = pairs.filter(F.when(adjacent, folded).otherwise(meet)).select(*key)
    return repeated.unionByName(short).unionByName(crossed).distinct()


def is_valid_polygon(rings: DataFrame, min_area: float = 1e-2) -> DataFrame:
    """Per polygon: simple rings and an area above the minimum."""
    key = poly_key(rings)
    bad = invalid_rings(rings).select(*key).distinct().withColumn("_bad", F.lit(True))
    return (
        polygon_measures(rings)
        .select(*key, "area")
        .join(bad, key, "left")
        .select(*key, (F.col("_bad").isNull() & (F.col("area") > min_area)).alias("valid"))
    )


# ---- slices of a height grid -----------------------------------------------------------------


def ring_roles(
    rings: DataFrame, cells: DataFrame, levels: DataFrame, tile_bits: int = TILE_BITS, labels: DataFrame | None = None
) -> DataFrame:
    """One row per traced ring: role by the sign of its area, polygon = the high region it bounds.

    A hole belongs to the polygon whose region lies on its high side, so no containment test is
    needed.
    """
    if labels is None:
        labels = region_labels(cells, levels, 4, (True,), border_only=True, tile_bits=tile_bits)
    labels = labels.filter("border").select(
        "tile", "raster_id", "level_idx",
        (F.col("row") * 2).alias("hy1"), (F.col("col") * 2).alias("hx1"), F.col("region").alias("poly_id"),
    )
    return (
        ring_table(rings)
        .join(unbroadcast(labels), ["tile", "raster_id", "level_idx", "hy1", "hx1"])
        .select(
            *RING_KEY, "poly_id", "points", "area",
            F.when(F.col("area") > 0, "exterior").otherwise("hole").alias("role"),
        )
    )


def ring_points(rings: DataFrame, roles: DataFrame) -> DataFrame:
    """Traced segments with their ring's role and polygon, in plain cell coordinates."""
    return rings.join(unbroadcast(roles.select(*RING_KEY, "poly_id", "role")), RING_KEY).select(
        "raster_id", "level_idx", "poly_id", "ring_id", "role", "seq",
        *[(F.col(a) / 2).alias(b) for a, b in (("x1", "x"), ("y1", "y"), ("x2", "nx"), ("y2", "ny"))],
    )


def slice_polygons(
    cells: DataFrame,
    levels: DataFrame,
    min_area: float = 0.0,
    min_fraction: float = 0.0,
    mode: str = "slice",
    tile_bits: int = TILE_BITS,
    max_segments: int | None = None,
    tolerance: float = 0.5,
    labels: DataFrame | None = None,
) -> DataFrame:
    """Polygons of every level in one job: outer rings and their holes.

    ``mode="slice"`` is the horizontal cut through the grid; ``mode="compat"`` gives the net effect
    of the original steps (see ``compat.py``). With ``max_segments`` the rings are simplified until
    no exterior has more points. ``labels`` are those of :func:`polygon_labels`, if at hand; compat slices need their own.
    """
    if mode == "compat":
        from reliefgrid.operators.compat import compat_polygons

        points = compat_polygons(cells, levels, min_area, tile_bits)
        min_area = 0.0
    elif mode == "slice":
        rings = trace_rings(cells, levels, tile_bits=tile_bits)
        points = ring_points(rings, ring_roles(rings, cells, levels, tile_bits, labels))
    else:
        raise ValueError(f"Unknown mode: {mode}")
    if min_area > 0 or min_fraction > 0 or max_segments is not None:
        points = cut(points)  # read several times from here on
    if min_area > 0 or min_fraction > 0:
        polygons = polygon_measures(points).select(*poly_key(points), "area")
        kept = min_area_filter(polygons, min_area) if min_area > 0 else polygons
        kept = area_fraction_filter(kept, min_fraction) if min_fraction > 0 else kept
        points = keep_polygons(points, kept)
    if max_segments is not None:
        from reliefgrid.operators.simplify import simplify_rings

        points = simplify_rings(points, tolerance, max_segments)
    if mode == "compat":
        points = hole_share_cleanup(cut(points))
    return points


def multi_level_polygons(cells: DataFrame, thresholds, **options) -> DataFrame:
    """Polygons of a list of thresholds, keyed by ``level_idx``."""
    from reliefgrid.operators.grid import levels_table

    return slice_polygons(cells, levels_table(cells.sparkSession, thresholds), **options)
