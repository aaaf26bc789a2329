"""Queries on contours, regions, rings and polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.fixtures import (
    EVENT_COUNTS, LEVELS, NATION_SQUARES, PART_HEIGHTS, SUMMED_HEIGHTS, SUM_LEVELS, VECTOR_HEIGHTS, WIDE_LEVELS,
    blocks_sql, event_counts, levels, levels_sql, nation_squares, part_heights, regions_sql, rings_sql, segments_sql,
    summed_heights, table, vector_heights, with_,
)
from reliefgrid.operators import contour as C
from reliefgrid.operators import grid as G
from reliefgrid.operators import polygons as Y
from reliefgrid.operators import regions as R
from reliefgrid.operators import rings as K
from reliefgrid.operators import simplify as S
from reliefgrid.operators.inspect import level_report

_MEASURES = """round(sum(x1::bigint*y2 - x2::bigint*y1)/8.0::double, 6) as area,
 round((count(*) filter (x1 = x2 or y1 = y2)) + (count(*) filter (x1 <> x2 and y1 <> y2))*sqrt(0.5::double), 6) as perimeter"""


def _outline_sql(fixture: str, src: str, values) -> str:
    return with_(fixture, levels_sql(values), segments_sql(src)) + (
        f"select raster_id, level_idx::int as level_idx, threshold, count(*)::bigint as segments, {_MEASURES} from seg group by raster_id, level_idx, threshold"
    )


def _rounded(df):
    return df.withColumns({"area": F.round("area", 6), "perimeter": F.round("perimeter", 6)})


TEN = tuple(50.0 * i / 9 for i in range(10))


@query("C1 C6 C14 G13", _outline_sql(PART_HEIGHTS, "fx1", TEN))
def level_outlines(spark, sf):
    return _rounded(C.level_outline(part_heights(spark, sf), levels(spark, TEN)))


@query("C1 C6 G3", _outline_sql(VECTOR_HEIGHTS, "fx4", WIDE_LEVELS))
def wide_level_outlines(spark, sf):
    return _rounded(C.level_outline(vector_heights(spark, sf), levels(spark, WIDE_LEVELS)))


@query("C1 J4", with_(EVENT_COUNTS, levels_sql((2.0, 5.0)), segments_sql("fx2")) +
       "select raster_id, level_idx::int as level_idx, threshold, x1, y1, x2, y2 from seg")
def contour_segments(spark, sf):
    return C.contour_segments(event_counts(spark, sf), levels(spark, (2.0, 5.0)))


@query("C1", with_(PART_HEIGHTS, levels_sql(LEVELS), segments_sql("fx1", "high")) +
       "select raster_id, level_idx::int as level_idx, threshold, x1, y1, x2, y2 from seg")
def contour_segments_joined_saddles(spark, sf):
    return C.contour_segments(part_heights(spark, sf), levels(spark), saddles="high")


def _interp_sql() -> str:
    def pt(side: str) -> tuple[str, str]:
        x = f"case {side} when 'T' then col + (threshold-ul)/(ur-ul) when 'B' then col + (threshold-ll)/(lr-ll) when 'L' then col else col + 1 end"
        y = f"case {side} when 'L' then \"row\" + (threshold-ul)/(ll-ul) when 'R' then \"row\" + (threshold-ur)/(lr-ur) when 'T' then \"row\" else \"row\" + 1 end"
        return x, y

    rows = ", ".join(f"({k}, '{s}', '{e}')" for k, segs in C.SEGMENT_TABLE.items() for s, e in segs)
    x1, y1 = pt("sa")
    x2, y2 = pt("sb")
    return with_(VECTOR_HEIGHTS, levels_sql((-150.5, 0.5, 99.5)), blocks_sql("fx4"), f"st as (select * from (values {rows}) t(k, sa, sb))") + (
        "select raster_id, level_idx::int as level_idx, threshold, "
        + ", ".join(f"round(({e})::double + 1e-9, 6) as {n}" for e, n in ((x1, "x1"), (y1, "y1"), (x2, "x2"), (y2, "y2")))
        + " from cs join st using (k) where inside = 4"
    )


@query("C1b", _interp_sql())
def interpolated_segments(spark, sf):
    s = C.contour_segments_interp(vector_heights(spark, sf), levels(spark, (-150.5, 0.5, 99.5)))
    # the shift keeps exact halves from being rounded apart
    return s.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("x1", "y1", "x2", "y2")})


@query("C2 A14", with_(PART_HEIGHTS, levels_sql(LEVELS), "h as (select raster_id, level_idx, \"row\", col, col - row_number() over "
                       "(partition by level_idx, \"row\" order by col) as g from fx1 join lv on value >= threshold)") +
       'select raster_id, level_idx::int as level_idx, "row", min(col) as col_from, max(col) as col_to, count(*)::bigint as cells from h group by raster_id, level_idx, "row", g')
def mask_runs(spark, sf):
    return C.mask_runs(part_heights(spark, sf), levels(spark))


@query("C3", with_(SUMMED_HEIGHTS, levels_sql(SUM_LEVELS), regions_sql("fx9"), recursive=True) +
       """select 'part' as raster_id, level_idx::int as level_idx, (id // 4294967296 - 1)::int as "row", (id % 4294967296 - 1)::int as col, region from reg""")
def regions(spark, sf):
    return R.label_components(summed_heights(spark, sf), levels(spark, SUM_LEVELS))


@query("C3", with_(PART_HEIGHTS, levels_sql(LEVELS), regions_sql("fx1", 8), recursive=True) +
       "select 'part' as raster_id, level_idx::int as level_idx, region, count(*)::bigint as cells from reg group by all")
def diagonal_region_sizes(spark, sf):
    return R.region_sizes(R.label_components(part_heights(spark, sf), levels(spark), connectivity=8))


_SUM_RINGS = (SUMMED_HEIGHTS, levels_sql(SUM_LEVELS), segments_sql("fx9"), rings_sql())


@query("C4 A13", with_(*_SUM_RINGS, recursive=True) +
       "select raster_id, level_idx::int as level_idx, ring_id, seq, x1, y1, x2, y2 from ring")
def rings(spark, sf):
    r = K.trace_rings(summed_heights(spark, sf), levels(spark, SUM_LEVELS), keep_frame=True)
    return r.select("raster_id", "level_idx", "ring_id", "seq", "x1", "y1", "x2", "y2")


_ROLES = (
    "rt as (select level_idx, ring_id, count(*) as points, sum(x1::bigint*y2 - x2::bigint*y1)/8.0::double as area, "
    "arg_min((hrow+1)::bigint*4294967296 + hcol + 1, seq) as id from ring group by all)",
    "role as (select level_idx, ring_id, region as poly_id, points, area, case when area > 0 then 'exterior' else 'hole' end as role from rt join reg using (level_idx, id))",
)
_SUM_ROLES = (*_SUM_RINGS, regions_sql("fx9"), *_ROLES)


@query("C5 J11", with_(*_SUM_ROLES, recursive=True) +
       "select 'part' as raster_id, level_idx::int as level_idx, ring_id, poly_id, points::bigint as points, area, role from role")
def ring_roles(spark, sf):
    c, lv = summed_heights(spark, sf), levels(spark, SUM_LEVELS)
    return Y.ring_roles(K.trace_rings(c, lv), c, lv)


_POLY = "poly as (select level_idx, poly_id, sum(area) as area, sum(area) filter (role = 'exterior') as exterior_area, -coalesce(sum(area) filter (role = 'hole'), 0) as hole_area, sum(points) as points, count(*) filter (role = 'hole') as holes from role group by all)"


@query("C13 C14 C6", with_(*_SUM_ROLES, _POLY, recursive=True) +
       "select 'part' as raster_id, level_idx::int as level_idx, poly_id, area, exterior_area, hole_area, points::bigint as points, holes::bigint as holes from poly")
def slice_polygons(spark, sf):
    p = Y.multi_level_polygons(summed_heights(spark, sf), SUM_LEVELS)
    m = Y.polygon_measures(p)
    return m.select("raster_id", "level_idx", "poly_id", "area", "exterior_area", "hole_area", "points", "holes")


@query("C7 C8 A4", with_(*_SUM_ROLES, _POLY, recursive=True) +
       "select 'part' as raster_id, level_idx::int as level_idx, poly_id, area from (select *, max(area) over (partition by level_idx) as m from poly where area > 1.0::double) where area >= m * 0.01::double")
def large_polygons(spark, sf):
    p = Y.multi_level_polygons(summed_heights(spark, sf), SUM_LEVELS, min_area=1.0, min_fraction=0.01)
    return Y.polygon_measures(p).select("raster_id", "level_idx", "poly_id", "area")


@query("X13", with_(*_SUM_ROLES, recursive=True) +
       """select lv.level_idx::int as level_idx, threshold, count(distinct poly_id)::bigint as polygons, (count(*) filter (role = 'hole'))::bigint as holes,
       coalesce(sum(points), 0)::bigint as points, count(poly_id) = 0 as empty from lv left join role using (level_idx) group by all""")
def level_report_query(spark, sf):
    lv = levels(spark, SUM_LEVELS)
    return level_report(lv, Y.slice_polygons(summed_heights(spark, sf), lv))


@query("C9 A5")
def simplified_slices(spark, sf):
    p = Y.slice_polygons(summed_heights(spark, sf), levels(spark, SUM_LEVELS), max_segments=100)
    return Y.polygon_measures(p).select("raster_id", "level_idx", "poly_id", "points", "area")


@query("C9 A5", with_(*_SUM_ROLES, recursive=True) +
       """select level_idx::int as level_idx, count(distinct poly_id)::bigint as polygons, count(*)::bigint as rings, true as within_limit from role group by 1""")
def simplified_totals(spark, sf):
    p = Y.slice_polygons(summed_heights(spark, sf), levels(spark, SUM_LEVELS), max_segments=60)
    per_ring = p.groupBy("level_idx", "poly_id", "ring_id", "role").agg(F.count("*").alias("n"))
    return per_ring.groupBy("level_idx").agg(
        F.count_distinct("poly_id").alias("polygons"), F.count("*").alias("rings"),
        F.min((F.col("role") != "exterior") | (F.col("n") < 60)).alias("within_limit"),
    )


@query("C9 C11", with_(*_SUM_ROLES, recursive=True) + "select level_idx::int as level_idx, count(*)::bigint as rings, 0::bigint as invalid from role group by 1")
def simplified_rings_are_valid(spark, sf):
    p = Y.slice_polygons(summed_heights(spark, sf), levels(spark, SUM_LEVELS), max_segments=60)
    rings = p.select("level_idx", "poly_id", "ring_id").distinct().groupBy("level_idx").agg(F.count("*").alias("rings"))
    bad = Y.invalid_rings(p).groupBy("level_idx").agg(F.count("*").alias("invalid"))
    return rings.join(bad, "level_idx", "left").select("level_idx", "rings", F.coalesce("invalid", F.lit(0)).alias("invalid"))


@query("C13")
def compat_slices(spark, sf):
    p = Y.slice_polygons(summed_heights(spark, sf), levels(spark, SUM_LEVELS), 1e-2, 0.01, mode="compat")
    return Y.polygon_measures(p).select("raster_id", "level_idx", "poly_id", "points", "area", "holes")


_SQUARE_RINGS = """ra as (select poly_id, ring_id, role, count(*) as points, sum(x*ny - nx*y)/2 as area,
 sum(sqrt(pow(nx-x,2)+pow(ny-y,2))) as perimeter, min(x) as min_x, min(y) as min_y, max(x) as max_x, max(y) as max_y from fx6e group by all)"""


@query("C6 A9", with_(NATION_SQUARES, _SQUARE_RINGS) +
       """select poly_id, sum(case role when 'exterior' then area else -area end) as area, sum(area) filter (role = 'exterior') as exterior_area,
       coalesce(sum(area) filter (role = 'hole'), 0) as hole_area, round(sum(perimeter), 6) as perimeter, max(min_x) filter (role = 'exterior') as min_x,
       max(min_y) filter (role = 'exterior') as min_y, max(max_x) filter (role = 'exterior') as max_x, max(max_y) filter (role = 'exterior') as max_y,
       sum(points)::bigint as points, (count(*) filter (role = 'hole'))::bigint as holes from ra group by 1""")
def polygon_measures(spark, sf):
    m = Y.polygon_measures(nation_squares(spark, sf)).drop("centroid_x", "centroid_y")
    return m.withColumn("perimeter", F.round("perimeter", 6))


@query("C10 A6", with_(NATION_SQUARES, _SQUARE_RINGS, """pa as (select poly_id, sum(area) filter (role = 'hole') as h, sum(area) filter (role = 'exterior') as e from ra group by 1)""") +
       """select poly_id, ring_id, case when h is null or h < 0.6::double*e then role when h > e then (case role when 'hole' then 'exterior' else 'hole' end) else 'exterior' end as role,
       seq::int as seq, x, y from fx6 join pa using (poly_id) where h is null or h < 0.6::double*e or h > e or role = 'exterior'""")
def holes_cleaned(spark, sf):
    return Y.hole_share_cleanup(nation_squares(spark, sf))


def _bow_ties(spark, sf):
    """Nation squares; in every third one two corners are swapped."""
    r = nation_squares(spark, sf).filter("role = 'exterior'")
    swapped = F.when((F.col("poly_id") % 3 == 0) & F.col("seq").isin(1, 2), 3 - F.col("seq")).otherwise(F.col("seq"))
    return r.withColumn("seq", swapped)


@query("C11", with_(NATION_SQUARES) + "select poly_id, poly_id % 3 <> 0 as valid from fx6 where role = 'exterior' group by all")
def polygon_validity(spark, sf):
    return Y.is_valid_polygon(_bow_ties(spark, sf), 1.0)


@query("C12", with_("ev as (select user_id as contour_id, row_number() over (partition by user_id order by event_id) - 1 as seq, extract(hour from ts)::double as y, value as x, count(*) over (partition by user_id) as n from events)") +
       "select contour_id as poly_id, contour_id as ring_id, 'exterior' as role, seq::bigint as seq, round(x, 6) as x, y from ev where n >= 3")
def contours_to_polygons(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    c = table(spark, sf, "events").select(
        F.col("user_id").alias("contour_id"), (F.row_number().over(w) - 1).cast("long").alias("seq"),
        F.hour("ts").cast("double").alias("row"), F.col("value").alias("col"),
    )
    return Y.contour_to_polygon(c).withColumn("x", F.round("x", 6))


@query("C15", with_(EVENT_COUNTS, "s as (select (max(\"row\"))::double as h, max(col)::double as w from fx2)") +
       """select 'events' as raster_id, 0::bigint as poly_id, 0::bigint as ring_id, 'exterior' as role, seq::int as seq, w*a*2 as x, h*b*3 as y from s,
       (values (0,0,0),(1,1,0),(2,1,1),(3,0,1)) t(seq, a, b)""")
def bounding_rectangles(spark, sf):
    return Y.bounding_polygon(G.raster_meta(event_counts(spark, sf)), 2.0, 3.0)


@query("C16 J6", with_(NATION_SQUARES) + """select c_nationkey::bigint as poly_id, c_custkey, round(x, 6) as x, round(y, 6) as y from
 (select c_nationkey, c_custkey, c_nationkey*20 + (c_custkey*7 % 100)/10.0::double as x, (c_custkey*13 % 90)/10.0::double as y from customer)
 where x > c_nationkey*20 and x < c_nationkey*20 + 8 and y > 0 and y < 8
 and not (x >= c_nationkey*20 and x <= c_nationkey*20 + c_nationkey % 10 and y >= 0 and y <= c_nationkey % 10)""")
def points_in_polygons(spark, sf):
    k = F.col("c_nationkey")
    pts = table(spark, sf, "customer").select(
        k.cast("long").alias("poly_id"), "c_custkey",
        (k * 20 + (F.col("c_custkey") * 7 % 100) / 10.0).alias("x"), ((F.col("c_custkey") * 13 % 90) / 10.0).alias("y"),
    )
    return Y.point_in_polygon(pts, nation_squares(spark, sf)).withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


_COMB = (
    "tk as (select c_custkey - 1 as k, max(c_custkey) over () as n from customer)",
    "tt as (select k*4 + j as seq, k + a as x, b as y from tk, (values (0, 0.0::double, 0.0::double), (1, 0.0, 8.0), (2, 0.5, 8.0), (3, 0.5, 0.0)) t(j, a, b) union all "
    "select n*4 + j, n*a, b from (select distinct n from tk), (values (0, 1.0::double, 0.0::double), (1, 1.0, -1.0), (2, 0.0, -1.0)) t(j, a, b))",
    "te as (select *, coalesce(lead(x) over (order by seq), first_value(x) over (order by seq)) as nx, coalesce(lead(y) over (order by seq), first_value(y) over (order by seq)) as ny from tt)",
    "tp as (select o_orderkey, (o_orderkey*7 % (n*4 + 8))/4.0::double - 1 as x, (o_orderkey % 41)/4.0::double - 1.5 as y from orders, (select distinct n from tk))",
    "ts as (select o_orderkey, tp.x as px, tp.y as py, (nx - te.x)*(tp.y - te.y) - (ny - te.y)*(tp.x - te.x) as s, te.* from tp, te where tp.y between least(te.y, ny) and greatest(te.y, ny))",
)


@query("C16 J6", with_(*_COMB) + """select 1::bigint as poly_id, o_orderkey, any_value(px) as x, any_value(py) as y from ts group by o_orderkey
 having not bool_or(s = 0 and px between least(x, nx) and greatest(x, nx)) and (count(*) filter ((y > py) <> (ny > py) and ((ny > y and s > 0) or (ny < y and s < 0)))) % 2 = 1""")
def points_in_a_comb(spark, sf):
    """One tooth per customer: nearly all edges lie beside every point."""
    k = table(spark, sf, "customer").select((F.col("c_custkey") - 1).alias("k"))
    n = k.agg((F.max("k") + 1).alias("n"))
    one = [F.lit(1).cast("long").alias("poly_id"), F.lit(1).cast("long").alias("ring_id"), F.lit("exterior").alias("role")]
    tooth = F.array(*[F.struct((F.col("k") + a).alias("x"), F.lit(b).alias("y")) for a, b in ((0.0, 0.0), (0.0, 8.0), (0.5, 8.0), (0.5, 0.0))])
    base = F.array(*[F.struct((F.col("n") * a).alias("x"), F.lit(b).alias("y")) for a, b in ((1.0, 0.0), (1.0, -1.0), (0.0, -1.0))])
    rings = k.select(*one, "k", F.posexplode(tooth).alias("j", "p")).unionByName(n.select(*one, F.col("n").alias("k"), F.posexplode(base).alias("j", "p")))
    rings = rings.select("poly_id", "ring_id", "role", (F.col("k") * 4 + F.col("j")).cast("int").alias("seq"), "p.x", "p.y")
    o = F.col("o_orderkey")
    points = table(spark, sf, "orders").crossJoin(F.broadcast(n)).select(
        F.lit(1).cast("long").alias("poly_id"), o, ((o * 7 % (F.col("n") * 4 + 8)) / 4.0 - 1).alias("x"), ((o % 41) / 4.0 - 1.5).alias("y")
    )
    return Y.point_in_polygon(points, rings)
