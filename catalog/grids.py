"""Queries on heights."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from catalog import query
from catalog.fixtures import (
    EVENT_COUNTS, LEVELS, PART_HEIGHTS, SUMMED_HEIGHTS, VECTOR_HEIGHTS,
    event_counts, levels, levels_sql, part_heights, summed_heights, vector_heights, with_,
)
from reliefgrid.operators import fill as L
from reliefgrid.operators import grid as G
from reliefgrid.runtime import scratch_path
from reliefgrid.sources import npy, tables


@query("S5", with_(PART_HEIGHTS) + "select * from fx1")
def stored_cells(spark, sf):
    path = scratch_path(spark, "cells")
    tables.write_cells(part_heights(spark, sf), path)
    return tables.read_cells(spark, path)


@query("S5", with_(PART_HEIGHTS) + """select '007' as raster_id, "row", col, value from fx1 union all select '7', "row", col, value + 1 from fx1
 union all select '1e2', "row", col, value + 2 from fx1 union all select '100', "row", col, value + 3 from fx1""")
def stored_ids(spark, sf):
    path, cells = scratch_path(spark, "cells"), part_heights(spark, sf)
    ids = F.array(*[F.struct(F.lit(i).alias("raster_id"), (F.col("value") + k).alias("value")) for k, i in enumerate(("007", "7", "1e2", "100"))])
    tables.write_cells(cells.select("row", "col", F.inline(ids)).select("raster_id", "row", "col", "value"), path)
    return tables.read_cells(spark, path)


def _local(path: str) -> str:
    return "/" + path.removeprefix("file:").lstrip("/")


@query("S3 S4", with_(EVENT_COUNTS) + "select * from fx2")
def npy_files(spark, sf):
    folder = _local(scratch_path(spark, "npy"))
    npy.write_npy(event_counts(spark, sf), folder)
    return npy.read_npy(spark, folder)


@query("S3 S4", with_(EVENT_COUNTS) + "select * from fx2 union all select 'more', \"row\", col, value * 2 from fx2")
def npy_blocks(spark, sf):
    path, cells = scratch_path(spark, "npy"), event_counts(spark, sf)
    npy.save_npy(cells, path)
    npy.save_npy(cells.select(F.lit("more").alias("raster_id"), "row", "col", (F.col("value") * 2).alias("value")), path)
    return npy.read_npy(spark, path)


@query("S13", with_(PART_HEIGHTS) + "select * from fx1")
def generated_cells(spark, sf):
    return G.from_generator(spark, lambda s: part_heights(s, sf))


@query("S6 A1", with_(EVENT_COUNTS) + "select raster_id, min(value) as min, max(value) as max, count(value)::bigint as present from fx2 group by 1")
def grid_summary(spark, sf):
    return G.grid_summary(event_counts(spark, sf))


@query("G1 G14", with_(EVENT_COUNTS) + """select raster_id, count(*)::bigint as cells, count(distinct ("row", col))::bigint as positions,
 (count(*) - count(value))::bigint as missing, 0::bigint as infinite, 0::bigint as repeated,
 ((max("row")+1)*(max(col)+1))::bigint as expected, case when count(value) < count(*) then 'non-finite' else 'ok' end as verdict from fx2 group by 1""")
def grid_problems(spark, sf):
    return G.grid_problems(event_counts(spark, sf))


@query("G2", with_(EVENT_COUNTS, "s as (select min(value) a, max(value) b from fx2)") +
       'select raster_id, "row", col, round(-10 + (value - a)/(b - a)*20, 6) as value from fx2, s')
def normalized_heights(spark, sf):
    return G.normalize_cells(event_counts(spark, sf), -10.0, 10.0).withColumn("value", F.round("value", 6))


@query("G3", with_(VECTOR_HEIGHTS) + 'select raster_id, "row", col, value*0.5 + 100 as value from fx4')
def scaled_heights(spark, sf):
    return G.scale_offset(vector_heights(spark, sf), 0.5, 100.0)


@query("G4 G3", with_(VECTOR_HEIGHTS) + 'select raster_id, "row", col, round(value + (select min(value)*(-1.1::double) from fx4), 6) as value from fx4')
def lifted_heights(spark, sf):
    c = vector_heights(spark, sf)
    return G.apply_offsets(c, G.auto_offset(c)).withColumn("value", F.round("value", 6))


@query("G5 A1", with_(EVENT_COUNTS) + """select raster_id, min(value) as min, max(value) as max, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std,
 max(value)-min(value) as "range", (max("row")+1)::int as height, (max(col)+1)::int as width, count(value)::bigint as present, count(*)::bigint as cells from fx2 group by 1""")
def grid_stats(spark, sf):
    s = G.grid_stats(event_counts(spark, sf))
    return s.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("G6", with_(EVENT_COUNTS) + 'select raster_id, "row", col, coalesce(value, 0) as value from fx2')
def filled_with_constant(spark, sf):
    return G.fill_constant(event_counts(spark, sf), 0.0)


@query("G7", with_(VECTOR_HEIGHTS, "s as (select max(\"row\")+1 h, max(col)+1 w from fx4)",
                   'p as (select unnest(range(0, (select h+6 from s)))::int as "row")',
                   "q as (select unnest(range(0, (select w+6 from s)))::int as col)") +
       """select 'vectors' as raster_id, p."row", q.col, coalesce(value, -500) as value from p cross join q
       left join fx4 on fx4."row" = p."row" - 3 and fx4.col = q.col - 3""")
def padded_heights(spark, sf):
    return G.pad(vector_heights(spark, sf), 3, -500.0)


@query("G8 G9", with_(EVENT_COUNTS, "s as (select min(value) a, max(value) b from fx2)") +
       "select 'events' as raster_id, i::int as level_idx, round(a + (b-a)*i/9, 6) as threshold, 2 + i*0.5::double as base_z from s, range(10) t(i)")
def levels_from_data(spark, sf):
    b = G.grid_summary(event_counts(spark, sf)).select("raster_id", F.col("min").alias("lo"), F.col("max").alias("hi"))
    lv = G.level_heights(G.levels_linspace_by(b, 10), 2.0, 0.5)
    return lv.withColumn("threshold", F.round("threshold", 6))


def _fill_round(src: str, out: str) -> str:
    return f"""{out} as (select a."row", a.col, coalesce(any_value(a.value), avg(b.value)) as value from {src} a left join {src} b
 on a.value is null and b."row" between a."row"-1 and a."row"+1 and b.col between a.col-1 and a.col+1 group by a."row", a.col)"""


@query("G10 J3", with_(EVENT_COUNTS, _fill_round("fx2", "f1"), _fill_round("f1", "f2"), _fill_round("f2", "f3")) +
       "select 'events' as raster_id, \"row\", col, round(value, 6) as value from f3")
def filled_from_neighbours(spark, sf):
    return L.fill_missing(event_counts(spark, sf), max_iterations=3).withColumn("value", F.round("value", 6))


_SCAN = """n as (select list(value order by "row", col) as v, max("row") + 1 as h from fx2),
gap as (select "row" as r, col as c, row_number() over (order by "row", col) as k from fx2 where value is null),
st(k, v) as (select 0::bigint, v from n union all
 select gap.k, st.v[:r*24 + c] || [list_avg(list_transform(list_filter(range(0, 9),
  lambda d: r + d//3 - 1 >= 0 and c + d%3 - 1 >= 0 and c + d%3 - 1 < 24),
  lambda d: st.v[(r + d//3 - 1)*24 + c + d%3]))] || st.v[r*24 + c + 2:] from st join gap on gap.k = st.k + 1),
fin as (select v from st order by k desc limit 1)"""


@query("G11", with_(EVENT_COUNTS, _SCAN, recursive=True) +
       'select raster_id, "row", col, round((select v from fin)["row"*24 + col + 1], 6) as value from fx2')
def filled_in_reading_order(spark, sf):
    return L.fill_missing(event_counts(spark, sf), mode="scan").withColumn("value", F.round("value", 6))


@query("G12 A2", with_(EVENT_COUNTS, _fill_round("fx2", "f1")) +
       """select 'events' as raster_id, i::bigint as initial, r::bigint as remaining, (i - r)::bigint as filled,
       round((i - r)*100.0::double/i, 6) as percent from (select count(*) filter (value is null) i from fx2), (select count(*) filter (value is null) r from f1)""")
def fill_report(spark, sf):
    c = event_counts(spark, sf)
    return L.fill_report(c, L.fill_missing(c, max_iterations=1)).withColumn("percent", F.round("percent", 6))


@query("G13 J2", with_(SUMMED_HEIGHTS, levels_sql((150.0, 230.0))) +
       'select raster_id, level_idx::int as level_idx, "row", col, coalesce(value >= threshold, false) as mask from fx9 cross join lv')
def threshold_masks(spark, sf):
    return G.threshold_mask(summed_heights(spark, sf), levels(spark, (150.0, 230.0)))
