"""Grids, pixels and meshes derived from the driver tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefgrid.operators.contour import SADDLES_JOINED, SEGMENT_TABLE, SIDE_CORNERS, SIDE_OFFSET, CORNER_OFFSET
from reliefgrid.operators.grid import complete_cells, levels_table, to_cells
from reliefgrid.operators.mesh import FILL_TABLE, POINT_OFFSET, Mesh, surface_mesh
from reliefgrid.runtime import unbroadcast

LEVELS = (1.0, 10.0, 25.0, 40.0)
SUM_LEVELS = (150.0, 230.0, 300.0)
WIDE_LEVELS = (-200.0, 0.0, 150.0)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def part_heights(spark: SparkSession, sf: str) -> DataFrame:
    """Dense integer heights, 50 columns wide."""
    p = table(spark, sf, "part")
    return to_cells(p, F.expr("p_partkey div 50"), F.expr("p_partkey % 50"), "p_size", F.lit("part"))


PART_HEIGHTS = """fx1 as (select 'part' as raster_id, (p_partkey // 50)::int as "row", (p_partkey % 50)::int as col,
 p_size::double as value from part)"""


def event_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Events per user and hour; hours without events are missing cells."""
    e = table(spark, sf, "events")
    counts = e.groupBy(F.col("user_id").alias("u"), F.hour("ts").alias("h")).agg(F.count("*").alias("n"))
    cells = to_cells(counts, "u", "h", "n", F.lit("events"))
    meta = e.agg((F.max("user_id") + 1).cast("int").alias("height")).select(
        F.lit("events").alias("raster_id"), "height", F.lit(24).alias("width")
    )
    return complete_cells(cells, meta)


EVENT_COUNTS = """fx2c as (select user_id as u, extract(hour from ts) as h, count(*)::double as n from events group by all),
fx2 as (select 'events' as raster_id, r.u::int as "row", c.h::int as col, n as value
 from (select unnest(range(0, (select max(user_id) + 1 from events))) as u) r
 cross join (select unnest(range(0, 24)) as h) c left join fx2c on fx2c.u = r.u and fx2c.h = c.h)"""


def order_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """An RGB picture 100 pixels wide."""
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.lit("orders").alias("image_id"),
        F.expr("o_orderkey div 100").cast("int").alias("row"),
        (k % 100).cast("int").alias("col"),
        *[((k * m) % 256).cast("int").alias(c) for c, m in (("r", 7), ("g", 13), ("b", 29))],
    )


ORDER_PIXELS = """fx3 as (select 'orders' as image_id, (o_orderkey // 100)::int as "row", (o_orderkey % 100)::int as col,
 ((o_orderkey * 7) % 256)::int as r, ((o_orderkey * 13) % 256)::int as g, ((o_orderkey * 29) % 256)::int as b from orders)"""


def vector_heights(spark: SparkSession, sf: str) -> DataFrame:
    """Signed integer heights, one row per vector, 64 columns."""
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return to_cells(e, "vec_id", "i", F.round(F.col("v").cast("double") * 1000), F.lit("vectors"))


VECTOR_HEIGHTS = """fx4 as (select 'vectors' as raster_id, vec_id::int as "row", (i - 1)::int as col,
 round(embedding[i]::double * 1000) as value from embeddings, range(1, 65) t(i))"""


def summed_heights(spark: SparkSession, sf: str) -> DataFrame:
    """Part heights summed over the 3x3 window."""
    c = part_heights(spark, sf)
    steps = F.sequence(F.lit(-1), F.lit(1))
    near = (
        c.withColumn("dr", F.explode(steps)).withColumn("dc", F.explode(steps))
        .groupBy("raster_id", (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"))
        .agg(F.sum("value").alias("total"))
    )
    return c.join(unbroadcast(near), ["raster_id", "row", "col"]).select("raster_id", "row", "col", F.col("total").alias("value"))


SUMMED_HEIGHTS = PART_HEIGHTS + """,
fx9 as (select a.raster_id, a."row", a.col, sum(b.value) as value from fx1 a join fx1 b
 on b."row" between a."row" - 1 and a."row" + 1 and b.col between a.col - 1 and a.col + 1 group by all)"""


def part_surface(spark: SparkSession, sf: str) -> Mesh:
    return surface_mesh(part_heights(spark, sf), validate=False)


PART_SURFACE = PART_HEIGHTS + """,
fx5v as (select raster_id as mesh_id, ("row" * 50 + col)::bigint as vid, col::double as x, "row"::double as y, value as z from fx1),
fx5q as (select a.raster_id as mesh_id, (a."row" * 50 + a.col)::bigint as ul from fx1 a
 join fx1 b on b."row" = a."row" and b.col = a.col + 1
 join fx1 c on c."row" = a."row" + 1 and c.col = a.col
 join fx1 d on d."row" = a."row" + 1 and d.col = a.col + 1),
fx5t as (select mesh_id, ul * 2 as tid, ul as v0, ul + 1 as v1, ul + 50 as v2 from fx5q
 union all select mesh_id, ul * 2 + 1, ul + 1, ul + 51, ul + 50 from fx5q)"""


def nation_squares(spark: SparkSession, sf: str) -> DataFrame:
    """One square per nation with a square hole of growing size; no hole for every tenth."""
    n = table(spark, sf, "nation")
    x0, h = (F.col("n_nationkey") * 20).cast("double"), (F.col("n_nationkey") % 10).cast("double")

    def ring(side, role: str, i: int):
        corners = F.array(
            *[F.struct((x0 + side * a).alias("x"), (side * b).alias("y")) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))]
        )
        return n.select(
            F.col("n_nationkey").cast("long").alias("poly_id"),
            (F.col("n_nationkey") * 2 + i).cast("long").alias("ring_id"), F.lit(role).alias("role"),
            F.posexplode(corners).alias("seq", "p"), h.alias("h"),
        ).select("poly_id", "ring_id", "role", "seq", "p.x", "p.y", "h")

    outer = ring(F.lit(8.0), "exterior", 0).drop("h")
    return outer.unionByName(ring(h, "hole", 1).filter("h > 0").drop("h"))


NATION_SQUARES = """corner as (select * from (values (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1)) t(seq, a, b)),
fx6 as (select n_nationkey::bigint as poly_id, (n_nationkey * 2)::bigint as ring_id, 'exterior' as role, seq,
 (n_nationkey * 20 + 8 * a)::double as x, (8 * b)::double as y from nation, corner
 union all select n_nationkey::bigint, (n_nationkey * 2 + 1)::bigint, 'hole', seq,
 (n_nationkey * 20 + (n_nationkey % 10) * a)::double, ((n_nationkey % 10) * b)::double from nation, corner
 where n_nationkey % 10 > 0),
fx6e as (select *, coalesce(lead(x) over w, first_value(x) over w) as nx, coalesce(lead(y) over w, first_value(y) over w) as ny
 from fx6 window w as (partition by poly_id, ring_id order by seq))"""


def levels(spark: SparkSession, values=LEVELS, **options) -> DataFrame:
    return levels_table(spark, list(values), **options)


# ---- SQL pieces ------------------------------------------------------------------------------


def levels_sql(values=LEVELS, name: str = "lv") -> str:
    rows = ", ".join(f"({i}, {v!r}::double)" for i, v in enumerate(values))
    return f"{name} as (select * from (values {rows}) t(level_idx, threshold))"


def blocks_sql(src: str) -> str:
    """All 2x2 blocks overlapping the grid, named by their upper-left cell."""
    def corner(alias: str, dr: int, dc: int) -> str:
        return f'left join {src} {alias} on {alias}."row" = p."row" + {dr} and {alias}.col = p.col + {dc}'

    return f"""dim as (select raster_id, max("row") as h, max(col) as w from {src} group by 1),
posr as (select raster_id, w, unnest(range(-1, h + 1)) as "row" from dim),
pos as (select raster_id, "row", unnest(range(-1, w + 1)) as col from posr),
blk as (select p.raster_id, p."row", p.col, a.value as ul, b.value as ur, c.value as ll, d.value as lr,
 (a.col is not null)::int + (b.col is not null)::int + (c.col is not null)::int + (d.col is not null)::int as inside
 from pos p {corner('a', 0, 0)} {corner('b', 0, 1)} {corner('c', 1, 0)} {corner('d', 1, 1)}),
cs as (select b.*, l.level_idx, l.threshold, coalesce(ul >= threshold, false)::int + coalesce(ur >= threshold, false)::int * 2
 + coalesce(ll >= threshold, false)::int * 4 + coalesce(lr >= threshold, false)::int * 8 as k from blk b cross join lv l)"""


def segments_sql(src: str, saddles: str = "low") -> str:
    """Directed segments ``seg`` with point keys ``a``/``b`` and the high cell at the start."""
    cases = SEGMENT_TABLE | (SADDLES_JOINED if saddles == "high" else {})
    rows = []
    for k, segs in cases.items():
        for s, e in segs:
            high = CORNER_OFFSET[next(c for c in SIDE_CORNERS[s] if k & c)]
            rows.append(str((k, *SIDE_OFFSET[s], *SIDE_OFFSET[e], high[0] // 2, high[1] // 2)))
    return blocks_sql(src) + f""",
segt as (select * from (values {', '.join(rows)}) t(k, ax, ay, bx, bye, hc, hr)),
seg as (select raster_id, level_idx, threshold, (col * 2 + ax)::int as x1, ("row" * 2 + ay)::int as y1,
 (col * 2 + bx)::int as x2, ("row" * 2 + bye)::int as y2, "row" + hr as hrow, col + hc as hcol,
 ("row" * 2 + ay + 4)::bigint * 4294967296 + col * 2 + ax + 4 as a,
 ("row" * 2 + bye + 4)::bigint * 4294967296 + col * 2 + bx + 4 as b from cs join segt using (k))"""


def rings_sql() -> str:
    """Ring and place of every segment of ``seg`` by walking round."""
    return """ringmin(level_idx, a, m) using key (level_idx, a) as (
 select level_idx, a, a from seg
 union select s.level_idx, s.a, n.m from ringmin n join seg s on s.level_idx = n.level_idx and s.b = n.a
 join recurring.ringmin o on o.level_idx = s.level_idx and o.a = s.a where n.m < o.m),
walk(level_idx, ring_id, a, seq) as (
 select level_idx, m, a, 0::bigint from ringmin where a = m
 union all select w.level_idx, w.ring_id, s.b, w.seq + 1 from walk w join seg s on s.level_idx = w.level_idx and s.a = w.a
 where s.b <> w.ring_id),
ring as (select s.*, w.ring_id, w.seq from walk w join seg s using (level_idx, a))"""


def regions_sql(src: str, connectivity: int = 4, name: str = "reg") -> str:
    """Smallest cell key of every high cell's region, by passing labels to neighbours."""
    near = "abs(n.r - s.r) + abs(n.c - s.c) = 1" if connectivity == 4 else "(n.r <> s.r or n.c <> s.c)"
    return f"""hc as (select level_idx, "row" as r, col as c, ("row" + 1)::bigint * 4294967296 + col + 1 as id
 from {src} join lv on value >= threshold),
adj as (select s.level_idx, s.id as a, n.id as b from hc s join hc n on n.level_idx = s.level_idx
 and n.r between s.r - 1 and s.r + 1 and n.c between s.c - 1 and s.c + 1 and {near}),
{name}(level_idx, id, region) using key (level_idx, id) as (
 select level_idx, id, id from hc
 union select j.level_idx, j.a, min(n.region) from {name} n join adj j on j.level_idx = n.level_idx and j.b = n.id
 join recurring.{name} o on o.level_idx = j.level_idx and o.id = j.a where n.region < o.region group by j.level_idx, j.a)"""


def fill_sql() -> str:
    """Triangles of the high part of every block."""
    rows = []
    for k, parts in FILL_TABLE.items():
        n = 0
        for part in parts:
            for i in range(1, len(part) - 1):
                pts = [POINT_OFFSET[c] for c in (part[0], part[i], part[i + 1])]
                rows.append(str((k, n, *[v for p in pts for v in p])))
                n += 1
    return f"""fillt as (select * from (values {', '.join(rows)}) t(k, n, ax, ay, bx, bye, cx, cy)),
tri as (select raster_id, level_idx, (("row" + 1)::bigint * 2147483648 + col + 1) * 4 + n as tid,
 (col * 2 + ax)::int as x0, ("row" * 2 + ay)::int as y0, (col * 2 + bx)::int as x1, ("row" * 2 + bye)::int as y1,
 (col * 2 + cx)::int as x2, ("row" * 2 + cy)::int as y2 from cs join fillt using (k))"""


def with_(*ctes: str, recursive: bool = False) -> str:
    return ("with recursive " if recursive else "with ") + ",\n".join(ctes) + "\n"
