"""Queries on meshes."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.fixtures import (
    LEVELS, NATION_SQUARES, PART_HEIGHTS, PART_SURFACE, SUMMED_HEIGHTS, SUM_LEVELS, blocks_sql, fill_sql, levels,
    levels_sql, nation_squares, part_heights, part_surface, regions_sql, segments_sql, summed_heights, with_,
)
from reliefgrid.config import CleanupSettings, ContourSettings, HeightmapSettings, MeshSettings, TriangulationSettings
from reliefgrid.operators import cleanup as X
from reliefgrid.operators import inspect as I
from reliefgrid.operators import mesh as M
from reliefgrid.operators import triangulate as T
from reliefgrid.operators.crossings import crossing_triangles
from reliefgrid.operators.mesh import Mesh
from reliefgrid.operators.nearest import nearest_vertices, outline_edges
from reliefgrid.operators.polygons import faces_of_polygons, polygon_measures, with_next
from reliefgrid.plans import pipelines as E
from reliefgrid.runtime import scratch_path
from reliefgrid.sources import mesh_files as W


@query("M1", with_(PART_SURFACE) + "select * from fx5v")
def surface_vertices(spark, sf):
    return part_surface(spark, sf).vertices


@query("M1 J4", with_(PART_SURFACE) + "select * from fx5t")
def surface_triangles(spark, sf):
    return part_surface(spark, sf).triangles


@query("M2", with_(NATION_SQUARES) + "select poly_id, ring_id, role, seq::int as seq, x, y from fx6")
def boundary_points(spark, sf):
    return T.boundary_points(nation_squares(spark, sf))


_INNER = """pm as (select n_nationkey::bigint as poly_id, (n_nationkey*20)::double as x0, n_nationkey % 10 as h from nation where (n_nationkey % 10) * (n_nationkey % 10) < 64),
st as (select *, sqrt((64 - h*h)/100.0::double) as s from pm),
gi as (select *, x0 + s/2 + i*s as x from st, range(0, 400) t(i)),
gp as (select gi.*, s/2 + j*s as y, j from gi, range(0, 400) u(j) where x < x0 + 8)"""


@query("M3", with_(_INNER) + """select poly_id, i::bigint as i, j::bigint as j, round(x, 6) as x, round(y, 6) as y from gp
 where y < 8 and not (x <= x0 + h and y <= h)""")
def interior_points(spark, sf):
    p = T.interior_points(nation_squares(spark, sf))
    return p.select("poly_id", "i", "j", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("M4 M5 J6")
def delaunay_faces(spark, sf):
    squares = nation_squares(spark, sf)
    solid = polygon_measures(squares).filter("area > 0").select("poly_id")  # a hole may leave nothing of a square
    cover, _ = T.triangulate_polygons(squares.join(solid, "poly_id", "left_semi"), check_valid=False)
    return cover.triangles


def _fills(src: str, fixture: str, values) -> tuple[str, ...]:
    return (fixture, levels_sql(values), blocks_sql(src), fill_sql())


@query("M6", with_(*_fills("fx1", PART_HEIGHTS, LEVELS)) +
       "select raster_id, level_idx::int as level_idx, tid, x0, y0, x1, y1, x2, y2 from tri")
def grid_triangles(spark, sf):
    return M.triangulate_grid(part_heights(spark, sf), levels(spark))


_COVER = """tv as (select distinct level_idx, x, y from (select level_idx, unnest([x0, x1, x2]) as x, unnest([y0, y1, y2]) as y from tri))"""


@query("M10", with_(*_fills("fx9", SUMMED_HEIGHTS, (230.0,)), _COVER) +
       "select 'part/0' as mesh_id, ((y + 4)::bigint*4294967296 + x + 4)::bigint as vid, x/2.0::double as x, y/2.0::double as y, 1.5::double as z from tv")
def flat_mesh_vertices(spark, sf):
    return E.flat_mesh(summed_heights(spark, sf), 1.5, use_contours=True, threshold=230.0).vertices


_TOP = 4611686018427387904


def _solid_sql(src: str, fixture: str, values, base: str) -> tuple[str, ...]:
    key = "((y{i} + 4)::bigint*4294967296 + x{i} + 4)"
    k = [key.replace("{i}", str(i)) for i in range(3)]
    return (
        fixture, levels_sql(values), segments_sql(src), fill_sql(), _COVER,
        f"""sv as (select 'part/' || level_idx as mesh_id, (y + 4)::bigint*4294967296 + x + 4 as vid, x/2.0::double as x, y/2.0::double as y, {base} as z from tv
 union all select 'part/' || level_idx, (y + 4)::bigint*4294967296 + x + 4 + {_TOP}, x/2.0::double, y/2.0::double, {base} + 0.5::double from tv)""",
        f"""st as (select 'part/' || level_idx as mesh_id, tid*4 as tid, {k[2]} as v0, {k[1]} as v1, {k[0]} as v2 from tri
 union all select 'part/' || level_idx, tid*4 + 1, {k[0]} + {_TOP}, {k[1]} + {_TOP}, {k[2]} + {_TOP} from tri
 union all select 'part/' || level_idx, a*4 + 2, a, b, b + {_TOP} from seg
 union all select 'part/' || level_idx, a*4 + 3, a, b + {_TOP}, a + {_TOP} from seg)""",
    )


@query("M7 M11", with_(*_solid_sql("fx9", SUMMED_HEIGHTS, SUM_LEVELS, "level_idx*0.5::double")) + "select * from sv")
def solid_vertices(spark, sf):
    return M.grid_solid(summed_heights(spark, sf), levels(spark, SUM_LEVELS), 0.5).vertices


@query("M7 M8 M11 J5", with_(*_solid_sql("fx9", SUMMED_HEIGHTS, SUM_LEVELS, "level_idx*0.5::double")) + "select * from st")
def solid_triangles(spark, sf):
    return M.grid_solid(summed_heights(spark, sf), levels(spark, SUM_LEVELS), 0.5).triangles


@query("M9", with_(PART_SURFACE) + """select distinct mesh_id, v as vid from (select mesh_id, unnest([v0, v1, v2]) as v from fx5t) where v % 7 = 0""")
def missing_corners(spark, sf):
    m = part_surface(spark, sf)
    return M.missing_corners(Mesh(m.vertices.filter("vid % 7 <> 0"), m.triangles))


@query("M12", with_(SUMMED_HEIGHTS, "lv as (select 0 as level_idx, (min(value) + max(value))/2 as threshold from fx9)", segments_sql("fx9"), fill_sql(), _COVER) +
       """select 'part/0' as mesh_id, (select count(*)*2 from tv)::bigint as num_vertices, (select count(*)*2 from tri)::bigint + (select count(*)*2 from seg)::bigint as num_triangles""")
def contour_mesh_at_middle(spark, sf):
    return I.mesh_info(E.contour_mesh(summed_heights(spark, sf))).select("mesh_id", "num_vertices", "num_triangles")


_COMBINED = """cv as (select distinct 'part' as mesh_id, x, y, z from sv),
ct as (select count(*) as n from st)"""


@query("M13 X7 X5 E2", with_(*_solid_sql("fx9", SUMMED_HEIGHTS, SUM_LEVELS, "level_idx*0.5::double"), _COMBINED) +
       "select mesh_id, x, y, z, count(*)::bigint as vertices from cv group by all")
def stacked_levels(spark, sf):
    m = E.multi_level_mesh(summed_heights(spark, sf), SUM_LEVELS, thickness=0.5)
    return m.vertices.groupBy("mesh_id", "x", "y", "z").agg(F.count("*").alias("vertices"))


@query("M14 M1", with_(PART_SURFACE) + "select mesh_id, count(*)::bigint as triangles, (select count(*) from fx5v)::bigint as vertices from fx5t group by 1")
def mesh_by_type(spark, sf):
    m = E.make_mesh(part_heights(spark, sf), "surface")
    t = m.triangles.groupBy("mesh_id").agg(F.count("*").alias("triangles"))
    return t.join(m.vertices.groupBy("mesh_id").agg(F.count("*").alias("vertices")), "mesh_id")


_CORNERS = """fc as (select t.mesh_id, t.tid, t.v0, t.v1, t.v2, a.x as x0, a.y as y0, a.z as z0, b.x as x1, b.y as y1, b.z as z1, c.x as x2, c.y as y2, c.z as z2
 from fx5t t join fx5v a on a.vid = t.v0 join fx5v b on b.vid = t.v1 join fx5v c on c.vid = t.v2),
fn as (select *, (y1-y0)*(z2-z0) - (z1-z0)*(y2-y0) as cx, (z1-z0)*(x2-x0) - (x1-x0)*(z2-z0) as cy, (x1-x0)*(y2-y0) - (y1-y0)*(x2-x0) as cz from fc),
fl as (select *, sqrt(cx*cx + cy*cy + cz*cz) as n from fn)"""


@query("M16 J7", with_(PART_SURFACE, _CORNERS) +
       "select mesh_id, tid, round(cx/n, 6) as nx, round(cy/n, 6) as ny, round(cz/n, 6) as nz, round(n/2, 6) as area from fl")
def triangle_normals(spark, sf):
    n = M.triangle_normals(part_surface(spark, sf))
    return n.select("mesh_id", "tid", *[F.round(c, 6).alias(c) for c in ("nx", "ny", "nz", "area")])


@query("M15 A8", with_(PART_SURFACE, _CORNERS, "vs as (select mesh_id, v as vid, sum(cx) as sx, sum(cy) as sy, sum(cz) as sz from "
                       "(select mesh_id, unnest([v0, v1, v2]) as v, cx, cy, cz from fl) group by all)") +
       "select mesh_id, vid, x, y, z, round(sx/sqrt(sx*sx+sy*sy+sz*sz), 6) as nx, round(sy/sqrt(sx*sx+sy*sy+sz*sz), 6) as ny, "
       "round(sz/sqrt(sx*sx+sy*sy+sz*sz), 6) as nz from fx5v join vs using (mesh_id, vid)")
def vertex_normals(spark, sf):
    v = M.vertex_normals(part_surface(spark, sf))
    return v.withColumns({c: F.round(c, 6) for c in ("nx", "ny", "nz")})


@query("J5", with_(PART_SURFACE, "pt as (select c_custkey as pid, (c_custkey*37 % 640)/8.0::double - 10 as x, (c_custkey*91 % 1720)/8.0::double - 80 as y from customer)",
                   "dd as (select pid, vid, (pt.x - v.x)*(pt.x - v.x) + (pt.y - v.y)*(pt.y - v.y) as d2 from pt, fx5v v)") +
       "select 'part' as mesh_id, pid, min({'d': d2, 'v': vid}).v as vid, round(sqrt(min(d2)), 6) as distance from dd group by pid")
def nearest_to_customers(spark, sf):
    k = F.col("c_custkey")
    points = spark.read.parquet(f"{sf}/customer.parquet").select(
        F.lit("part").alias("mesh_id"), k.alias("pid"), ((k * 37 % 640) / 8.0 - 10).alias("x"), ((k * 91 % 1720) / 8.0 - 80).alias("y")
    )
    return nearest_vertices(points, part_surface(spark, sf).vertices).withColumn("distance", F.round("distance", 6))


@query("J5 M8", with_(PART_SURFACE, NATION_SQUARES, "pp as (select x/10 + 0.3::double as x, y*4 + 0.2::double as y, nx/10 + 0.3::double as nx, ny*4 + 0.2::double as ny from fx6e where role = 'exterior')",
                      "pl as (select x, y from pp union select nx, ny from pp)",
                      "nv as (select pl.x, pl.y, min({'d': (pl.x - v.x)*(pl.x - v.x) + (pl.y - v.y)*(pl.y - v.y), 'v': vid}).v as vid from pl, fx5v v group by all)",
                      "eg as (select distinct a.vid as a, b.vid as b from pp join nv a on a.x = pp.x and a.y = pp.y join nv b on b.x = pp.nx and b.y = pp.ny where a.vid <> b.vid)") +
       f"select 'part' as mesh_id, a*4 + 2 as tid, a as v0, b as v1, b + {_TOP} as v2 from eg union all select 'part', a*4 + 3, a, b + {_TOP}, a + {_TOP} from eg")
def walls_on_squares(spark, sf):
    ends = with_next(nation_squares(spark, sf).filter("role = 'exterior'"))
    outline = ends.select(F.lit("part").alias("mesh_id"), *[(F.col(c) / 10 + 0.3).alias(c) for c in ("x", "nx")], *[(F.col(c) * 4 + 0.2).alias(c) for c in ("y", "ny")])
    return M.side_walls(outline_edges(outline, part_surface(spark, sf)))


def _flagged(spark, sf) -> Mesh:
    """The surface and, per supplier, one upright triangle of its own: some pierce it, some hang above, some cross each other."""
    m = part_surface(spark, sf)
    k = F.col("s_suppkey")
    x, y, z = (k * 7 % 48) + 0.25, (k * 3 % 36) + 0.5, (k * 11 % 80).cast("double")
    corner = F.array(*[F.struct(F.lit(i).alias("i"), (x + a).alias("x"), (y + b).alias("y"), (z + c).alias("z")) for i, (a, b, c) in enumerate(((0, 0, 0), (0.5, 0.25, 0), (0.25, 0, 20)))])
    flags = spark.read.parquet(f"{sf}/supplier.parquet")
    v = flags.select(F.lit("part").alias("mesh_id"), k.alias("k"), F.inline(corner)).select("mesh_id", (F.col("k") * 3 + F.col("i") + 10_000_000).cast("long").alias("vid"), "x", "y", "z")
    t = flags.select(F.lit("part").alias("mesh_id"), (k + 10_000_000).cast("long").alias("tid"), *[(k * 3 + i + 10_000_000).cast("long").alias(f"v{i}") for i in range(3)])
    return Mesh(m.vertices.unionByName(v), m.triangles.unionByName(t))


def _cross_sql(p: tuple[str, str, str], q: tuple[str, str, str]) -> tuple[str, str, str]:
    return tuple(f"({p[i]}*{q[j]} - {p[j]}*{q[i]})" for i, j in ((1, 2), (2, 0), (0, 1)))


def _apart_sql() -> str:
    """Directions that may part two triangles ``a`` and ``b``, as a list of structs over their sides ``ea..`` and ``eb..``."""
    side = {s: [tuple(f"e{s}{i}{c}" for c in "xyz") for i in range(3)] for s in "ab"}
    normal = {s: tuple(f"n{s}{c}" for c in "xyz") for s in "ab"}
    axes = [normal["a"], normal["b"], *[_cross_sql(p, q) for p in side["a"] for q in side["b"]], *[_cross_sql(normal[s], e) for s in "ab" for e in side[s]]]
    return "[" + ", ".join("{'x': %s, 'y': %s, 'z': %s}" % a for a in axes) + "]"


_CROSSINGS = (
    """gv as (select vid, x, y, z from fx5v union all select s_suppkey*3 + i + 10000000, (s_suppkey*7 % 48) + 0.25::double + a, (s_suppkey*3 % 36) + 0.5::double + b, (s_suppkey*11 % 80)::double + c
 from supplier, (values (0, 0.0::double, 0.0::double, 0), (1, 0.5, 0.25, 0), (2, 0.25, 0.0, 20)) w(i, a, b, c))""",
    "gt as (select tid, v0, v1, v2 from fx5t union all select s_suppkey + 10000000, s_suppkey*3 + 10000000, s_suppkey*3 + 10000001, s_suppkey*3 + 10000002 from supplier)",
    "gc as (select tid, v0, v1, v2, " + ", ".join(f"{k}.{c} as p{i}{c}" for i, k in enumerate("abc") for c in "xyz")
    + " from gt join gv a on a.vid = v0 join gv b on b.vid = v1 join gv c on c.vid = v2)",
    "gb as (select *, " + ", ".join(f"{f}(p0{c}, p1{c}, p2{c}) as {e}{c}" for e, f in (("lo", "least"), ("hi", "greatest")) for c in "xyz") + " from gc)",
    "cd as (select a.tid as ta, b.tid as tb, " + ", ".join(f"{s}.p{i}{c} - a.p0{c} as {s}{i}{c}" for s in "ab" for i in range(3) for c in "xyz")
    + " from gb a join gb b on a.tid < b.tid and b.tid >= 10000000 and " + " and ".join(f"a.lo{c} <= b.hi{c} and b.lo{c} <= a.hi{c}" for c in "xyz")
    + " where len(list_intersect([a.v0, a.v1, a.v2], [b.v0, b.v1, b.v2])) = 0)",
    "es as (select *, " + ", ".join(f"{s}{(i + 1) % 3}{c} - {s}{i}{c} as e{s}{i}{c}" for s in "ab" for i in range(3) for c in "xyz") + " from cd)",
    "ns as (select *, " + ", ".join(f"{v} as n{s}{c}" for s in "ab" for c, v in zip("xyz", _cross_sql(tuple(f"e{s}0{c}" for c in "xyz"), tuple(f"e{s}1{c}" for c in "xyz")))) + " from es)",
    f"ax as (select *, unnest({_apart_sql()}) as n from ns)",
    "dp as (select ta, tb, " + ", ".join(f"{s}{i}x*n.x + {s}{i}y*n.y + {s}{i}z*n.z as {s}{i}" for s in "ab" for i in range(3)) + " from ax)",
)


@query("X11", with_(PART_SURFACE, *_CROSSINGS) +
       """select 'part' as mesh_id, ta::bigint as a, tb::bigint as b from dp group by ta, tb
 having not bool_or(greatest(a0, a1, a2) < least(b0, b1, b2) or greatest(b0, b1, b2) < least(a0, a1, a2))""")
def crossing_flags(spark, sf):
    return crossing_triangles(_flagged(spark, sf))


def _bands(spark, sf) -> Mesh:
    """Per supplier a closed strip of squares, every other one with half a turn, some of whose triangles are turned over."""
    k = F.col("s_suppkey")
    n = (k % 6 + 3).cast("long")
    s = spark.read.parquet(f"{sf}/supplier.parquet").select(F.concat(F.lit("band "), k).alias("mesh_id"), k.alias("k"), n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("i"))
    v = s.withColumn("j", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    v = v.select("mesh_id", (F.col("i") * 2 + F.col("j")).alias("vid"), F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y"), F.lit(0.0).alias("z"))
    last, twist = F.col("i") == F.col("n") - 1, F.col("k") % 2
    a, b = F.col("i") * 2, F.col("i") * 2 + 1
    c, d = F.when(last, twist).otherwise(F.col("i") * 2 + 2), F.when(last, 1 - twist).otherwise(F.col("i") * 2 + 3)
    faces = F.array(*[F.struct((F.col("i") * 2 + j).alias("tid"), p.alias("p"), q.alias("q"), r.alias("r")) for j, (p, q, r) in enumerate(((a, b, c), (c, b, d)))])
    t = s.select("mesh_id", "k", F.inline(faces))
    over = (F.col("k") * (F.col("tid") + 1)) % 3 == 0
    t = t.select("mesh_id", "tid", F.when(over, F.col("r")).otherwise(F.col("p")).alias("v0"), F.col("q").alias("v1"), F.when(over, F.col("p")).otherwise(F.col("r")).alias("v2"))
    return Mesh(v, t)


_BANDS = (
    "bs as (select 'band ' || s_suppkey as mesh_id, s_suppkey as k, s_suppkey % 6 + 3 as n, unnest(range(0, s_suppkey % 6 + 3)) as i from supplier)",
    "bc as (select mesh_id, k, i, i*2 as a, i*2 + 1 as b, case when i = n - 1 then k % 2 else i*2 + 2 end as c, case when i = n - 1 then 1 - k % 2 else i*2 + 3 end as d from bs)",
    "bf as (select mesh_id, k, i*2 as tid, a as p, b as q, c as r from bc union all select mesh_id, k, i*2 + 1, c, b, d from bc)",
    "bt as (select mesh_id, tid, case when k*(tid + 1) % 3 = 0 then r else p end as v0, q as v1, case when k*(tid + 1) % 3 = 0 then p else r end as v2 from bf)",
    "be as (select mesh_id, tid, v0 as p, v1 as q from bt union all select mesh_id, tid, v1, v2 from bt union all select mesh_id, tid, v2, v0 from bt)",
    "bl as (select x.mesh_id, x.tid as t, y.tid as u, case when x.p = y.q then 1 else -1 end as s from be x join be y on x.mesh_id = y.mesh_id and x.tid <> y.tid and least(x.p, x.q) = least(y.p, y.q) and greatest(x.p, x.q) = greatest(y.p, y.q))",
    "br as (select mesh_id, min(tid) as tid, 1 as s from bt group by mesh_id union select bl.mesh_id, bl.u, br.s * bl.s from br join bl on bl.mesh_id = br.mesh_id and bl.t = br.tid)",
)


@query("X11", with_(*_BANDS, recursive=True) + "select mesh_id, bool_and(w = 1) as is_orientable from (select mesh_id, tid, count(distinct s) as w from br group by all) group by mesh_id")
def orientable_bands(spark, sf):
    return I.mesh_info(_bands(spark, sf)).select("mesh_id", "is_orientable")


# ---- cleanup ---------------------------------------------------------------------------------


def _dirty(spark, sf) -> Mesh:
    """The surface with faces that name a vertex twice, repeated faces and unused vertices."""
    m = part_surface(spark, sf)
    t, tenth = m.triangles, m.triangles.filter("tid % 10 = 0")
    t = (
        t.unionByName(tenth.select("mesh_id", (F.col("tid") + 10_000_000).alias("tid"), "v0", F.col("v0").alias("v1"), "v2"))
        .unionByName(tenth.select("mesh_id", (F.col("tid") + 20_000_000).alias("tid"), F.col("v1").alias("v0"), F.col("v2").alias("v1"), F.col("v0").alias("v2")))
        .unionByName(tenth.select("mesh_id", (F.col("tid") + 30_000_000).alias("tid"), "v0", "v1", "v2"))
        .unionByName(tenth.select("mesh_id", (F.col("tid") + 40_000_000).alias("tid"), F.col("v2").alias("v0"), "v1", F.col("v0").alias("v2")))
    )
    spare = m.vertices.filter("vid % 9 = 0").select("mesh_id", (F.col("vid") + 10_000_000).alias("vid"), "x", "y", (F.col("z") + 1000).alias("z"))
    return Mesh(m.vertices.unionByName(spare), t)


_DIRTY = PART_SURFACE + """,
dv as (select * from fx5v union all select mesh_id, vid + 10000000, x, y, z + 1000 from fx5v where vid % 9 = 0),
dt as (select * from fx5t union all select mesh_id, tid + 10000000, v0, v0, v2 from fx5t where tid % 10 = 0
 union all select mesh_id, tid + 20000000, v1, v2, v0 from fx5t where tid % 10 = 0
 union all select mesh_id, tid + 30000000, v0, v1, v2 from fx5t where tid % 10 = 0
 union all select mesh_id, tid + 40000000, v2, v1, v0 from fx5t where tid % 10 = 0)"""


def _doubled(spark, sf) -> Mesh:
    """Two copies of the surface, the second next to the first by 0 or 1e-7 in x."""
    m = part_surface(spark, sf)
    v = m.vertices.withColumn("mesh_id", F.lit("a"))
    w = m.vertices.select(F.lit("b").alias("mesh_id"), "vid", (F.col("x") + (F.col("vid") % 2) * 1e-7).alias("x"), "y", "z")
    t = m.triangles.withColumn("mesh_id", F.lit("a")).unionByName(m.triangles.withColumn("mesh_id", F.lit("b")))
    return Mesh(v.unionByName(w), t)


_DOUBLED = PART_SURFACE + """,
bv as (select 'a' as mesh_id, vid, x, y, z from fx5v union all select 'b', vid, x + (vid % 2)*1e-7::double, y, z from fx5v)"""


@query("X1", with_(_DIRTY) + "select * from dt where v0 <> v1 and v1 <> v2 and v0 <> v2")
def degenerate_removed(spark, sf):
    return X.remove_degenerate(_dirty(spark, sf)).triangles


@query("X1", with_(_DIRTY) + "select * from dt where v0 <> v1 and v1 <> v2 and v0 <> v2")
def degenerate_removed_by_area(spark, sf):
    return X.remove_degenerate(_dirty(spark, sf), by="area").triangles


@query("X2 U3", with_(_DOUBLED, "one as (select 'both' as mesh_id, case mesh_id when 'a' then vid else vid + 1000000000 end as vid, x, y, z from bv)") +
       "select mesh_id, min(vid) as vid, x, y, z from one group by mesh_id, x, y, z")
def duplicate_vertices_removed(spark, sf):
    return X.remove_duplicate_vertices(_one_mesh(_doubled(spark, sf))).vertices


def _one_mesh(m: Mesh) -> Mesh:
    shift = F.when(F.col("mesh_id") == "b", 1_000_000_000).otherwise(0)
    v = m.vertices.select(F.lit("both").alias("mesh_id"), (F.col("vid") + shift).alias("vid"), "x", "y", "z")
    t = m.triangles.select(F.lit("both").alias("mesh_id"), (F.col("tid") + shift).alias("tid"), *[(F.col(c) + shift).alias(c) for c in ("v0", "v1", "v2")])
    return Mesh(v, t)


@query("X2 J7", with_(_DOUBLED, "one as (select case mesh_id when 'a' then vid else vid + 1000000000 end as vid, x, y, z from bv)",
                      "keep as (select vid, min(vid) over (partition by x, y, z) as k from one)",
                      "bt as (select tid, v0, v1, v2 from fx5t union all select tid + 1000000000, v0 + 1000000000, v1 + 1000000000, v2 + 1000000000 from fx5t)") +
       "select 'both' as mesh_id, tid, a.k as v0, b.k as v1, c.k as v2 from bt join keep a on a.vid = v0 join keep b on b.vid = v1 join keep c on c.vid = v2")
def triangles_of_merged_vertices(spark, sf):
    return X.remove_duplicate_vertices(_one_mesh(_doubled(spark, sf))).triangles


_CANON = """select mesh_id, tid, v0, v1, v2, case when v0 <= v1 and v0 <= v2 then [v0, v1, v2] when v1 <= v0 and v1 <= v2 then [v1, v2, v0] else [v2, v0, v1] end as k from {src}"""


@query("X3 U3", with_(_DIRTY, f"k as ({_CANON.format(src='dt')})") +
       "select mesh_id, tid, v0, v1, v2 from (select *, row_number() over (partition by mesh_id, k order by tid) as n from k) where n = 1")
def duplicate_triangles_removed(spark, sf):
    return X.remove_duplicate_triangles(_dirty(spark, sf)).triangles


@query("X3", with_(_DIRTY) + "select mesh_id, tid, v0, v1, v2 from (select *, row_number() over (partition by mesh_id, list_sort([v0, v1, v2]) order by tid) as n from dt) where n = 1")
def duplicate_triangles_either_way(spark, sf):
    return X.remove_duplicate_triangles(_dirty(spark, sf), ignore_orientation=True).triangles


@query("X4 J8", with_(_DIRTY) + "select * from dv where vid in (select unnest([v0, v1, v2]) from dt)")
def unreferenced_removed(spark, sf):
    return X.remove_unreferenced(_dirty(spark, sf)).vertices


@query("X5 J10", with_(_DOUBLED) + "select 'both' as mesh_id, vid, round((x + x + (vid % 2)*1e-7::double)/2, 9) as x, y, z from fx5v")
def close_vertices_merged(spark, sf):
    m = X.merge_close_vertices(_one_mesh(_doubled(spark, sf)), 1e-6)
    return m.vertices.withColumn("x", F.round("x", 9))


@query("X6", with_(_DIRTY, f"k as ({_CANON.format(src='dt')} where v0 <> v1 and v1 <> v2 and v0 <> v2)") +
       "select mesh_id, tid, v0, v1, v2 from (select *, row_number() over (partition by mesh_id, k order by tid) as n from k) where n = 1")
def cleaned_triangles(spark, sf):
    return X.clean_mesh(_dirty(spark, sf)).triangles


@query("X6 X4", with_(_DIRTY) + "select * from fx5v")
def cleaned_vertices(spark, sf):
    return X.clean_mesh(_dirty(spark, sf)).vertices


@query("X7 U1 A12", with_(_DOUBLED) + "select 'combined' as mesh_id, vid, round((x + x + (vid % 2)*1e-7::double)/2, 9) as x, y, z from fx5v")
def combined_vertices(spark, sf):
    m = X.combine_meshes(_doubled(spark, sf))
    return m.vertices.withColumn("x", F.round("x", 9))


@query("A12", with_(_DOUBLED) + "select mesh_id, count(*)::bigint as vertices, (coalesce(sum(count(*)) over (order by mesh_id rows between unbounded preceding and 1 preceding), 0))::bigint as first_vertex from bv group by mesh_id")
def vertex_offsets(spark, sf):
    return X.vertex_offsets(_doubled(spark, sf))


@query("X8", with_(_DOUBLED) + "select 'both' as mesh_id, count(*)::bigint as num_vertices, (select count(*) from fx5t)::bigint as num_triangles from fx5v")
def quick_cleanup(spark, sf):
    m = X.quick_cleanup(_one_mesh(_doubled(spark, sf)))
    m = X.remove_duplicate_triangles(m)
    return I.mesh_info(m).select("mesh_id", "num_vertices", "num_triangles")


@query("X9", with_(PART_SURFACE) + "select mesh_id, min(vid) as vid, round(avg(x), 6) as x, round(avg(y), 6) as y, round(avg(z), 6) as z from fx5v group by mesh_id, floor(x/4), floor(y/4), floor(z/4)")
def clustered_vertices(spark, sf):
    v = X.cluster_vertices(part_surface(spark, sf), 4.0).vertices
    return v.withColumns({c: F.round(c, 6) for c in ("x", "y", "z")})


@query("X9", with_(PART_SURFACE, "cv as (select vid, min(vid) over (partition by floor(x/4), floor(y/4), floor(z/4)) as k from fx5v)",
                   "t as (select mesh_id, tid, a.k as v0, b.k as v1, c.k as v2 from fx5t join cv a on a.vid = v0 join cv b on b.vid = v1 join cv c on c.vid = v2)",
                   f"k as ({_CANON.format(src='t')} where v0 <> v1 and v1 <> v2 and v0 <> v2)") +
       "select mesh_id, tid, v0, v1, v2 from (select *, row_number() over (partition by mesh_id, k order by tid) as n from k) where n = 1")
def clustered_triangles(spark, sf):
    return X.cluster_vertices(part_surface(spark, sf), 4.0).triangles


@query("X10")
def decimated_triangles(spark, sf):
    m = part_surface(spark, sf)
    return X.decimate_to(m, 800).triangles


_INFO = """ed as (select mesh_id, least(p, q) as a, greatest(p, q) as b, count(*) as uses, count(*) filter (p < q) as fw from
 (select mesh_id, v0 as p, v1 as q from {t} union all select mesh_id, v1, v2 from {t} union all select mesh_id, v2, v0 from {t}) group by all),
ei as (select mesh_id, bool_and(uses = 2) as is_watertight, bool_and(fw <= 1 and uses - fw <= 1) as is_orientable from ed group by 1),
vi as (select mesh_id, count(*)::bigint as num_vertices, min(x) as min_x, min(y) as min_y, min(z) as min_z, max(x) as max_x, max(y) as max_y, max(z) as max_z from {v} group by 1),
ti as (select mesh_id, count(*)::bigint as num_triangles from {t} group by 1)
select mesh_id, num_vertices, num_triangles, is_watertight, is_orientable, min_x, min_y, min_z, max_x, max_y, max_z from vi join ti using (mesh_id) join ei using (mesh_id)"""


def _info(mesh: Mesh):
    i = I.mesh_info(mesh)
    bounds = [
        F.col(f"bounding_box_{e}")[k].alias(f"{e}_{c}") for e in ("min", "max") for k, c in enumerate("xyz")
    ]
    return i.select("mesh_id", "num_vertices", "num_triangles", "is_watertight", "is_orientable", *bounds)


@query("X11 A7 A9", with_(PART_SURFACE) .rstrip() + ",\n" + _INFO.format(v="fx5v", t="fx5t"))
def surface_info(spark, sf):
    return _info(part_surface(spark, sf))


@query("X11 M11 A7", with_(*_solid_sql("fx9", SUMMED_HEIGHTS, SUM_LEVELS, "level_idx*0.5::double")).rstrip() + ",\n" + _INFO.format(v="sv", t="st"))
def solid_info(spark, sf):
    return _info(M.grid_solid(summed_heights(spark, sf), levels(spark, SUM_LEVELS), 0.5))


@query("X11", with_(PART_SURFACE) + "select mesh_id, vid, 1::bigint as fans from fx5v")
def vertex_fans(spark, sf):
    return I.vertex_fans(part_surface(spark, sf))


@query("X12", with_(_DIRTY, "c as (select (select count(*) from dv) a, (select count(*) from dt) b, (select count(*) from fx5v) c, "
                            "(select count(distinct case when v0 <= v1 and v0 <= v2 then [v0, v1, v2] when v1 <= v0 and v1 <= v2 then [v1, v2, v0] else [v2, v0, v1] end) from dt where v0 <> v1 and v1 <> v2 and v0 <> v2) d)") +
       "select 'part' as mesh_id, a::bigint as vertices_before, b::bigint as triangles_before, c::bigint as vertices_after, d::bigint as triangles_after, (a-c)::bigint as vertices_removed, (b-d)::bigint as triangles_removed from c")
def cleanup_report(spark, sf):
    m = _dirty(spark, sf)
    return I.cleanup_report(m, X.clean_mesh(m))


# ---- files -----------------------------------------------------------------------------------


@query("S7 J7", with_(PART_SURFACE, _CORNERS) +
       "select mesh_id, tid, round(cx/n, 6) as nx, round(cy/n, 6) as ny, round(cz/n, 6) as nz, x0, y0, z0, x1, y1, z1, x2, y2, z2 from fl")
def stl_facets(spark, sf):
    f = W.facets(part_surface(spark, sf))
    return f.withColumns({c: F.round(c, 6) for c in ("nx", "ny", "nz")})


def _local(path: str) -> str:
    return "/" + path.removeprefix("file:").lstrip("/")


def _read_lines(spark, mesh: Mesh, suffix: str):
    path = _local(scratch_path(spark, "mesh")) + suffix
    W.write_mesh(mesh, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("S9 S11 M14", with_(PART_SURFACE) + """select 'v ' || x || ' ' || y || ' ' || z as line from fx5v
 union all select 'f ' || (v0+1) || ' ' || (v1+1) || ' ' || (v2+1) from fx5t""")
def obj_file(spark, sf):
    return _read_lines(spark, part_surface(spark, sf), ".obj")


@query("S10 S11", with_(PART_SURFACE) + """select 'OFF' as line union all select (select count(*) from fx5v) || ' ' || (select count(*) from fx5t) || ' 0'
 union all select x || ' ' || y || ' ' || z from fx5v union all select '3 ' || v0 || ' ' || v1 || ' ' || v2 from fx5t""")
def off_file(spark, sf):
    return _read_lines(spark, part_surface(spark, sf), ".off")


@query("S8 S11", with_(PART_SURFACE) + """select unnest(['ply', 'format ascii 1.0', 'element vertex ' || (select count(*) from fx5v), 'property double x', 'property double y',
 'property double z', 'element face ' || (select count(*) from fx5t), 'property list uchar int vertex_indices', 'end_header']) as line
 union all select x || ' ' || y || ' ' || z from fx5v union all select '3 ' || v0 || ' ' || v1 || ' ' || v2 from fx5t""")
def ply_file(spark, sf):
    return _read_lines(spark, part_surface(spark, sf), ".ply")


@query("S7 S11", with_(PART_SURFACE) + "select (84 + 50*count(*))::bigint as length from fx5t")
def stl_file_size(spark, sf):
    path = _local(scratch_path(spark, "mesh")) + ".stl"
    W.write_mesh(part_surface(spark, sf), path)
    return spark.read.format("binaryFile").load(path).select("length")


# ---- whole jobs ------------------------------------------------------------------------------


@query("E2", with_(*_solid_sql("fx9", SUMMED_HEIGHTS, SUM_LEVELS, "level_idx*0.5::double"), _COMBINED) +
       "select mesh_id, x, y, z, count(*)::bigint as vertices from cv group by all")
def heights_to_mesh(spark, sf):
    every = ContourSettings(min_polygon_area=0.0, min_area_fraction=0.0)
    cfg = MeshSettings(heightmap=HeightmapSettings(thresholds=SUM_LEVELS), contour=every)
    v = E.heightmap_to_mesh(summed_heights(spark, sf), cfg).vertices
    return v.groupBy("mesh_id", "x", "y", "z").agg(F.count("*").alias("vertices"))


_LIFTED = SUMMED_HEIGHTS + """,
rng as (select min(value) as lo, max(value) as hi from fx9),
fxp as (select 'part' as raster_id, p."row"::int as "row", q.col::int as col, coalesce(f.value + (select lo*(-1.1::double) from rng), -5.0::double) as value
 from (select unnest(range(0, (select max("row") + 5 from fx9))) as "row") p cross join (select unnest(range(0, (select max(col) + 5 from fx9))) as col) q
 left join fx9 f on f."row" = p."row" - 2 and f.col = q.col - 2),
lv as (select i as level_idx, -4.5::double + (lo*(-1.1::double) + hi - (-4.5::double))*i/3 as threshold from rng, range(4) t(i))"""


@query("E3 S6 G4 G8", with_(_LIFTED, segments_sql("fxp"), fill_sql(), _COVER) +
       """select 'part' as mesh_id, (select count(*) from (select x, y, level_idx as z from tv union select x, y, level_idx + 1 from tv))::bigint as num_vertices,
       ((select count(*) from tri)*2 + (select count(*) from seg)*2)::bigint as num_triangles""")
def grid_to_mesh(spark, sf):
    cfg = MeshSettings(heightmap=HeightmapSettings(exterior_buffer_width=2, exterior_buffer_value=-5.0))
    return I.mesh_info(E.grid_to_mesh(summed_heights(spark, sf), 4, cfg)).select("mesh_id", "num_vertices", "num_triangles")


@query("E2 M4 C9 C13")
def heights_to_mesh_delaunay(spark, sf):
    cfg = MeshSettings(
        heightmap=HeightmapSettings(thresholds=SUM_LEVELS), triangulation=TriangulationSettings(method="delaunay"),
        cleanup=CleanupSettings(),
    )
    return I.mesh_info(E.heightmap_to_mesh(summed_heights(spark, sf), cfg))


_KEPT = """fc as (select *, case when x0 % 2 = 0 and y0 % 2 = 0 then (y0//2 + 1)::bigint*4294967296 + x0//2 + 1 when x1 % 2 = 0 and y1 % 2 = 0 then (y1//2 + 1)::bigint*4294967296 + x1//2 + 1
 else (y2//2 + 1)::bigint*4294967296 + x2//2 + 1 end as id, abs((x1 - x0)*(y2 - y0) - (x2 - x0)*(y1 - y0))/8.0::double as area from tri),
fr as (select fc.*, region from fc join reg using (level_idx, id)),
ar as (select level_idx, region, sum(area) as area from fr group by all having sum(area) > 0.6),
kp as (select level_idx, region from ar where area >= 0.02::double * (select max(area) from ar m where m.level_idx = ar.level_idx))"""


@query("E2 C7 C8 M6", with_(*_fills("fx9", SUMMED_HEIGHTS, SUM_LEVELS), regions_sql("fx9"), _KEPT, recursive=True) +
       "select raster_id, level_idx::int as level_idx, tid, x0, y0, x1, y1, x2, y2 from fr semi join kp using (level_idx, region)")
def faces_of_large_polygons(spark, sf):
    cells, lv = summed_heights(spark, sf), levels(spark, SUM_LEVELS)
    return faces_of_polygons(M.triangulate_grid(cells, lv), cells, lv, 0.6, 0.02)


@query("E2 E4 C7 C8", with_(*_fills("fx9", SUMMED_HEIGHTS, SUM_LEVELS), regions_sql("fx9"), _KEPT,
       "kt as (select fr.* from fr semi join kp using (level_idx, region))",
       "es as (select level_idx, unnest([[x0, y0, x1, y1], [x1, y1, x2, y2], [x2, y2, x0, y0]]) as e from kt)",
       "od as (select level_idx, least((e[1], e[2]), (e[3], e[4])) as a, greatest((e[1], e[2]), (e[3], e[4])) as b, count(*) as n from es group by all having n = 1)",
       recursive=True) +
       "select level_idx::int as level_idx, ((select count(*) from kt t where t.level_idx = l.level_idx)*2 + (select count(*) from od t where t.level_idx = l.level_idx)*2)::bigint as triangles from (select distinct level_idx from kt) l")
def heights_to_mesh_filtered(spark, sf):
    cfg = MeshSettings(contour=ContourSettings(min_polygon_area=0.6, min_area_fraction=0.02), stages_path=scratch_path(spark, "stages"))
    solid = E.level_solids(summed_heights(spark, sf), levels(spark, SUM_LEVELS), cfg)
    level = F.element_at(F.split("mesh_id", "/"), -1).cast("int").alias("level_idx")
    return solid.triangles.groupBy(level).agg(F.count("*").alias("triangles"))


@query("E4", with_(*_fills("fx9", SUMMED_HEIGHTS, SUM_LEVELS)) + "select level_idx::int as level_idx, count(*)::bigint as triangles from tri group by 1")
def stage_tables(spark, sf):
    faces = M.triangulate_grid(summed_heights(spark, sf), levels(spark, SUM_LEVELS))
    back = E.write_stages(scratch_path(spark, "stages"), triangles=faces)["triangles"]
    return back.groupBy("level_idx").agg(F.count("*").alias("triangles"))
