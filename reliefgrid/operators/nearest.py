"""Nearest vertex of every point, and walls on outlines that are not made of mesh vertices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefgrid.operators.mesh import Mesh
from reliefgrid.runtime import attach, cut

#: Positions in one of the smallest cells, at most; cells are halved until they hold no more.
CELL_POSITIONS = 64
#: Sizes of cells, each twice the last.
MAX_SIZES = 200
#: Cells are kept, and finds doubted, by this much more than the distances demand; covers rounding of places in cells.
SLACK = 1e-6


def _cell_sides(spots: DataFrame, axes: Sequence[str]) -> DataFrame:
    """``mesh_id, side``: a cell holds about one position, and nowhere more than ``CELL_POSITIONS``."""
    extent = F.greatest(*[F.max(c) - F.min(c) for c in axes], F.lit(0.0))
    sides = spots.groupBy("mesh_id").agg(extent.alias("_e"), F.count("*").alias("_n"))
    even = F.col("_e") / F.greatest(F.lit(1.0), F.pow(F.col("_n").cast("double"), F.lit(1.0 / len(axes))))
    sides = cut(sides.select("mesh_id", F.when(F.col("_e") > 0, even).otherwise(1.0).alias("side")))
    for _ in range(60):
        cells = [F.floor(F.col(c) / F.col("side")) for c in axes]
        most = attach(spots, sides, ["mesh_id"]).groupBy("mesh_id", *cells).agg(F.count("*").alias("_n")).groupBy("mesh_id").agg(F.max("_n").alias("_n"))
        crowded = cut(most.filter(F.col("_n") > CELL_POSITIONS))
        if crowded.isEmpty():
            return sides
        halvings = F.ceil(F.log2(F.col("_n") / CELL_POSITIONS) / len(axes))
        smaller = sides.join(crowded, "mesh_id", "left").withColumn("_f", F.coalesce(F.pow(F.lit(2.0), F.greatest(halvings, F.lit(1))), F.lit(1.0)))
        sides = cut(smaller.select("mesh_id", (F.col("side") / F.col("_f")).alias("side")))
    raise RuntimeError("positions too close together to tell apart")


def _around(rows: DataFrame, axes: Sequence[str], size: Column) -> DataFrame:
    """Each row with the cells of one size around it, its own included."""
    for c in axes:
        at = F.floor(F.col(c) / size)
        rows = rows.withColumn(f"c{c}", F.explode(F.sequence(at - 1, at + 1)))
    return rows


def _descended(open_: DataFrame, leaf: DataFrame, axes: Sequence[str]) -> DataFrame | None:
    """Open points (``_reach``: distance of a vertex, if one is known) with the vertices of all cells that may hold something nearer."""
    key = ["mesh_id", *[f"c{c}" for c in axes]]
    zero = F.lit(0.0)

    def larger(cells: DataFrame) -> DataFrame:
        up = cells.select("mesh_id", *[F.shiftright(f"c{c}", 1).alias(f"c{c}") for c in axes], "_rep")
        return cut(up.groupBy(*key).agg(F.min("_rep").alias("_rep")))

    def size(k: int) -> Column:
        return F.col("side") * float(1 << k)

    def to_cell(k: int) -> Column:
        """Square of the distance from the point to its nearest place in the cell."""
        gaps = [F.greatest(F.col(f"c{c}") * size(k) - F.col(c), F.col(c) - (F.col(f"c{c}") + 1) * size(k), zero) for c in axes]
        return sum((g * g for g in gaps), zero)

    to_rep = F.sqrt(sum(((F.col(c) - F.col(f"_rep.v{c}")) * (F.col(c) - F.col(f"_rep.v{c}")) for c in axes), zero))
    within = F.col("_reach") * F.col("_reach") * (1 + SLACK)
    if open_.isEmpty():
        return None
    # larger and larger cells, each with one of its vertices, until every open point has one around it. It is less than
    # four sides away, so what is nearer lies within the cells around the point that are four times as large.
    pyramid = [cut(leaf.groupBy(*key).agg(F.min(F.struct("vid", *[f"v{c}" for c in axes])).alias("_rep")))]
    starts = {2: open_.filter("_reach is not null")}
    open_ = open_.filter("_reach is null")
    while not open_.isEmpty():
        k = len(pyramid)
        if k > MAX_SIZES:
            raise RuntimeError("cells did not grow to the points")
        pyramid.append(larger(pyramid[-1]))
        seen = _around(open_, axes, size(k)).join(pyramid[k], key, "left")
        now = cut(seen.groupBy("mesh_id", "pid", "side", *axes).agg(F.min(to_rep).alias("_reach")))
        starts[k + 2] = now.filter("_reach is not null")
        open_ = now.filter("_reach is null")
    top = max(starts)
    while len(pyramid) <= top:
        pyramid.append(larger(pyramid[-1]))
    rows = None
    for k in range(top, -1, -1):
        if rows is not None:
            for c in axes:
                rows = rows.withColumn(f"c{c}", F.explode(F.array(F.col(f"c{c}") * 2, F.col(f"c{c}") * 2 + 1)))
        if k in starts:
            fresh = _around(starts[k], axes, size(k))
            rows = fresh if rows is None else rows.unionByName(fresh.select(*rows.columns))
        rows = rows.filter(to_cell(k) <= within).join(pyramid[k], key)
        rows = cut(rows.withColumn("_far", to_rep).drop("_rep"))
        nearer = rows.groupBy("mesh_id", "pid").agg(F.min("_far").alias("_now"))
        rows = rows.drop("_far").join(nearer, ["mesh_id", "pid"]).withColumn("_reach", F.least("_reach", "_now")).drop("_now")
        rows = rows.filter(to_cell(k) <= within)
    return rows.join(leaf, key)


def nearest_vertices(points: DataFrame, vertices: DataFrame, axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """The nearest vertex of each point of the same mesh: ``mesh_id, pid, vid, distance``; ties go to the lowest id.

    ``points`` has ``mesh_id``, distinct ids ``pid`` and the ``axes``. Vertices lie in cells that hold few of them, and a
    point looks at its own cell and those around it. It is done if the nearest vertex found is no farther than
    the border of these cells. The others look for the first occupied cells among ever larger ones, and descend
    from there into those that can hold something nearer than what is known: the cells that a circle
    meets, a few per point and size. A mesh without vertices gives null; points without place too.
    """
    axes = list(axes)
    cell = [f"c{c}" for c in axes]
    key = ["mesh_id", *cell]
    placed = points.select("mesh_id", "pid", *[F.col(c).cast("double").alias(c) for c in axes])
    known = vertices.select("mesh_id", "vid", *[F.col(c).cast("double").alias(f"v{c}") for c in axes]).dropna()
    spots = cut(known.groupBy("mesh_id", *[f"v{c}" for c in axes]).agg(F.min("vid").alias("vid")))
    sides = _cell_sides(spots.select("mesh_id", *[F.col(f"v{c}").alias(c) for c in axes]), axes)
    leaf = attach(spots, sides, ["mesh_id"]).withColumns({f"c{c}": F.floor(F.col(f"v{c}") / F.col("side")) for c in axes}).drop("side")
    leaf = cut(leaf)
    whole = attach(placed.dropna(), sides, ["mesh_id"])

    square = sum(((F.col(c) - F.col(f"v{c}")) * (F.col(c) - F.col(f"v{c}")) for c in axes), F.lit(0.0))
    point = ["mesh_id", "pid", "side", *axes]
    met = _around(whole, axes, F.col("side")).join(leaf, key, "left")
    found = met.groupBy(*point).agg(F.min(F.when(F.col("vid").isNotNull(), F.struct(square.alias("d2"), F.col("vid").alias("vid")))).alias("_best"))
    # a little less than the distance to the border, so that rounding cannot matter
    border = F.least(*[F.least(F.col(c) - (F.floor(F.col(c) / F.col("side")) - 1) * F.col("side"), (F.floor(F.col(c) / F.col("side")) + 2) * F.col("side") - F.col(c)) for c in axes])
    sure = border * (1 - SLACK)
    judged = cut(found.withColumn("_done", F.coalesce(F.col("_best.d2") < sure * sure, F.lit(False))))
    done = judged.filter("_done").select("mesh_id", "pid", "_best")
    late = _descended(judged.filter("not _done").select(*point, F.sqrt("_best.d2").alias("_reach")), leaf, axes)
    if late is not None:
        done = done.unionByName(late.groupBy("mesh_id", "pid").agg(F.min(F.struct(square.alias("d2"), F.col("vid").alias("vid"))).alias("_best")))
    out = points.select("mesh_id", "pid").join(done, ["mesh_id", "pid"], "left")
    return out.select("mesh_id", "pid", F.col("_best.vid").alias("vid"), F.sqrt("_best.d2").alias("distance"))


def outline_edges(points: DataFrame, cover: Mesh) -> DataFrame:
    """Directed edges ``mesh_id, a, b`` between the cover's vertices nearest to the ends of an outline's edges.

    ``points`` has ``mesh_id, x, y`` and the next point of the outline ``nx, ny``. Equal places are looked up once;
    edges whose ends meet the same vertex are dropped.
    """
    ends = F.array(F.struct(F.col("x").alias("x"), F.col("y").alias("y")), F.struct(F.col("nx").alias("x"), F.col("ny").alias("y")))
    places = cut(points.select("mesh_id", F.inline(ends)).distinct().withColumn("pid", F.monotonically_increasing_id()))
    met = places.join(nearest_vertices(places, cover.vertices), ["mesh_id", "pid"]).select("mesh_id", "x", "y", "vid")
    edges = points.select("mesh_id", "x", "y", "nx", "ny")
    edges = edges.join(met.withColumnRenamed("vid", "a"), ["mesh_id", "x", "y"])
    edges = edges.join(met.select("mesh_id", F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("vid").alias("b")), ["mesh_id", "nx", "ny"])
    return edges.filter("a <> b").select("mesh_id", "a", "b").distinct()

