"""How many edges lie to the right of each point, for outlines with any number of edges beside each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefgrid.operators.ordering import running_sums
from reliefgrid.runtime import attach, cut, unbroadcast

#: Sizes of intervals: 2**0 to 2**40 slots.
SIZES = 41


def _intervals(lo: Column, hi: Column) -> Column:
    """The O(log n) dyadic intervals (size ``k``, number ``i``) that make up the slots from ``lo`` to before ``hi``."""

    def at(k: Column) -> Column:
        side = F.pow(F.lit(2.0), k).cast("long")
        first, end = F.floor((lo + side - 1) / side), F.floor(hi / side)
        left = F.when((first < end) & (first % 2 == 1), F.struct(k.alias("k"), first.alias("i")))
        right = F.when((first < end) & (end % 2 == 1), F.struct(k.alias("k"), (end - 1).alias("i")))
        return F.filter(F.array(left, right), lambda v: v.isNotNull())

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(SIZES - 1)), at))


def edges_to_the_right(points: DataFrame, edges: DataFrame, key: Sequence[str]) -> DataFrame:
    """``_pid``, ``_n`` and ``_h`` (edges of exteriors and holes to the right of the point, level with it) and ``_on`` (on an edge).

    ``points`` has ``key``, distinct ``_pid``, ``x, y``; ``edges`` has ``key``, ``_outer``, ``ex, ey, enx, eny``, none without length.

    The corners' heights cut a polygon's plane into slots, and an edge goes to the dyadic intervals of slots that it spans from
    bottom to top. A point asks the one interval of each size that holds its slot, where all edges are level with
    it. Those that begin to the right of it are counted in one descending order of both; only those whose extent in x the
    point lies in are compared with it, and they meet in cells as wide as the polygon's mean edge. So teeth of a comb beside a point cost
    it nothing, however many they are. Corners and level edges are looked up by their height.
    """
    key = list(key)
    e = edges.select(
        *key, "_outer", "ex", "ey", "enx", "eny",
        F.least("ex", "enx").alias("_xl"), F.greatest("ex", "enx").alias("_xh"), F.least("ey", "eny").alias("_yl"), F.greatest("ey", "eny").alias("_yh"),
    )
    widths = e.groupBy(*key).agg(F.avg(F.col("_xh") - F.col("_xl")).alias("_w"))
    widths = widths.withColumn("_w", F.when(F.col("_w") > 0, F.col("_w")).otherwise(1.0))
    e = attach(e, widths, key)
    p = attach(points.select(*key, "_pid", (F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y")), widths, key).withColumn("_cell", F.floor(F.col("x") / F.col("_w")))
    p = cut(p)
    across = F.explode(F.sequence(F.floor(F.col("_xl") / F.col("_w")), F.floor(F.col("_xh") / F.col("_w"))))

    # level edges and corners
    flat = e.filter("_yl = _yh").select(*key, F.col("_yl").alias("_y"), "_xl", "_xh", "_w")
    corners = e.select(*key, F.col("ey").alias("_y"), F.col("ex").alias("_xl"), F.col("ex").alias("_xh"), "_w")
    flat = flat.unionByName(corners).distinct().withColumn("_cell", across).drop("_w")
    on_flat = p.join(unbroadcast(flat.withColumnRenamed("_y", "y")), [*key, "y", "_cell"]).filter(F.col("x").between(F.col("_xl"), F.col("_xh")))
    on_flat = on_flat.select("_pid", F.lit(0).cast("long").alias("_n"), F.lit(0).cast("long").alias("_h"), F.lit(True).alias("_on"))

    # slots: the rank of each height among the corners' heights
    steep = e.filter("_yl < _yh")
    heights = steep.select(*key, F.col("_yl").alias("y")).unionByName(steep.select(*key, F.col("_yh").alias("y"))).distinct()
    ordered = heights.select(*key, "y", F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("_pid"), F.lit(1).cast("long").alias("_one"))
    ordered = ordered.unionByName(p.select(*key, "y", F.lit(1).alias("_kind"), "_pid", F.lit(0).cast("long").alias("_one")))
    ranked = running_sums(ordered, key, ["y", "_kind"], {"_rank": F.col("_one")})
    rank = ranked.filter("_kind = 0").select(*key, "y", (F.col("_rank") - 1).alias("_slot"))
    low, high = (rank.withColumnsRenamed({"y": f"_y{s}", "_slot": f"_s{s}"}) for s in "lh")
    steep = steep.join(unbroadcast(low), [*key, "_yl"]).join(unbroadcast(high), [*key, "_yh"])
    tall = rank.groupBy(*key).agg(F.floor(F.log2(F.greatest(F.max("_slot"), F.lit(1)).cast("double"))).cast("int").alias("_top"))
    asked = ranked.filter("_kind = 1 and _rank > 0").select("_pid", (F.col("_rank") - 1).alias("_slot"))
    asks = attach(p.join(unbroadcast(asked), "_pid"), tall, key).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_top"))))
    asks = asks.withColumn("_i", F.expr("shiftright(_slot, _k)"))
    held = steep.withColumn("_v", F.explode(_intervals(F.col("_sl"), F.col("_sh")))).select(
        *key, F.col("_v.k").alias("_k"), F.col("_v.i").alias("_i"), "_outer", "ex", "ey", "enx", "eny", "_xl", "_xh", "_w"
    )
    held = cut(held)
    interval = [*key, "_k", "_i"]
    asks = cut(asks.select(*interval, "_pid", "x", "y", "_cell").join(unbroadcast(held.select(*interval).distinct()), interval, "left_semi"))

    # edges that begin to the right, in descending order; a point stands before the edges that begin at its place
    right = asks.select(*interval, (-F.col("x")).alias("_at"), F.lit(0).alias("_kind"), "_pid", F.lit(0).cast("long").alias("_a"), F.lit(0).cast("long").alias("_b"))
    begins = held.select(*interval, (-F.col("_xl")).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_pid"), F.col("_outer").cast("long").alias("_a"), (~F.col("_outer")).cast("long").alias("_b"))
    begins = begins.groupBy(*interval, "_at", "_kind", "_pid").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    counted = running_sums(right.unionByName(begins), interval, ["_at", "_kind"], {"_n": F.col("_a"), "_h": F.col("_b")})
    counted = counted.filter("_kind = 0").select("_pid", "_n", "_h", F.lit(False).alias("_on"))

    # edges beside the point
    met = asks.join(unbroadcast(held.withColumn("_cell", across).drop("_w")), [*interval, "_cell"]).filter(F.col("x").between(F.col("_xl"), F.col("_xh")))
    side = (F.col("enx") - F.col("ex")) * (F.col("y") - F.col("ey")) - (F.col("eny") - F.col("ey")) * (F.col("x") - F.col("ex"))
    beside = F.when(F.col("eny") > F.col("ey"), side > 0).otherwise(side < 0) & (F.col("_xl") <= F.col("x"))
    near = met.select("_pid", (beside & F.col("_outer")).cast("long").alias("_n"), (beside & ~F.col("_outer")).cast("long").alias("_h"), (side == 0).alias("_on"))
    every = counted.unionByName(near).unionByName(on_flat)
    return every.groupBy("_pid").agg(F.sum("_n").alias("_n"), F.sum("_h").alias("_h"), F.max("_on").alias("_on"))
