"""Douglas-Peucker simplification of rings of any length."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from reliefgrid.operators.boxes import box_pairs
from reliefgrid.operators.polygons import level_key, point_in_polygon, poly_key, with_next
from reliefgrid.runtime import attach, cut, spread, unbroadcast

#: Chains up to this many points are simplified in one call; longer ones are split first.
CHAIN_POINTS = 50_000
#: Growth of the tolerance per round.
TOLERANCE_STEP = 0.1


def _distances(x: np.ndarray, y: np.ndarray, ax: float, ay: float, bx: float, by: float) -> np.ndarray:
    """Distance of points to the segment a-b."""
    dx, dy = bx - ax, by - ay
    span = dx * dx + dy * dy
    if span == 0:
        return np.hypot(x - ax, y - ay)
    t = np.clip(((x - ax) * dx + (y - ay) * dy) / span, 0.0, 1.0)
    return np.hypot(x - ax - t * dx, y - ay - t * dy)


def keep_points(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of an open chain stay; both ends always do."""
    n = len(x)
    keep = np.zeros(n, dtype=bool)
    keep[[0, n - 1]] = True
    todo = [(0, n - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d = _distances(x[a + 1 : b], y[a + 1 : b], x[a], y[a], x[b], y[b])
        far = int(np.argmax(d))
        if d[far] > tolerance:
            far += a + 1
            keep[far] = True
            todo += [(a, far), (far, b)]
    return keep


def simplify_ring(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Indices kept of a closed ring: its first point stays, and so do at least two others."""
    n = len(x)
    if n <= 3:
        return np.arange(n)
    keep = keep_points(np.r_[x, x[0]], np.r_[y, y[0]], tolerance)[:n]
    while keep.sum() < 3:
        idx = np.flatnonzero(keep)
        ends = np.r_[idx, n]
        best = (-1.0, -1)
        xx, yy = np.r_[x, x[0]], np.r_[y, y[0]]
        for a, b in zip(ends[:-1], ends[1:]):
            if b - a > 1:
                d = _distances(xx[a + 1 : b], yy[a + 1 : b], xx[a], yy[a], xx[b], yy[b])
                far = int(np.argmax(d))
                best = max(best, (float(d[far]), a + 1 + far))
        keep[best[1]] = True
    return np.flatnonzero(keep)


def _rounds_needed(x: np.ndarray, y: np.ndarray, tolerance: float, max_segments: int) -> int:
    """Rounds until a ring (counting its closing point) is short enough, or cannot shrink."""
    rounds = 0
    extent = float(np.hypot(np.ptp(x), np.ptp(y)))
    while len(x) + 1 > max_segments and len(x) > 3 and tolerance <= extent:
        tolerance += TOLERANCE_STEP
        idx = simplify_ring(x, y, tolerance)
        x, y = x[idx], y[idx]
        rounds += 1
    return rounds


def _split_long(points: DataFrame, key: list[str]) -> DataFrame:
    """One exact Douglas-Peucker pass over rings too long for one task; ``tol`` is a column.

    Chains between fixed points are split at their farthest point, all chains at once, until each
    is short; the short chains are then finished independently. A point meets only its own chain's
    ends, and those travel with it.
    """
    first = points.filter("seq = 0").select(*key, F.col("x").alias("ax"), F.col("y").alias("ay"))
    state = attach(points, first, key).withColumns(
        {"a": F.lit(0), "b": F.lit(2**31 - 1), "bx": F.col("ax"), "by": F.col("ay"), "kept": F.col("seq") == 0}
    )
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    span = dx * dx + dy * dy
    t = F.when(span == 0, 0.0).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy) / span))
    )
    dist = F.sqrt(
        F.pow(F.col("x") - F.col("ax") - t * dx, 2.0) + F.pow(F.col("y") - F.col("ay") - t * dy, 2.0)
    )
    done = None
    state = cut(state)
    while True:
        inner = state.filter("not kept")
        far = inner.groupBy(*key, "a").agg(
            F.count("*").alias("n"),
            F.max(dist).alias("d"),
            F.max("tol").alias("tol"),
            F.max_by(F.struct("seq", "x", "y"), F.struct(dist, -F.col("seq"))).alias("f"),
        )
        long = far.filter((F.col("n") > CHAIN_POINTS) & (F.col("d") > F.col("tol"))).select(*key, "a", "f")
        flat = far.filter((F.col("n") > CHAIN_POINTS) & (F.col("d") <= F.col("tol"))).select(*key, "a")
        state = state.join(flat.withColumn("flat", F.lit(True)), [*key, "a"], "left").filter("flat is null or kept").drop("flat")
        if long.isEmpty():
            done = state
            break
        j = state.join(long, [*key, "a"], "left")
        s = F.col("seq")
        at = F.col("f.seq")
        hit = F.col("f").isNotNull()
        after = hit & (s >= at)
        state = cut(
            j.select(
                *[c for c in state.columns if c not in ("a", "b", "ax", "ay", "bx", "by", "kept")],
                F.when(after, at).otherwise(F.col("a")).alias("a"),
                F.when(hit & (s < at), at).otherwise(F.col("b")).alias("b"),
                F.when(after, F.col("f.x")).otherwise(F.col("ax")).alias("ax"),
                F.when(after, F.col("f.y")).otherwise(F.col("ay")).alias("ay"),
                F.when(hit & (s < at), F.col("f.x")).otherwise(F.col("bx")).alias("bx"),
                F.when(hit & (s < at), F.col("f.y")).otherwise(F.col("by")).alias("by"),
                (F.col("kept") | (hit & (s == at))).alias("kept"),
            )
        )
    cols = points.columns
    schema = points.schema

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        x = np.r_[pdf["x"].to_numpy(), pdf["bx"].iloc[0]]
        y = np.r_[pdf["y"].to_numpy(), pdf["by"].iloc[0]]
        return pdf[keep_points(x, y, float(pdf["tol"].iloc[0]))[:-1]][cols]

    return spread(done, [*key, "a"]).groupBy(*key, "a").applyInPandas(finish, schema)


def renumber(points: DataFrame, key: list[str]) -> DataFrame:
    """Places 0..n-1 again after points were left out, without a window over a whole ring."""
    chunk = points.withColumn("_c", F.floor(F.col("seq") / CHAIN_POINTS))
    from pyspark.sql import Window

    counts = chunk.groupBy(*key, "_c").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*key).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*key, "_c", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_s"))
    rank = F.row_number().over(Window.partitionBy(*key, "_c").orderBy("seq")) - 1
    return (
        chunk.withColumn("_r", rank)
        .join(unbroadcast(starts), [*key, "_c"])
        .withColumn("seq", (F.col("_s") + F.col("_r")).cast("int"))
        .drop("_c", "_r", "_s")
    )


def _at_least_three(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Gives rings of ``after`` that lost too much their farthest points back, up to three points each."""
    for _ in range(2):
        had = before.groupBy(*key).agg(F.count("*").alias("_had"))
        # at most two points each, so the arrays stay small
        short = after.groupBy(*key).agg(F.count("*").alias("_n")).filter("_n < 3").select(*key).join(unbroadcast(had.filter("_had >= 3").select(*key)), key, "left_semi")
        short = cut(short)
        if short.isEmpty():
            return after
        ends = after.join(short, key, "left_semi").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("_p"))
        a, b = F.get("_p", F.lit(0)), F.coalesce(F.get("_p", F.lit(1)), F.get("_p", F.lit(0)))
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        span = dx * dx + dy * dy
        t = F.when(span == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((F.col("x") - a["x"]) * dx + (F.col("y") - a["y"]) * dy) / span)))
        far = F.sqrt(F.pow(F.col("x") - a["x"] - t * dx, 2.0) + F.pow(F.col("y") - a["y"] - t * dy, 2.0))
        left = attach(before, ends, key).filter(~F.exists("_p", lambda p: p["seq"] == F.col("seq")))
        row = F.struct(*[F.col(c) for c in before.columns])
        back = left.groupBy(*key).agg(F.max_by(row, F.struct(far, "seq")).alias("_r")).select("_r.*")
        after = cut(after.unionByName(back.select(*after.columns)))
    return after


def _pass(points: DataFrame, key: list[str]) -> DataFrame:
    return renumber(_at_least_three(points, _split_long(points, key), key), key)


def simplify_once(points: DataFrame, tolerance: float) -> DataFrame:
    """One Douglas-Peucker pass over every ring at a fixed tolerance, whatever its length."""
    key = [*poly_key(points), "ring_id"]
    points = points.select(*key, "role", "seq", "x", "y", F.lit(float(tolerance)).alias("tol"))
    return with_next(_pass(points, key).drop("tol"))


def _distributed_rounds(rings: DataFrame, key: list[str], start: float, wanted, bound: int) -> DataFrame:
    """Rounds for the rings that match ``wanted`` and still have more than ``bound`` points."""
    while True:
        candidates = rings.filter(wanted)
        long = candidates.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > bound).select(*key)
        long = cut(long)
        if long.isEmpty():
            return rings
        part = rings.join(long, key, "left_semi").withColumn("done", F.col("done") + 1)
        part = part.withColumn("tol", F.lit(start) + F.col("done") * TOLERANCE_STEP)
        shorter = _pass(part, key).select(*rings.columns)
        rings = cut(rings.join(long, key, "left_anti").unionByName(shorter))


def _edges(kept: DataFrame, key: list[str], sizes: DataFrame) -> DataFrame:
    """Edges of rings given by the places ``o`` of their points: from ``o`` to ``b`` (beyond the last place on the way round)."""
    row = renumber(kept.withColumn("seq", F.col("o")), key)
    ahead = row.select(*key, (F.col("seq") - 1).alias("seq"), F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("o").alias("b"))
    first = ahead.filter("seq = -1").drop("seq")
    linked = row.join(unbroadcast(ahead), [*key, "seq"], "left")
    last = linked.filter("b is null").drop("nx", "ny", "b").join(unbroadcast(first), key).join(unbroadcast(sizes), key).withColumn("b", F.col("b") + F.col("_size")).drop("_size")
    return linked.filter("b is not null").unionByName(last)


def _clashes(edges: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """Edges that stand for more than one step and cross or touch another edge of their level (``key, o, b``)."""
    own = [c for c in key if c not in by]
    ends = [f(p, q).alias(f"{e}_{p}") for e, f in (("lo", F.least), ("hi", F.greatest)) for p, q in (("x", "nx"), ("y", "ny"))]
    named = edges.select(*by, F.struct(*own).alias("ring"), F.struct(*own, "seq").alias("id"), "o", "b", "x", "y", "nx", "ny", *ends)
    met = box_pairs(named, by, "xy", "id").filter("a.b - a.o > 1 or b.b - b.o > 1")

    def turn(p: tuple[str, str], q: tuple[str, str], t: tuple[str, str]):
        (px, py), (qx, qy), (tx, ty) = ([F.col(c) for c in point] for point in (p, q, t))
        return F.signum((qx - px) * (ty - py) - (qy - py) * (tx - px))

    start, end = {s: (f"{s}.x", f"{s}.y") for s in "ab"}, {s: (f"{s}.nx", f"{s}.ny") for s in "ab"}
    d1, d2 = turn(start["a"], end["a"], start["b"]), turn(start["a"], end["a"], end["b"])
    d3, d4 = turn(start["b"], end["b"], start["a"]), turn(start["b"], end["b"], end["a"])

    def same(p: tuple[str, str], q: tuple[str, str]):
        return (F.col(p[0]) == F.col(q[0])) & (F.col(p[1]) == F.col(q[1]))

    # edges with a common end are neighbours, or met there before: they clash where they run back along each other
    ahead = same(end["a"], start["b"]) | same(end["b"], start["a"])
    joined = ahead | same(start["a"], start["b"]) | same(end["a"], end["b"])
    dot = (F.col("a.nx") - F.col("a.x")) * (F.col("b.nx") - F.col("b.x")) + (F.col("a.ny") - F.col("a.y")) * (F.col("b.ny") - F.col("b.y"))
    folded = (d1 == 0) & (d2 == 0) & F.when(ahead, dot < 0).otherwise(dot > 0)
    bad = met.filter(F.when(joined, folded).otherwise((d1 * d2 <= 0) & (d3 * d4 <= 0)))
    sides = bad.select(*by, F.explode(F.array("a", "b")).alias("e")).filter("e.b - e.o > 1")
    return sides.select(*by, "e.ring.*", "e.o", "e.b").distinct()


def keep_valid(points: DataFrame, simplified: DataFrame) -> DataFrame:
    """``simplified`` rings of ``points`` with as many of their points given back as their level needs to stay free of crossings.

    Round by round the simplified edges that cross or touch another edge of their level, of whatever ring, get back the points
    that they stand for, and exteriors those of all their edges if a hole has come to lie outside, until no edge is left that does. What crossed
    before is not mended. Rings whose points are all there cost nothing further.
    """
    key, by = [*poly_key(points), "ring_id"], level_key(points)
    given = points.select(*key, "role", F.col("seq").cast("int").alias("o"), "x", "y")
    if not by:
        by, key = ["_level"], ["_level", *key]
        given, simplified = given.withColumn("_level", F.lit(0)), simplified.withColumn("_level", F.lit(0))
    sizes = given.groupBy(*key).agg(F.count("*").cast("int").alias("_size"))
    given = cut(given)
    kept = cut(simplified.select(*key, "x", "y").join(unbroadcast(given), [*key, "x", "y"]).select(*given.columns))
    while True:
        edges = cut(_edges(kept, key, sizes))
        thin = edges.filter("b - o > 1").select(*by).distinct()
        inner = edges.join(thin, by, "left_semi")
        back = _clashes(inner, by, key)
        # a hole whose first point isn't inside its exterior any more
        poly = [c for c in key if c != "ring_id"]
        corner = inner.filter("role <> 'exterior' and seq = 0").select(*poly, "x", "y", "ring_id")
        held = point_in_polygon(corner, inner.filter("role = 'exterior'").select(*poly, "ring_id", "role", "seq", "x", "y", "nx", "ny"))
        lost = corner.join(unbroadcast(held.select(*poly, "ring_id")), [*poly, "ring_id"], "left_anti").select(*poly).distinct()
        outer = inner.filter("role = 'exterior' and b - o > 1").join(unbroadcast(lost), poly, "left_semi").select(*key, "o", "b")
        back = cut(back.unionByName(outer.select(*back.columns)).distinct())
        if back.isEmpty():
            break
        places = back.join(unbroadcast(sizes), key).select(*key, F.explode(F.sequence(F.col("o") + 1, F.col("b") - 1)).alias("_o"), "_size")
        places = places.select(*key, (F.col("_o") % F.col("_size")).cast("int").alias("o")).distinct()
        kept = cut(kept.unionByName(given.join(unbroadcast(places), [*key, "o"]).select(*kept.columns)).distinct())
    out = edges.select(*key, "role", "seq", "x", "y", "nx", "ny")
    return out.drop("_level")


def simplify_rings(points: DataFrame, tolerance: float = 0.5, max_segments: int = 100, valid: bool = True) -> DataFrame:
    """Simplify all rings of a level until its longest exterior has at most ``max_segments`` points.

    Each round adds 0.1 to the tolerance (the first one used is 0.6) and works on the result of the
    round before. The rounds a level needs are the most that any of its exteriors needs, so one
    pass finds that number per ring and a second one applies it to all rings of the level. Rings
    too long for one task go through distributed rounds until they fit; rings of levels that need
    no round pass through untouched. A level stops when no exterior can shrink further. With ``valid`` the points
    without which rings would cross stay (:func:`keep_valid`); exteriors may be that much longer.
    """
    key = [*poly_key(points), "ring_id"]
    lk = level_key(points)
    start = float(tolerance)
    rings = points.select(*key, "role", F.col("seq").cast("int").alias("seq"), "x", "y", F.lit(0).alias("done"))
    rings = _distributed_rounds(
        cut(rings), key, start, F.col("role") == "exterior", max(CHAIN_POINTS, max_segments - 1)
    )

    def need(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        done = int(pdf["done"].iloc[0])
        more = _rounds_needed(pdf["x"].to_numpy(), pdf["y"].to_numpy(), start + TOLERANCE_STEP * done, max_segments)
        return pdf.iloc[:1][lk].assign(rounds=np.int32(done + more))

    outer = rings.filter("role = 'exterior'")
    too_long = outer.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") + 1 > max_segments).select(*key)
    need_schema = rings.select(*lk).schema.add("rounds", IntegerType())
    needed = spread(outer.join(unbroadcast(too_long), key, "left_semi"), key).groupBy(*key).applyInPandas(need, need_schema)
    finished = rings.filter("done > 0").select(*lk, F.col("done").alias("rounds"))
    needed = needed.unionByName(finished).groupBy(*lk).agg(F.max("rounds").alias("rounds"))
    joined = attach(rings, needed, lk, "left") if lk else rings.crossJoin(needed)
    joined = cut(joined.withColumn("rounds", F.coalesce("rounds", F.lit(0))))
    active = _distributed_rounds(
        joined.filter("rounds > done"), key, start, F.col("rounds") > F.col("done"), CHAIN_POINTS
    )
    finished_rings = joined.filter("rounds <= done").unionByName(active.filter("rounds <= done"))
    untouched = with_next(finished_rings.select(*key, "role", "seq", "x", "y"))

    def shrink(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        done = int(pdf["done"].iloc[0])
        for r in range(done + 1, int(pdf["rounds"].iloc[0]) + 1):
            idx = simplify_ring(x, y, start + TOLERANCE_STEP * r)
            x, y = x[idx], y[idx]
        out = pdf.iloc[: len(x)][[*key, "role"]].copy()
        out["seq"], out["x"], out["y"] = np.arange(len(x), dtype=np.int32), x, y
        out["nx"], out["ny"] = np.r_[x[1:], x[:1]], np.r_[y[1:], y[:1]]
        return out

    shrunk = spread(active.filter("rounds > done"), key).groupBy(*key).applyInPandas(shrink, untouched.select(
        *key, "role", "seq", "x", "y", "nx", "ny").schema)
    simplified = untouched.select(*shrunk.columns).unionByName(shrunk)
    return keep_valid(points, simplified).select(*shrunk.columns) if valid else simplified
