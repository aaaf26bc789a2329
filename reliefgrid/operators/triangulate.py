"""Triangulation of polygons with a Delaunay mesh, polygons in parallel and large ones in cells.

``mesh.triangulate_grid`` covers slices of any size without a solver; this is the path that keeps
the original's point sets.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefgrid.operators.mesh import Mesh
from reliefgrid.operators.ordering import running_sums
from reliefgrid.operators.polygons import (
    is_valid_polygon,
    point_in_polygon,
    poly_key,
    polygon_measures,
    with_next,
)
from reliefgrid.operators.regions import merged
from reliefgrid.runtime import attach, cut, spread, unbroadcast

#: Points of a polygon that one task triangulates; larger polygons are cut into cells.
DELAUNAY_POINTS = 50_000
#: Points of a cell at most, where finer cells hold fewer.
CELL_POINTS = 8_000
#: Sides of the smallest cells: 2**-20 of the polygon's.
FINEST = 20
#: Points are shifted by at most this share of the polygon's extent.
SHIFT = 1e-7
#: Circles are told apart exactly where floating point may err by this share of their terms.
ROUNDING = 4e-15


def boundary_points(rings: DataFrame) -> DataFrame:
    """Points of all rings, without a repeated closing point."""
    return rings.select(*poly_key(rings), "ring_id", "role", "seq", "x", "y")


def paired_crossings(cuts: DataFrame, by: list[str], keep: list[str]) -> DataFrame:
    """Entry ``a`` and exit ``b`` of each stretch inside, from the crossings ``cx`` of every scan row ``by``.

    A crossing is numbered by a running count over ranges, so a row with very many of them is spread over tasks;
    numbers 1 and 2, 3 and 4, ... belong together. Closed rings cross a row an even number of times. ``keep``
    names columns that are equal within a row.
    """
    placed = running_sums(cuts, by, ["cx"], {"_n": F.lit(1).cast("long")})
    pair = F.shiftright(F.col("_n") + 1, 1).alias("_pair")
    return placed.groupBy(*by, pair).agg(
        F.min("cx").alias("a"), F.max("cx").alias("b"), *[F.first(c).alias(c) for c in keep]
    ).drop("_pair")


def interior_points(rings: DataFrame, density: float = 1.0) -> DataFrame:
    """Regular points strictly inside each polygon, about ``100 * density`` of them whatever its size.

    Spacing is sqrt(area / (100 * density)), starting half a step from the lower bounds. Each grid
    row is cut with the edges that cross it and points are laid out between entry and exit, so no
    point is ever tested against the whole polygon.
    """
    key = poly_key(rings)
    step = polygon_measures(rings).filter("area > 0").select(
        *key,
        F.sqrt(F.col("area") / (density * 100.0)).alias("s"),
        "min_x", "min_y",
    )
    step = step.select(*key, "s", (F.col("min_x") + F.col("s") / 2).alias("x0"), (F.col("min_y") + F.col("s") / 2).alias("y0"))
    edges = attach(with_next(rings).select(*key, "x", "y", "nx", "ny"), step, key)
    lo, hi = F.least("y", "ny"), F.greatest("y", "ny")
    j0 = F.ceil((lo - F.col("y0")) / F.col("s"))
    j1 = F.ceil((hi - F.col("y0")) / F.col("s")) - 1
    row_y = F.col("y0") + F.col("j") * F.col("s")
    cuts = (
        edges.filter(j0 <= j1)
        .withColumn("j", F.explode(F.sequence(j0, j1)))
        .filter((row_y >= lo) & (row_y < hi))
        .withColumn("cx", F.col("x") + (row_y - F.col("y")) * (F.col("nx") - F.col("x")) / (F.col("ny") - F.col("y")))
    )
    spans = paired_crossings(cuts.select(*key, "j", "cx", "s", "x0", "y0"), [*key, "j"], ["s", "x0", "y0"])
    i0 = F.floor((F.col("a") - F.col("x0")) / F.col("s")) + 1
    i1 = F.ceil((F.col("b") - F.col("x0")) / F.col("s")) - 1
    inside = (
        spans.filter(i0 <= i1)
        .withColumn("i", F.explode(F.sequence(i0, i1)))
        .select(*key, "j", "i", (F.col("x0") + F.col("i") * F.col("s")).alias("x"), row_y.alias("y"))
    )
    # a row that runs exactly along an edge or through a corner: those points are on the border
    flat = edges.withColumn("j", F.round((F.col("y") - F.col("y0")) / F.col("s")).cast("long")).filter(row_y == F.col("y"))
    on = flat.select(
        *key, "j",
        F.when(F.col("ny") == F.col("y"), F.least("x", "nx")).otherwise(F.col("x")).alias("fx"),
        F.when(F.col("ny") == F.col("y"), F.greatest("x", "nx")).otherwise(F.col("x")).alias("tx"),
    )
    p, o = inside.alias("p"), on.alias("o")
    same = (F.col("p.x") >= F.col("o.fx")) & (F.col("p.x") <= F.col("o.tx"))
    for k in [*key, "j"]:
        same = same & (F.col(f"p.{k}") == F.col(f"o.{k}"))
    return p.join(unbroadcast(o), same, "left_anti").select(*key, "i", "j", "x", "y")


def _delaunay(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Delaunay triangles by point insertion (Bowyer, 1981; Watson, 1981).

    The triangles whose circles hold a new point are connected: one is found by walking from the latest triangle, the
    others through their sides, so a point costs the triangles near it and not all that there are. Positions are shifted by a fixed tiny amount per point, so that points on a common circle or
    line leave no ties.
    """
    n = len(x)
    if n < 3:
        return np.empty((0, 3), dtype=np.int64)
    extent = max(np.ptp(x), np.ptp(y)) or 1.0
    shift = np.random.default_rng(7).uniform(-SHIFT, SHIFT, (n, 2)) * extent
    px, py = x + shift[:, 0], y + shift[:, 1]
    tri = _framed_delaunay(px, py, (px.mean(), py.mean(), extent))
    return tri[(tri < n).all(axis=1)]


def _framed_delaunay(px: np.ndarray, py: np.ndarray, frame: tuple[float, float, float]) -> np.ndarray:
    """Delaunay triangles, counterclockwise, of the points and of three far corners (``n`` to ``n + 2``) around ``frame`` (middle, extent)."""
    n = len(px)
    mx, my, big = frame[0], frame[1], 1e4 * frame[2]
    px = np.r_[px, mx - big, mx + big, mx]
    py = np.r_[py, my - big, my - big, my + big]

    xs, ys, base = px.tolist(), py.tolist(), n + 3
    corners: list[tuple[int, int, int]] = []
    across: list[list[int]] = []  # triangle beyond the side opposite to each corner, -1 outside
    circles: list[tuple[float, float, float, float]] = []  # middle, squared radius, and what rounding may add to a squared distance less it
    gone = bytearray()

    def add(a: int, b: int, c: int, beyond: int) -> int:
        ax, ay = xs[a], ys[a]
        bx, by, cx, cy = xs[b] - ax, ys[b] - ay, xs[c] - ax, ys[c] - ay
        d = 2.0 * (bx * cy - by * cx) or 1e-300
        b2, c2 = bx * bx + by * by, cx * cx + cy * cy
        ux, uy = (cy * b2 - by * c2) / d, (bx * c2 - cx * b2) / d
        r2 = ux * ux + uy * uy
        lost = ROUNDING * ((abs(bx * cy) + abs(by * cx)) / abs(d) + (abs(cy * b2) + abs(by * c2) + abs(bx * c2) + abs(cx * b2)) / abs(d) / (r2**0.5 or 1.0) + 1.0)
        corners.append((a, b, c))
        across.append([-1, -1, beyond])
        circles.append((ax + ux, ay + uy, r2, r2 * lost + ROUNDING * r2**0.5 * (abs(ax) + abs(ay))))
        gone.append(0)
        return len(corners) - 1

    def holds(t: int, i: int) -> bool:
        cx, cy, r2, lost = circles[t]
        dx, dy = cx - xs[i], cy - ys[i]
        over = dx * dx + dy * dy - r2
        if over < -lost or over > lost:
            return over < 0
        # too close to tell in floating point, as in flat triangles along a straight border
        px, py = Fraction(xs[i]), Fraction(ys[i])
        (ax, ay, a2), (bx, by, b2), (cx, cy, c2) = (
            (x, y, x * x + y * y) for x, y in ((Fraction(xs[v]) - px, Fraction(ys[v]) - py) for v in corners[t])
        )
        return ax * (by * c2 - b2 * cy) - ay * (bx * c2 - b2 * cx) + a2 * (bx * cy - by * cx) > 0

    def start(t: int, i: int) -> int:
        """A triangle whose circle holds point ``i``: on the way from ``t`` towards it."""
        x0, y0 = xs[i], ys[i]
        came = -1
        for _ in range(len(corners)):
            if holds(t, i):
                return t
            for k in range(3):
                to = across[t][k]
                if to < 0 or to == came:
                    continue
                w, u, v = corners[t][k], corners[t][k - 2], corners[t][k - 1]
                ex, ey = xs[v] - xs[u], ys[v] - ys[u]
                if (ex * (y0 - ys[u]) - ey * (x0 - xs[u])) * (ex * (ys[w] - ys[u]) - ey * (xs[w] - xs[u])) < 0:
                    came, t = t, to
                    break
            else:
                break
        return next((t for t in range(len(corners)) if not gone[t] and holds(t, i)), -1)

    last = add(n, n + 1, n + 2, -1)
    for i in range(n):
        first = start(last, i)
        if first < 0:
            continue  # no circle holds the point, as for a repeated one
        bad, todo, rim = {first}, [first], []
        while todo:
            t = todo.pop()
            for k in range(3):
                to = across[t][k]
                if to in bad:
                    continue
                if to >= 0 and holds(to, i):
                    bad.add(to)
                    todo.append(to)
                else:
                    u, v = corners[t][k - 2], corners[t][k - 1]
                    rim.append((min(u, v) * base + max(u, v), u, v, t, to))
        open_: dict[int, tuple[int, int]] = {}
        for _, u, v, t, to in sorted(rim):
            last = add(u, v, i, to)
            if to >= 0:
                across[to][across[to].index(t)] = last
            for k, corner in ((1, u), (0, v)):
                other = open_.pop(corner, None)
                if other is None:
                    open_[corner] = (last, k)
                else:
                    across[last][k] = other[0]
                    across[other[0]][other[1]] = last
        for t in bad:
            gone[t] = 1
    return np.array([c for c, dead in zip(corners, gone) if not dead], np.int64).reshape(-1, 3)


def _in_box(px: np.ndarray, py: np.ndarray, tri: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """Which triangles have their circle inside ``box`` (left, bottom, right, top; may be infinite)."""
    ax, ay = px[tri[:, 0]], py[tri[:, 0]]
    bx, by, cx, cy = px[tri[:, 1]] - ax, py[tri[:, 1]] - ay, px[tri[:, 2]] - ax, py[tri[:, 2]] - ay
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        d = 2.0 * (bx * cy - by * cx)
        b2, c2 = bx * bx + by * by, cx * cx + cy * cy
        ux, uy = (cy * b2 - by * c2) / d, (bx * c2 - cx * b2) / d
        lost = ROUNDING * (np.abs(bx * cy) + np.abs(by * cx) + (np.abs(cy * b2) + np.abs(by * c2) + np.abs(bx * c2) + np.abs(cx * b2)) / np.hypot(ux, uy)) / np.abs(d)
        r = np.hypot(ux, uy) * (1 + 1e-9 + 4 * lost)
        return (ax + ux - r > box[0]) & (ay + uy - r > box[1]) & (ax + ux + r < box[2]) & (ay + uy + r < box[3])


def _settle(px: np.ndarray, py: np.ndarray, walls: np.ndarray, box: tuple[float, float, float, float] | None, frame: tuple[float, float, float]):
    """One cell: triangles that are certain, which points may have further ones, and the border of all that is certain.

    A circle inside the cell that holds none of its points holds none at all. ``walls`` are the directed borders of what is certain from
    smaller cells (on their left); points inside of it are not among the given ones any more, so triangles there are left out. No
    ``box``: the cell is the whole polygon and all other triangles are certain. All cells have the polygon's ``frame``.
    """
    n = len(px)
    tri = _framed_delaunay(px, py, frame)
    base = n + 3
    a, b = tri.ravel(), np.roll(tri, -1, axis=1).ravel()
    edge, back, wall = a * base + b, b * base + a, walls[:, 0] * base + walls[:, 1]
    order = np.argsort(edge)
    at = np.minimum(np.searchsorted(edge[order], back), len(edge) - 1)
    beyond = np.where(edge[order][at] == back, order[at] // 3, -1)
    passed = (beyond >= 0) & ~np.isin(edge, wall) & ~np.isin(back, wall)
    own = np.repeat(np.arange(len(tri)), 3)
    part = merged(len(tri), own[passed], beyond[passed])
    covered = np.isin(part, part[own[np.isin(edge, wall)]])
    if not np.isin(wall, edge).all() or (covered[own] & np.isin(back, wall)).any():
        raise RuntimeError("triangles of neighbouring cells do not fit together")
    certain = ~covered & (tri < n).all(axis=1)
    if box is not None:
        inner = np.flatnonzero(certain)
        certain[inner] = _in_box(px, py, tri[inner], box)
    placed = np.zeros(base, dtype=bool)
    placed[tri.ravel()] = True
    left = np.zeros(base, dtype=bool)
    left[tri[~covered & ~certain].ravel()] = True
    left |= ~placed  # a point that no circle holds
    found = tri[certain]
    border = np.r_[found.ravel() * base + np.roll(found, -1, axis=1).ravel(), wall]
    border = border[~np.isin(border % base * base + border // base, border)]
    return found, left[:n], np.c_[border // base, border % base]


_STATE = (
    "kind string, lev int, a long, b long, c long, x double, y double, px double, py double, qx int, qy int,"
    " left double, bottom double, right double, top double, side double, mx double, my double, extent double"
)
_BOX = ["left", "bottom", "right", "top", "side", "mx", "my", "extent"]


def _shifted(pdfs):
    """Points with the shift that their number has in :func:`_delaunay`, and their finest cells."""
    for pdf in pdfs:
        pdf = pdf.sort_values("a", ignore_index=True)
        draws, at, shift = np.random.PCG64(7), 0, np.empty((len(pdf), 2))
        numbers = pdf["a"].to_numpy()
        runs = np.flatnonzero(np.r_[True, np.diff(numbers) != 1]) if len(pdf) else []
        for lo, hi in zip(runs, [*runs[1:], len(pdf)]):
            # two draws a point; numbers of different polygons may be equal
            if 2 * int(numbers[lo]) < at:
                draws, at = np.random.PCG64(7), 0
            draws.advance(2 * int(numbers[lo]) - at)
            shift[lo:hi] = np.random.Generator(draws).uniform(-SHIFT, SHIFT, (hi - lo, 2))
            at = 2 * (int(numbers[hi - 1]) + 1)
        extent = np.maximum(pdf["right"] - pdf["left"], pdf["top"] - pdf["bottom"]).to_numpy()
        extent = np.where(extent > 0, extent, 1.0)
        pdf["extent"] = extent
        pdf["px"], pdf["py"] = pdf["x"] + shift[:, 0] * extent, pdf["y"] + shift[:, 1] * extent
        # cells begin a little outside of all shifted points
        pdf["left"], pdf["bottom"], pdf["side"] = pdf["left"] - extent * 1e-6, pdf["bottom"] - extent * 1e-6, extent * (1 + 3e-6)
        pdf["right"], pdf["top"] = pdf["right"] + extent * 1e-6, pdf["top"] + extent * 1e-6
        for q, p, lo in (("qx", "px", "left"), ("qy", "py", "bottom")):
            pdf[q] = np.floor((pdf[p] - pdf[lo]) / pdf["side"] * (1 << FINEST)).astype(np.int32)
        yield pdf


def _settle_cell(key: list[str]):
    columns = [c.split()[0] for c in _STATE.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        walls = pdf[pdf["kind"] == "w"]
        pts = pdf[pdf["kind"] == "p"].sort_values("a", ignore_index=True)
        head, lev = pdf.iloc[0], int(pdf["lev"].iloc[0])
        side, cell = head["side"] / (1 << lev), [int(head[q]) >> (FINEST - lev) for q in ("qx", "qy")]
        box = None
        if lev > 0:
            # nothing lies beyond the polygon's bounds, so cells at them have no end there
            ends = [[head[o] + k * side, head[o] + (k + 1) * side] for o, k in zip(("left", "bottom"), cell)]
            margin = head["side"] * 1e-12
            (x0, x1), (y0, y1) = [[lo + margin if k else -np.inf, hi - margin if hi < head[t] else np.inf] for (lo, hi), k, t in zip(ends, cell, ("right", "top"))]
            box = (x0, y0, x1, y1)
        ids = pts["a"].to_numpy()
        at = np.searchsorted(ids, walls[["a", "b"]].to_numpy().astype(np.int64))
        found, left, border = _settle(pts["px"].to_numpy(), pts["py"].to_numpy(), at, box, tuple(float(head[c]) for c in ("mx", "my", "extent")))
        x, y = pts["x"].to_numpy(), pts["y"].to_numpy()
        turn = (x[found[:, 1]] - x[found[:, 0]]) * (y[found[:, 2]] - y[found[:, 0]]) - (y[found[:, 1]] - y[found[:, 0]]) * (
            x[found[:, 2]] - x[found[:, 0]]
        )
        out = found.copy()
        out[turn < 0] = found[turn < 0][:, ::-1]
        parts = [pd.DataFrame({"kind": "t", "a": ids[out[:, 0]], "b": ids[out[:, 1]], "c": ids[out[:, 2]], "x": x[found].mean(axis=1), "y": y[found].mean(axis=1)})]
        if box is not None:
            parts.append(pts[left].assign(kind="p"))
            ends = pd.DataFrame({"kind": "w", "a": ids[border[:, 0]], "b": ids[border[:, 1]]})
            parts.append(ends.assign(qx=pts["qx"].to_numpy()[border[:, 0]], qy=pts["qy"].to_numpy()[border[:, 0]]))
        out = pd.concat(parts, ignore_index=True).reindex(columns=columns)
        out = out.assign(**{k: head[k] for k in key}, **{k: head[k] for k in _BOX}, lev=lev)
        zero = {c: 0 for c in ("a", "b", "c", "x", "y", "px", "py", "qx", "qy")}
        return out.fillna(zero)[[*key, *columns]].astype({c: np.int64 for c in "abc"} | {c: np.int32 for c in ("lev", "qx", "qy")})

    return run


def _solve_in_cells(points: DataFrame, key: list[str]) -> DataFrame:
    """The rows of :func:`_solve` for polygons of any size, with no more than a cell's points in a task.

    Points are numbered and shifted as one task would. A cell's triangles whose circles lie inside it are certain, and only points that may have
    others, those along the cells' borders and around empty places, go on to larger cells, until one cell is left. Points none of whose
    triangles fit a cell, such as those of a bare circle, all meet in the last one.
    """
    order = ["part", "ring_id", "seq", "i", "j"]
    numbered = running_sums(points, key, order, {"_n": F.lit(1).cast("long")})
    numbered = cut(numbered.select(*key, (F.col("_n") - 1).alias("a"), "part", "ring_id", "x", "y"))
    bounds = numbered.groupBy(*key).agg(*[f(c).alias(n) for f, c, n in ((F.min, "x", "left"), (F.min, "y", "bottom"), (F.max, "x", "right"), (F.max, "y", "top"), (F.avg, "x", "mx"), (F.avg, "y", "my"))])
    none = {"kind": F.lit("p"), "lev": F.lit(FINEST + 1)} | {c: F.lit(0).cast("long") for c in "bc"}
    none |= {c: F.lit(0.0) for c in ("px", "py", "side", "extent")} | {c: F.lit(0) for c in ("qx", "qy")}
    state = attach(numbered.select(*key, "a", "x", "y"), bounds, key).withColumns(none)
    columns = [c.split()[0] for c in _STATE.split(", ")]
    schema = ", ".join([*[f"{k} {t}" for k, t in numbered.dtypes if k in key], _STATE])
    state = cut(state.select(*key, *columns).mapInPandas(_shifted, schema))
    triangles = None
    while True:
        sizes = F.explode(F.sequence(F.lit(0), F.lit(FINEST))).alias("_l")
        cell = [F.expr(f"shiftright({q}, {FINEST} - _l)").alias(f"_{q}") for q in ("qx", "qy")]
        crowd = state.filter("kind = 'p'").select(*key, "lev", "qx", "qy", sizes).groupBy(*key, "lev", "_l", *cell).count()
        crowd = crowd.groupBy(*key, "lev", "_l").agg(F.max("count").alias("_most"))
        # the largest cells that one task takes, but larger than those before
        fit = F.coalesce(F.min(F.when(F.col("_most") <= CELL_POINTS, F.col("_l"))), F.lit(FINEST))
        levels = crowd.groupBy(*key, "lev").agg(fit.alias("_fit")).select(*key, F.least("_fit", F.col("lev") - 1).cast("int").alias("lev"))
        at = [F.expr(f"shiftright({q}, {FINEST} - lev)").alias(f"_{q}") for q in ("qx", "qy")]
        placed = attach(state.drop("lev"), levels, key).select(*key, *columns, *at)
        groups = spread(placed, [*key, "_qx", "_qy"]).groupBy(*key, "_qx", "_qy")
        out = cut(groups.applyInPandas(_settle_cell(key), schema))
        found = out.filter("kind = 't'")
        triangles = found if triangles is None else triangles.unionByName(found)
        state = out.filter("kind <> 't'")
        if state.isEmpty():
            break
    zero = F.lit(0).cast("long")
    tids = running_sums(triangles.select(*key, "a", "b", "c", "x", "y"), key, ["a", "b", "c"], {"_n": F.lit(1).cast("long")})
    rings = numbered.filter("part < 2")
    ends = rings.groupBy(*key, "ring_id").agg(F.min("a").alias("_first"), F.max("a").alias("_last"))
    ahead = F.when(F.col("a") == F.col("_last"), F.col("_first")).otherwise(F.col("a") + 1)
    rings = rings.join(unbroadcast(ends), [*key, "ring_id"]).select(*key, "a", ahead.alias("b"), (F.col("part") == 0).cast("long").alias("c"))
    nowhere = [F.lit(0.0).alias("x"), F.lit(0.0).alias("y")]
    vertices = numbered.select(*key, F.lit("v").alias("kind"), F.col("a").alias("id"), zero.alias("a"), zero.alias("b"), zero.alias("c"), "x", "y")
    tids = tids.select(*key, F.lit("t").alias("kind"), (F.col("_n") - 1).alias("id"), "a", "b", "c", "x", "y")
    return vertices.unionByName(tids).unionByName(rings.select(*key, F.lit("e").alias("kind"), F.col("a").alias("id"), "a", "b", "c", *nowhere))


def _solve(key: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "ring_id", "seq", "i", "j"]).reset_index(drop=True)
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        tri = _delaunay(x, y)
        turn = (x[tri[:, 1]] - x[tri[:, 0]]) * (y[tri[:, 2]] - y[tri[:, 0]]) - (y[tri[:, 1]] - y[tri[:, 0]]) * (
            x[tri[:, 2]] - x[tri[:, 0]]
        )
        tri[turn < 0] = tri[turn < 0][:, ::-1]
        ring = np.flatnonzero(pdf["part"].to_numpy() < 2)
        nxt = np.r_[ring[1:], ring[:1]] if ring.size else ring
        start = pdf.groupby("ring_id", sort=False).head(1).index.to_numpy()
        owner = pdf["ring_id"].to_numpy()
        first_of = dict(zip(owner[start], start))
        nxt = np.array([b if owner[b] == owner[a] and b > a else first_of[owner[a]] for a, b in zip(ring, nxt)], dtype=np.int64)
        cols = {k: pdf[k].iloc[0] for k in key}

        def table(kind, ids, a=0, b=0, c=0, xs=0.0, ys=0.0):
            return pd.DataFrame({**cols, "kind": kind, "id": ids, "a": a, "b": b, "c": c, "x": xs, "y": ys})

        return pd.concat(
            [
                table("v", np.arange(len(x)), xs=x, ys=y),
                table("t", np.arange(len(tri)), tri[:, 0], tri[:, 1], tri[:, 2],
                      x[tri].mean(axis=1), y[tri].mean(axis=1)),
                table("e", ring, ring, nxt, (pdf["part"].to_numpy()[ring] == 0).astype(np.int64)),
            ],
            ignore_index=True,
        )

    return run


def polygon_mesh_id(key: list[str]) -> Column:
    return F.concat_ws("/", *key)


def delaunay(rings: DataFrame, density: float | None = 1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delaunay triangles of the boundary (and interior) points of each polygon.

    Returns ``vertices``, ``triangles`` (with centroid ``x, y``) and boundary ``edges``, all keyed by
    polygon. Boundary points come first, exterior before holes, then interior points.
    """
    key = poly_key(rings)
    none = F.lit(0).cast("long")
    points = rings.select(
        *key, F.when(F.col("role") == "exterior", 0).otherwise(1).alias("part"), "ring_id",
        F.col("seq").cast("long").alias("seq"), none.alias("i"), none.alias("j"), "x", "y",
    )
    if density is not None:
        inner = interior_points(rings, density).select(
            *key, F.lit(2).alias("part"), none.alias("ring_id"), none.alias("seq"),
            F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "x", "y",
        )
        points = points.unionByName(inner)
    schema = rings.select(*key).schema.add("kind", "string")
    for c in ("id", "a", "b", "c"):
        schema = schema.add(c, "long")
    schema = schema.add("x", "double").add("y", "double")
    points = cut(points)  # counted, then solved
    large = cut(points.groupBy(*key).agg(F.count("*").alias("_n")).filter(F.col("_n") > DELAUNAY_POINTS).select(*key))
    if large.isEmpty():
        out = cut(spread(points, key).groupBy(*key).applyInPandas(_solve(key), schema))
    else:
        out = spread(points.join(unbroadcast(large), key, "left_anti"), key).groupBy(*key).applyInPandas(_solve(key), schema)
        out = cut(out.unionByName(_solve_in_cells(points.join(unbroadcast(large), key, "left_semi"), key)))
    vertices = out.filter("kind = 'v'").select(*key, F.col("id").alias("vid"), "x", "y")
    triangles = out.filter("kind = 't'").select(
        *key, F.col("id").alias("tid"), F.col("a").alias("v0"), F.col("b").alias("v1"), F.col("c").alias("v2"), "x", "y"
    )
    edges = out.filter("kind = 'e'").select(*key, "a", "b", (F.col("c") == 1).alias("exterior"))
    return vertices, triangles, edges


def keep_inside_triangles(triangles: DataFrame, rings: DataFrame) -> DataFrame:
    """Triangles whose centroid (``x, y``) lies strictly inside their polygon."""
    return point_in_polygon(triangles, rings)


def triangulate_polygons(
    rings: DataFrame,
    density: float | None = 1.0,
    check_valid: bool = True,
) -> tuple[Mesh, DataFrame]:
    """Cover of each polygon as a 2-D mesh, and its boundary edges; all polygons in one job.

    Raises for invalid polygons and for polygons none of whose triangles lie inside.
    """
    key = poly_key(rings)
    rings = with_next(rings)
    if check_valid:
        if not is_valid_polygon(rings, 0.0).filter("not valid").isEmpty():
            raise ValueError("Input polygon is not valid")
    vertices, triangles, edges = delaunay(rings, density)
    inside = cut(keep_inside_triangles(triangles, rings))
    if not rings.select(*key).distinct().join(inside, key, "left_anti").isEmpty():
        raise ValueError("No valid triangles found inside polygon")
    mid = polygon_mesh_id(key).alias("mesh_id")
    levels = [c for c in ("raster_id", "level_idx") if c in key]
    return (
        Mesh(
            vertices.select(mid, *levels, "vid", "x", "y"),
            inside.select(mid, *levels, "tid", "v0", "v1", "v2"),
        ),
        edges.select(mid, *levels, "a", "b", "exterior"),
    )
