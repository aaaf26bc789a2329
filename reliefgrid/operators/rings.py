"""Closed rings from directed segments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliefgrid.operators.contour import contour_segments
from reliefgrid.operators.tiles import TILE_BITS, TILE_KEY
from reliefgrid.runtime import cut, unbroadcast

#: Point keys and ring ids: (y + 4) * 2**32 + (x + 4) of a doubled coordinate.
POINT_SHIFT = 32
POINT_OFFSET = 4
RING_KEY = ["raster_id", "level_idx", "ring_id"]


def point_key(x, y):
    return F.shiftleft(y.cast("long") + POINT_OFFSET, POINT_SHIFT) + x.cast("long") + POINT_OFFSET


def chain(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order segments that follow each other: head index, position and whether the chain is closed.

    A closed chain begins at its smallest start. Positions come from pointer doubling, all segments
    at once.
    """
    n = len(start)
    order = np.argsort(start)
    at = np.searchsorted(start[order], end)
    at[at == n] = 0
    nxt = order[at]
    found = start[nxt] == end
    prev = np.full(n, -1)
    prev[nxt[found]] = np.flatnonzero(found)

    def climb(jump, fold):
        jump = jump.copy()
        for _ in range(max(int(n).bit_length(), 1)):
            live = np.flatnonzero(jump >= 0)
            if not live.size:
                break
            to = jump[live]
            fold(live, to)
            jump[live] = jump[to]
        return jump

    low = start.copy()

    def smallest(live, to):
        low[live] = np.minimum(low[live], low[to])

    closed = climb(prev, smallest) >= 0
    prev[closed & (low == start)] = -1
    pos = (prev >= 0).astype(np.int64)
    head = np.where(prev >= 0, prev, np.arange(n))

    def rank(live, to):
        pos[live] += pos[to]
        head[live] = head[to]

    climb(prev, rank)
    return head, pos, closed


CHAIN_EXTRA = "path long, pos long, closed boolean, tail long, length long, low long, low_pos long"
_SEGMENT_COLS = ["x1", "y1", "x2", "y2", "hx1", "hy1", "hx2", "hy2", "lx", "ly"]
CHAIN_SCHEMA = (
    "tile long, raster_id string, level_idx int, " + ", ".join(f"{c} int" for c in _SEGMENT_COLS) + ", " + CHAIN_EXTRA
)


def _keys(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((y.astype(np.int64) + POINT_OFFSET) << POINT_SHIFT) + x.astype(np.int64) + POINT_OFFSET


def _chain_tile(pdf: pd.DataFrame) -> pd.DataFrame:
    """Chains of one level within one tile; the row at position 0 also describes the whole chain."""
    g = pdf.reset_index(drop=True)
    start = _keys(g["x1"].to_numpy(), g["y1"].to_numpy())
    end = _keys(g["x2"].to_numpy(), g["y2"].to_numpy())
    head, pos, closed = chain(start, end)
    n = len(g)
    length = np.bincount(head, minlength=n)[head]
    by_pos = np.lexsort((pos, head))
    tail = np.zeros(n, dtype=np.int64)
    last = by_pos[pos[by_pos] == length[by_pos] - 1]
    tail[head[last]] = end[last]
    by_start = np.lexsort((start, head))
    first = by_start[np.r_[True, np.diff(head[by_start]) != 0]]
    low, low_pos = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    low[head[first]], low_pos[head[first]] = start[first], pos[first]
    extra = dict(path=start[head], pos=pos, closed=closed, tail=tail, length=length, low=low, low_pos=low_pos)
    return g[["tile", "raster_id", "level_idx", *_SEGMENT_COLS]].assign(**extra)


def _join_paths(paths: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Ring, offset and ring length of every open path: pointer doubling over paths, not segments.

    Every path looks 1, 2, 4, ... paths ahead and keeps the smallest point seen and the number of
    segments up to it. Once neighbours agree on the smallest point it is the ring's.
    """
    by = ["raster_id", "level_idx"]
    state = cut(
        paths.select(
            *by, "path", "length", F.col("tail").alias("nxt"), F.col("low").alias("m"), F.col("low_pos").alias("d"),
            F.col("length").alias("w"),
        )
    )
    for _ in range(max_rounds):
        ahead = state.select(
            *by, F.col("path").alias("nxt"), F.col("nxt").alias("nxt2"),
            *[F.col(c).alias(f"{c}2") for c in ("m", "d", "w")],
        )
        joined = cut(state.join(unbroadcast(ahead), [*by, "nxt"]))
        if joined.filter("m <> m2").isEmpty():
            break
        nearer = F.col("m") <= F.col("m2")
        state = joined.select(
            *by, "path", "length", F.col("nxt2").alias("nxt"), F.least("m", "m2").alias("m"),
            F.when(nearer, F.col("d")).otherwise(F.col("w") + F.col("d2")).alias("d"),
            (F.col("w") + F.col("w2")).alias("w"),
        )
    else:
        raise RuntimeError("rings did not close; raise max_rounds")
    found = joined.select(*by, "path", "length", F.col("m").alias("ring_id"), "d")
    sizes = found.groupBy(*by, "ring_id").agg(F.sum("length").alias("ring_length"))
    return found.join(unbroadcast(sizes), [*by, "ring_id"]).select(
        *by, "path", "ring_id", (F.col("ring_length") - F.col("d")).alias("off"), "ring_length"
    )


def trace_rings(
    cells: DataFrame, levels: DataFrame, saddles: str = "low", keep_frame: bool = False, tile_bits: int = TILE_BITS
) -> DataFrame:
    """Segments with the ring they belong to and their place on it.

    Columns: ``raster_id, level_idx, ring_id, seq, x1, y1, x2, y2`` (doubled), the bordering cells
    and ``tile``. A ring begins at, and is named by, its smallest start point. Chains are built per
    tile; only chains that leave a tile are linked across tiles. The ring round an all-high grid
    follows the frame only and is dropped unless ``keep_frame``.
    """
    segments = contour_segments(cells, levels, saddles=saddles, tile_bits=tile_bits, detail=True)
    local = cut(
        segments.select(*TILE_KEY, "level_idx", *_SEGMENT_COLS)
        .groupBy(*TILE_KEY, "level_idx")
        .applyInPandas(_chain_tile, CHAIN_SCHEMA)
    )
    cols = [*RING_KEY, "seq", *_SEGMENT_COLS, "tile"]
    rings = local.filter("closed").withColumnsRenamed({"path": "ring_id", "pos": "seq"}).select(*cols)
    open_ = local.filter("not closed")
    paths = open_.filter("pos = 0").select("raster_id", "level_idx", "path", "tail", "length", "low", "low_pos")
    if not paths.isEmpty():
        placed = open_.join(unbroadcast(_join_paths(paths)), ["raster_id", "level_idx", "path"])
        seq = (F.col("off") + F.col("pos")) % F.col("ring_length")
        rings = rings.unionByName(placed.withColumn("seq", seq).select(*cols))
    if keep_frame:
        return rings
    return drop_frame_rings(rings, cells)


def drop_frame_rings(rings: DataFrame, cells: DataFrame) -> DataFrame:
    """Remove the ring of an all-high grid, all of whose segments lie on the outside of the grid."""
    from reliefgrid.operators.grid import raster_meta
    from reliefgrid.runtime import attach

    meta = raster_meta(cells)
    sized = attach(rings.select("raster_id", "level_idx", "ring_id", "lx", "ly"), meta, ["raster_id"])
    outside = (
        (F.col("lx") < 0) | (F.col("ly") < 0)
        | (F.col("lx") >= F.col("width") * 2) | (F.col("ly") >= F.col("height") * 2)
    )
    per_ring = sized.groupBy(*RING_KEY).agg(F.min(outside).alias("_frame"))
    # such a ring covers the whole grid; it is left out only where nothing else was found
    alone = (
        per_ring.groupBy("raster_id", "level_idx")
        .agg(F.count("*").alias("_n"), F.max("_frame").alias("_frame"), F.max("ring_id").alias("ring_id"))
        .filter("_n = 1 and _frame")
        .select(*RING_KEY)
    )
    return rings.join(alone, RING_KEY, "left_anti")


def ring_table(rings: DataFrame) -> DataFrame:
    """One row per ring: points, signed area, and the cells and tile at its first segment."""
    cross = F.col("x1").cast("long") * F.col("y2") - F.col("x2").cast("long") * F.col("y1")
    first = [F.max(F.when(F.col("seq") == 0, F.col(c))).alias(c) for c in ("tile", "hx1", "hy1", "lx", "ly")]
    return rings.groupBy(*RING_KEY).agg(F.count("*").alias("points"), (F.sum(cross) / 8.0).alias("area"), *first)


def drop_collinear(points: DataFrame, key: list[str]) -> DataFrame:
    """Leave out ring points whose neighbours lie straight before and after them.

    ``points`` has ``seq, x, y, nx, ny`` (next point); kept points are linked to the next kept one.
    """
    from pyspark.sql import Window

    before = points.select(
        *key, F.col("nx").alias("x"), F.col("ny").alias("y"), F.col("x").alias("px"), F.col("y").alias("py")
    )
    joined = points.join(unbroadcast(before), [*key, "x", "y"])
    turn = (F.col("x") - F.col("px")) * (F.col("ny") - F.col("y")) != (F.col("y") - F.col("py")) * (
        F.col("nx") - F.col("x")
    )
    return joined.filter(turn).drop("px", "py", "nx", "ny")
