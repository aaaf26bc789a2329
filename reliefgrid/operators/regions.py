"""Connected regions of the height mask, and connected components of any edge table."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliefgrid.operators.contour import level_keys
from reliefgrid.operators.grid import join_levels, pad
from reliefgrid.operators.tiles import TILE_BITS, TILE_KEY, tiled
from reliefgrid.runtime import bounded_rows, cut, unbroadcast

#: Levels labelled per call where every cell is returned; keeps a task's output near a tile's size.
LEVELS_PER_CALL = 16
#: Region ids and cell keys: (row + 1) * 2**32 + (col + 1), the smallest cell of the region.
KEY_SHIFT = 32


def cell_key(row, col):
    return F.shiftleft(row.cast("long") + 1, KEY_SHIFT) + col.cast("long") + 1


# ---- components of an edge table -------------------------------------------------------------


def connected_components(edges: DataFrame, by: Sequence[str] = (), max_rounds: int = 60) -> DataFrame:
    """Smallest node of each node's component: columns ``by``, ``node``, ``root``.

    ``edges`` has ``a`` and ``b`` (long) besides ``by``. Alternating star contraction (Kiveris et
    al., 2014): every round re-links neighbours to the smallest node seen, which keeps the number of
    edges from growing, and a component collapses to a star within a logarithmic number of rounds.
    Each round works on grouped minima with partial aggregation and is cut from its lineage.
    """
    by = list(by)
    a, b = F.col("a"), F.col("b")
    nodes = edges.select(*by, a.alias("node")).unionByName(edges.select(*by, b.alias("node"))).distinct()
    links = cut(
        edges.filter(a != b).select(*by, F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    )
    for _ in range(max_rounds):
        if _is_star(links, by):
            break
        both = links.unionByName(links.select(*by, b.alias("a"), a.alias("b")))
        low = both.groupBy(*by, "a").agg(F.least(F.min("b"), a).alias("m"))
        large = (
            both.join(unbroadcast(low), [*by, "a"])
            .filter(b > a)
            .select(*by, b.alias("a"), F.col("m").alias("b"))
            .filter(a != b)
        )
        low = large.groupBy(*by, "a").agg(F.min("b").alias("m"))
        small = large.join(unbroadcast(low), [*by, "a"])
        links = cut(
            small.select(*by, b.alias("a"), F.col("m").alias("b"))
            .unionByName(low.select(*by, "a", F.col("m").alias("b")))
            .filter(a != b)
            .distinct()
        )
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    roots = links.select(*by, F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.join(unbroadcast(roots), [*by, "node"], "left").select(
        *by, "node", F.coalesce("root", "node").alias("root")
    )


def _is_star(links: DataFrame, by: list[str]) -> bool:
    """Does every node hang on exactly one other node, which hangs on none?"""
    ends = F.array(
        F.struct(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")),
        F.struct(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")),
    )
    per_node = links.select(*by, F.inline(ends)).groupBy(*by, "node").agg(
        F.sum("down").alias("down"), F.max("up").alias("up")
    )
    return per_node.filter("down > 1 or (down = 1 and up = 1)").isEmpty()


# ---- regions of a grid -----------------------------------------------------------------------


def merged(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest member of the component of each of ``n`` nodes under the links ``u - v``."""
    parent = np.arange(n)
    while u.size:
        pu, pv = parent[u], parent[v]
        open_ = pu != pv
        u, v, pu, pv = u[open_], v[open_], pu[open_], pv[open_]
        np.minimum.at(parent, np.maximum(pu, pv), np.minimum(pu, pv))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


def label_mask(mask: np.ndarray, connectivity: int) -> np.ndarray:
    """Flat index of the smallest cell of each cell's region, within one tile."""
    h, w = mask.shape
    idx = np.arange(h * w).reshape(h, w)
    views = [(np.s_[:, :-1], np.s_[:, 1:]), (np.s_[:-1, :], np.s_[1:, :])]
    if connectivity == 8:
        views += [(np.s_[:-1, :-1], np.s_[1:, 1:]), (np.s_[:-1, 1:], np.s_[1:, :-1])]
    u = np.concatenate([idx[p][mask[p] & mask[q]] for p, q in views])
    v = np.concatenate([idx[q][mask[p] & mask[q]] for p, q in views])
    return merged(h * w, u, v)


def _touches(mask: np.ndarray, present: np.ndarray) -> np.ndarray:
    """Cells of ``mask`` with a side neighbour inside the tile's view that is not in ``mask``."""
    other = ~mask
    out = np.zeros_like(mask)
    out[:, :-1] |= other[:, 1:]
    out[:, 1:] |= other[:, :-1]
    out[:-1, :] |= other[1:, :]
    out[1:, :] |= other[:-1, :]
    return out & mask & present


LABEL_SCHEMA = (
    "tile long, raster_id string, level_idx int, row int, col int, high boolean, label long,"
    " own boolean, shared boolean, border boolean"
)


def _label_tile(levels, connectivity: int, sides: tuple[bool, ...], border_only: bool, bits: int):
    """Function for one tile: local regions of every level."""
    size = 1 << bits

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tile, raster = pdf["tile"].iloc[0], pdf["raster_id"].iloc[0]
        top, left = int(pdf["tile_r"].iloc[0]) * size - 1, int(pdf["tile_c"].iloc[0]) * size - 1
        r, c = pdf["row"].to_numpy() - top, pdf["col"].to_numpy() - left
        value = np.full((size + 1, size + 1), np.nan)
        present = np.zeros(value.shape, dtype=bool)
        value[r, c] = pdf["value"].to_numpy(dtype=float, na_value=np.nan)
        present[r, c] = True
        rows, cols = np.indices(value.shape)
        own = (rows > 0) & (cols > 0)
        shared = ~own | (rows == size) | (cols == size)
        key = ((rows + top + 1).astype(np.int64) << KEY_SHIFT) + (cols + left + 1)
        if "threshold" in pdf:
            todo = [(int(pdf["level_idx"].iloc[0]), float(pdf["threshold"].iloc[0]))]
        else:
            todo = levels.get(raster, []) if isinstance(levels, dict) else levels
            if "part" in pdf:
                part = int(pdf["part"].iloc[0])
                todo = todo[part * LEVELS_PER_CALL : (part + 1) * LEVELS_PER_CALL]
        parts = []
        for level, threshold in todo:
            with np.errstate(invalid="ignore"):
                mask = value >= threshold
            for high in sides:
                m = (mask if high else ~mask) & present
                if not m.any():
                    continue
                roots = label_mask(m, connectivity if high else connectivity_of_rest(connectivity))
                border = m & (_touches(m, present) | shared)
                take = border if border_only else m
                flat = np.flatnonzero(take)
                parts.append(
                    pd.DataFrame(
                        {
                            "tile": tile, "raster_id": raster, "level_idx": np.int32(level),
                            "row": (rows.ravel()[flat] + top).astype(np.int32),
                            "col": (cols.ravel()[flat] + left).astype(np.int32),
                            "high": high,
                            "label": key.ravel()[roots[flat]],
                            "own": own.ravel()[flat],
                            "shared": shared.ravel()[flat],
                            "border": border.ravel()[flat],
                        }
                    )
                )
        if not parts:
            return pd.DataFrame({n: [] for n in
                                 ("tile", "raster_id", "level_idx", "row", "col", "high", "label", "own", "shared", "border")})
        return pd.concat(parts, ignore_index=True)

    return run


def connectivity_of_rest(connectivity: int) -> int:
    """High and low cells use opposite neighbourhoods, so that borders never cross."""
    return 4 if connectivity == 8 else 8


def framed(cells: DataFrame) -> DataFrame:
    """The grid with one missing cell all round; positions keep their numbers."""
    return pad(cells, 1, None).select(
        "raster_id", (F.col("row") - 1).alias("row"), (F.col("col") - 1).alias("col"), "value"
    )


def region_labels(
    cells: DataFrame,
    levels: DataFrame,
    connectivity: int = 4,
    sides: tuple[bool, ...] = (True,),
    border_only: bool = False,
    tile_bits: int = TILE_BITS,
) -> DataFrame:
    """Region of each cell per level: ``tile, raster_id, level_idx, row, col, high, own, border, region``.

    Regions are found inside tiles first; only labels meeting in the cells that neighbouring tiles
    share enter the distributed component search, so its size follows the tile edges rather than
    the grid. With ``border_only`` just the cells along contours (and tile edges) are returned, those of ``border``.
    """
    lv = level_keys(levels)
    placed = tiled(cells, before=1, after=0, bits=tile_bits)
    rows = bounded_rows(lv)
    keys = list(TILE_KEY)
    plan: dict | list = []
    if rows is None:
        placed = join_levels(placed, lv, F.lit(True))
        keys.append("level_idx")
    elif "raster_id" in lv.columns:
        plan = {}
        for r in rows:
            plan.setdefault(r["raster_id"], []).append((r["level_idx"], r["threshold"]))
    else:
        plan = [(r["level_idx"], r["threshold"]) for r in rows]
    most = max(map(len, plan.values()), default=0) if isinstance(plan, dict) else len(plan)
    if not border_only and most > LEVELS_PER_CALL:
        parts = F.sequence(F.lit(0), F.lit((most - 1) // LEVELS_PER_CALL))
        placed = placed.withColumn("part", F.explode(parts))
        keys.append("part")
    local = cut(
        placed.groupBy(*keys).applyInPandas(
            _label_tile(plan, connectivity, sides, border_only, tile_bits), LABEL_SCHEMA
        )
    )
    by = ["raster_id", "level_idx", "high"]
    meets = (
        local.filter("shared")
        .groupBy(*by, "row", "col")
        .agg(F.min("label").alias("b"), F.collect_set("label").alias("_l"))
        .filter(F.size("_l") > 1)
        .select(*by, F.explode("_l").alias("a"), "b")
        .filter("a <> b")
        .distinct()
    )
    out = ["tile", "raster_id", "level_idx", "row", "col", "high", "own", "border"]
    meets = cut(meets)
    if meets.isEmpty():
        return local.select(*out, F.col("label").alias("region"))
    roots = connected_components(meets, by).withColumnRenamed("node", "label")
    return local.join(unbroadcast(roots), [*by, "label"], "left").select(
        *out, F.coalesce("root", "label").alias("region")
    )


def label_components(
    cells: DataFrame, levels: DataFrame, connectivity: int = 4, high: bool = True, tile_bits: int = TILE_BITS
) -> DataFrame:
    """Region of every high (or low) cell per level, named by its smallest cell.

    ``connectivity`` is that of the requested cells. Low regions include the outside of the grid,
    which counts as one frame of missing cells.
    """
    conn = connectivity if high else connectivity_of_rest(connectivity)
    grid = cells if high else framed(cells)
    labels = region_labels(grid, levels, conn, (high,), tile_bits=tile_bits).filter("own")
    return labels.select("raster_id", "level_idx", "row", "col", "region")


def region_sizes(labels: DataFrame) -> DataFrame:
    """Cells per region."""
    return labels.groupBy("raster_id", "level_idx", "region").agg(F.count("*").alias("cells"))
