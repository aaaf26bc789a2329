"""Filling missing cells from their neighbours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliefgrid.operators.regions import KEY_SHIFT, connected_components, merged
from reliefgrid.operators.tiles import TILE_BITS, TILE_KEY, tile_of, tiled
from reliefgrid.runtime import cut, scratch_path, unbroadcast

#: Rounds computed per exchange: a tile sees this many windows beyond its edge.
ROUNDS_PER_EXCHANGE = 8
#: Reading-order tiles are larger (512 cells), because their waves run one after the other.
SCAN_BITS = 9
_CELL = ["raster_id", "row", "col"]


def _window_mean(value: np.ndarray, k: int) -> np.ndarray:
    """Mean of the present cells in each (2k+1)-square window, NaN where there is none."""
    h, w = value.shape
    known = ~np.isnan(value)
    filled = np.where(known, value, 0.0)
    total, count = np.zeros((h, w)), np.zeros((h, w))
    p, q = np.pad(filled, k), np.pad(known, k)
    for dr in range(2 * k + 1):
        for dc in range(2 * k + 1):
            total += p[dr : dr + h, dc : dc + w]
            count += q[dr : dr + h, dc : dc + w]
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(count > 0, total / count, np.nan)


def _dense(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A tile's rows as an array of heights, with each row's position in it and its presence."""
    r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
    r, c = r - r.min(), c - c.min()
    value = np.full((r.max() + 1, c.max() + 1), np.nan)
    exists = np.zeros(value.shape, dtype=bool)
    value[r, c] = pdf["value"].to_numpy(dtype=float, na_value=np.nan)
    exists[r, c] = True
    return value, exists, r, c


def _own(pdf: pd.DataFrame, bits: int, skew: int = 0) -> np.ndarray:
    row, col = pdf["row"].to_numpy(), pdf["col"].to_numpy()
    return ((row >> bits) == pdf["tile_r"].to_numpy()) & (((col + skew * row) >> bits) == pdf["tile_c"].to_numpy())


def _filled_rows(pdf: pd.DataFrame, value: np.ndarray, r: np.ndarray, c: np.ndarray, own: np.ndarray) -> pd.DataFrame:
    """The tile's own cells that were missing and now have a height."""
    new = value[r, c]
    take = own & pdf["value"].isna().to_numpy() & ~np.isnan(new)
    out = pdf.loc[take, _CELL].copy()
    out["value"] = new[take]
    return out


FILL_SCHEMA = "raster_id string, row int, col int, value double"


def _frontier_tile(k: int, rounds: int, bits: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        value, exists, r, c = _dense(pdf)
        for _ in range(rounds):
            gap = np.isnan(value) & exists
            if not gap.any():
                break
            value[gap] = _window_mean(value, k)[gap]
        return _filled_rows(pdf, value, r, c, _own(pdf, bits))

    return run


def _gap_tiles(cells: DataFrame, reach: int, bits: int, skew: int = 0) -> DataFrame:
    """Rows of the tiles that hold missing cells, with everything in reach of them.

    Tiles meet by their hash, by which they are placed already; one that shares it with another has no missing cells and adds nothing.
    """
    column = F.col("col") + F.col("row") * skew
    gaps = (
        cells.filter("value is null")
        .select(F.xxhash64("raster_id", tile_of(F.col("row"), bits), tile_of(column, bits)).alias("tile"))
        .distinct()
    )
    placed = tiled(cells, reach, reach, bits, skew, skew * reach)
    return placed.join(unbroadcast(gaps), "tile", "left_semi")


def _apply(cells: DataFrame, filled: DataFrame) -> DataFrame:
    """Put new heights into their missing cells; only missing cells take part in the join."""
    gaps = cells.filter("value is null").select(*_CELL)
    new = gaps.join(unbroadcast(filled), _CELL, "left").select(*_CELL, "value")
    return cells.filter("value is not null").select(*_CELL, "value").unionByName(new)


def fill_missing(
    cells: DataFrame,
    mode: str = "frontier",
    neighborhood: int = 1,
    max_iterations: int = 100,
    tile_bits: int | None = None,
) -> DataFrame:
    """Missing cells become the mean of the present cells in their (2k+1)-square window.

    ``mode="frontier"``: all missing cells of a round at once, round after round until nothing is
    left to fill or ``max_iterations`` is reached. Tiles carry several windows of surroundings and
    compute that many rounds per exchange; only tiles with missing cells take part.

    ``mode="scan"``: one pass in reading order in which a filled cell feeds the following ones.
    """
    if mode == "scan":
        return _fill_scan(cells, neighborhood, SCAN_BITS if tile_bits is None else tile_bits)
    if mode != "frontier":
        raise ValueError(f"Unknown fill mode: {mode}")
    tile_bits = TILE_BITS if tile_bits is None else tile_bits
    k = neighborhood
    per_pass = max(1, min(ROUNDS_PER_EXCHANGE, (1 << tile_bits) // k))
    left = max_iterations
    while left > 0:
        rounds = min(per_pass, left)
        filled = (
            _gap_tiles(cells, rounds * k, tile_bits)
            .groupBy(*TILE_KEY)
            .applyInPandas(_frontier_tile(k, rounds, tile_bits), FILL_SCHEMA)
        )
        left -= rounds
        if left == 0:
            return _apply(cells, filled)
        filled = cut(filled)
        if filled.isEmpty():
            return cells
        cells = cut(_apply(cells, filled))
        if cells.filter("value is null").isEmpty():
            return cells
    return cells


def _offsets(k: int) -> list[tuple[int, int]]:
    """Steps to the cells of a window that come later in reading order."""
    return [(dr, dc) for dr in range(k + 1) for dc in range(-k, k + 1) if (dr, dc) > (0, 0)]


GROUP_SCHEMA = "raster_id string, row int, col int, diagonal int, own boolean, meets boolean, key long, label long"


def _group_tile(k: int, bits: int):
    """Gap groups that go on in other tiles: the tile's own cells, and the cells beyond that they meet."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "col"], ignore_index=True)  # the first of a group has its smallest key
        row, col = pdf["row"].to_numpy(np.int64), pdf["col"].to_numpy(np.int64)
        own, n = _own(pdf, bits, k), len(pdf)
        r, c = row - row.min() + k, col - col.min() + k
        place = np.full((r.max() + k + 1, c.max() + k + 1), -1)
        place[r, c] = np.arange(n)
        near = [(np.arange(n), place[r + dr, c + dc]) for dr, dc in _offsets(k)]
        u = np.concatenate([x[y >= 0] for x, y in near])
        v = np.concatenate([y[y >= 0] for _, y in near])
        first = merged(n, u, v)
        leaves = np.zeros(n, dtype=bool)
        leaves[first[~own]] = True
        meets = np.zeros(n, dtype=bool)
        across = own[u] != own[v]
        meets[u[across]] = meets[v[across]] = True
        key = ((row + 1) << KEY_SHIFT) + col + 1
        out = pdf[_CELL].assign(
            diagonal=pdf["tile_r"] + pdf["tile_c"], own=own, meets=meets, key=key, label=key[first]
        )
        return out[(own & leaves[first]) | meets]

    return run


def gap_waves(cells: DataFrame, k: int, bits: int) -> DataFrame:
    """Missing cells that wait for other tiles, with the wave that fills them; all others belong to wave 0.

    Missing cells within ``k`` of each other form groups; only cells of one group can wait for each other. Groups
    inside one tile need no order of tiles. In the others a wave is one diagonal of tiles, counted from the first one
    the group enters, so the number of waves follows the largest group and not the raster.
    """
    gaps = cells.filter("value is null").select(*_CELL)
    seen = cut(
        tiled(gaps, k, k, bits, k, k * k).groupBy(*TILE_KEY).applyInPandas(_group_tile(k, bits), GROUP_SCHEMA)
    )
    links = seen.filter("meets").select("raster_id", F.col("key").alias("a"), F.col("label").alias("b"))
    if links.isEmpty():
        return seen.select(*_CELL, F.col("diagonal").alias("wave"))
    roots = connected_components(links, ["raster_id"])
    labels = seen.filter("own").select("raster_id", "label", "diagonal").distinct()
    labels = cut(labels.join(unbroadcast(roots.withColumnRenamed("node", "label")), ["raster_id", "label"]))
    start = labels.groupBy("raster_id", "root").agg(F.min("diagonal").alias("start"))
    starts = labels.join(unbroadcast(start), ["raster_id", "root"]).select("raster_id", "label", "start").distinct()
    return seen.filter("own").join(unbroadcast(starts), ["raster_id", "label"]).select(
        *_CELL, (F.col("diagonal") - F.col("start")).alias("wave")
    )


STAGE_SCHEMA = "wave int, tile long, raster_id string, tile_r int, tile_c int, row int, col int, value double, todo boolean"


def _stage_tile(k: int, bits: int):
    """Per wave the tile's own missing cells of it, and the cells in their windows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row, col = pdf["row"].to_numpy(np.int64), pdf["col"].to_numpy(np.int64)
        r, c = row - row.min() + k, col - col.min() + k
        place = np.full((r.max() + k + 1, c.max() + k + 1), -1)
        place[r, c] = np.arange(len(pdf))
        wave = pdf["wave"].to_numpy(dtype=float, na_value=np.nan)
        gaps = np.flatnonzero(_own(pdf, bits, k) & pdf["value"].isna().to_numpy())
        parts = []
        for w in np.unique(wave[gaps]):
            todo = gaps[wave[gaps] == w]
            near = np.unique(
                np.concatenate([place[r[todo] + dr, c[todo] + dc] for dr in range(-k, k + 1) for dc in range(-k, k + 1)])
            )
            near = near[near >= 0]
            parts.append(pdf.iloc[near].assign(wave=int(w), todo=np.isin(near, todo)))
        return pd.concat(parts)[[f.split()[0] for f in STAGE_SCHEMA.split(", ")]] if parts else pdf.iloc[:0].assign(todo=False)

    return run


def _scan_tile(k: int):
    """One wave of a tile, cell by cell in reading order.

    A cell waits for those to its left and above, up to ``k`` to the right. Cells with the same
    ``col + (k + 1) * row`` never wait for each other and are filled in one step.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row, col = pdf["row"].to_numpy(np.int64), pdf["col"].to_numpy(np.int64)
        r, c = row - row.min() + k, col - col.min() + k
        value = np.full((r.max() + k + 1, c.max() + k + 1), np.nan)
        value[r, c] = pdf["value"].to_numpy(dtype=float, na_value=np.nan)
        todo = pdf["todo"].to_numpy(dtype=bool)
        i, j = r[todo], c[todo]
        step = j + (k + 1) * i
        order = np.argsort(step, kind="stable")
        i, j = i[order], j[order]
        window = np.arange(-k, k + 1)
        for one in np.split(np.arange(i.size), np.flatnonzero(np.diff(step[order])) + 1):
            if one.size == 0:
                continue
            a, b = i[one], j[one]
            near = value[a[:, None, None] + window[:, None], b[:, None, None] + window]
            known = ~np.isnan(near)
            count = known.sum(axis=(1, 2))
            total = np.where(known, near, 0.0).sum(axis=(1, 2))
            some = count > 0
            value[a[some], b[some]] = total[some] / count[some]
        return _filled_rows(pdf, value, r, c, todo)

    return run


def _fill_scan(cells: DataFrame, k: int, bits: int) -> DataFrame:
    """Reading-order pass, exact across tiles.

    A cell depends on filled cells to its left and in the rows above, also those above to the right.
    With tiles slanted by ``k`` columns per row all of these lie in tiles above or to the left, so
    within a group of missing cells the tiles of one diagonal are independent (``gap_waves``). Waves run one
    after the other, each as one job over its missing cells and their windows; the cells filled by the last two
    waves are all the state handed on.
    """
    if k + k * k > (1 << bits):
        raise ValueError("neighbourhood too large for a tile")
    spark = cells.sparkSession
    gaps = cells.filter("value is null").select(*_CELL, "value")
    late = gaps.join(unbroadcast(gap_waves(cells, k, bits)), _CELL, "left").withColumn("wave", F.coalesce("wave", F.lit(0)))
    marked = cells.filter("value is not null").select(*_CELL, "value", F.lit(None).cast("int").alias("wave")).unionByName(late)
    staged_path = scratch_path(spark, "scan")
    staged = _gap_tiles(marked, k, bits, skew=k).groupBy(*TILE_KEY).applyInPandas(_stage_tile(k, bits), STAGE_SCHEMA)
    staged.write.partitionBy("wave").parquet(staged_path)
    staged = spark.read.schema(STAGE_SCHEMA).parquet(staged_path)
    waves = [r["wave"] for r in staged.select("wave").distinct().orderBy("wave").collect()]
    done: list[tuple[int, DataFrame]] = []
    for w in waves:
        part = staged.filter(F.col("wave") == w).drop("wave")
        recent = [d for v, d in done if v >= w - 2]
        if recent and w > 0:
            known = recent[0]
            for d in recent[1:]:
                known = known.unionByName(d)
            part = part.join(unbroadcast(known.withColumnRenamed("value", "_new")), _CELL, "left")
            # a cell filled by an earlier wave is surroundings here, never one of this wave's gaps
            part = part.withColumn("value", F.coalesce("value", "_new")).drop("_new")
        out = part.groupBy(*TILE_KEY).applyInPandas(_scan_tile(k), FILL_SCHEMA)
        done.append((w, cut(out) if len(waves) > 1 else out))
    if not done:
        return cells
    filled = done[0][1]
    for _, d in done[1:]:
        filled = filled.unionByName(d)
    return _apply(cells, filled)


def fill_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Missing cells before and after, filled cells and their share, per raster."""

    def missing(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("raster_id").agg(F.count_if(F.col("value").isNull()).alias(name))

    out = missing(before, "initial").join(missing(after, "remaining"), "raster_id")
    filled = F.col("initial") - F.col("remaining")
    return out.select(
        "raster_id", "initial", "remaining", filled.alias("filled"),
        F.when(F.col("initial") > 0, filled * 100.0 / F.col("initial")).otherwise(0.0).alias("percent"),
    )
