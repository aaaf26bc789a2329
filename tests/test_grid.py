import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import to_array
from reliefgrid.config import TerrainSettings
from reliefgrid.operators import fill, grid


def test_validation_messages(make):
    a = np.ones((5, 5))
    grid.validate_cells(make(a))
    grid.validate_cells(make([[1.0]]))
    for bad in (np.nan, np.inf, -np.inf):
        a[2, 2] = bad
        with pytest.raises(ValueError, match="non-finite"):
            grid.validate_cells(make(a))
    with pytest.raises(ValueError):
        grid.validate_cells(make(np.ones((2, 2))).limit(0))
    with pytest.raises(ValueError, match="must be 2D"):
        grid.validate_cells(make(np.ones((3, 3))).filter("row <> 1 or col <> 1"))
    with pytest.raises(ValueError, match="must be 2D"):
        grid.require_2d(make(np.ones((2, 2))).drop("col"))


@pytest.mark.parametrize("a,lo,hi", [([[0, 5, 10], [2, 8, 6]], 0, 1), ([[1, 3, 5], [2, 4, 6]], -10, 10), ([[-5, 0, 5], [-2, 3, 1]], 0, 1)])
def test_normalize(make, a, lo, hi):
    out = to_array(grid.normalize_cells(make(a), lo, hi))
    assert out.min() == lo and out.max() == hi and out.shape == np.shape(a)


def test_normalize_constant_and_bad_range(make):
    assert (to_array(grid.normalize_cells(make(np.full((2, 2), 5.0)), 0, 1)) == 0.5).all()
    with pytest.raises(ValueError):
        grid.normalize_cells(make([[1.0]]), 1, 1)


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(0, 0, float("nan")), (0, 1, 2.0)], "a int, b int, v double")
    out = grid.to_cells(df, "a", "b", "v")
    assert [r["value"] for r in out.orderBy("col").collect()] == [None, 2.0]


def test_pad_matches_numpy(make):
    a = np.arange(12.0).reshape(3, 4)
    for width in (1, 4):
        assert np.array_equal(to_array(grid.pad(make(a), width, -7.0)), np.pad(a, width, constant_values=-7.0))


def test_pad_of_chunked_border(make, monkeypatch):
    monkeypatch.setattr(grid, "BORDER_CHUNK", 5)
    a = np.arange(6.0).reshape(2, 3)
    out = grid.pad(make(a), 2, 0.0)
    assert out.count() == out.select("row", "col").distinct().count() == 6 * 7
    assert np.array_equal(to_array(out), np.pad(a, 2))


def test_many_rasters_use_the_salted_join(make, spark):
    cells = make(np.arange(6.0).reshape(2, 3), "a").unionByName(make(np.arange(6.0).reshape(2, 3) * 2, "b"))
    from reliefgrid import runtime

    stats = grid.raster_meta(cells)
    wide = runtime.attach(cells, stats, ["raster_id"], limit=1)
    near = runtime.attach(cells, stats, ["raster_id"])
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, near.select(*wide.columns).collect()))


def test_levels(spark):
    assert grid.levels_linspace(0, 50, 10) == [50 * i / 9 for i in range(10)]
    lv = grid.levels_table(spark, [1, 2, 3], base=1.0, thickness=0.5).orderBy("level_idx").collect()
    assert [r["base_z"] for r in lv] == [1.0, 1.5, 2.0]
    lv = grid.levels_table(spark, [1, 2], thickness=0.2, spacing=0.5).orderBy("level_idx").collect()
    assert [r["base_z"] for r in lv] == [0.0, 0.5]
    with pytest.raises(ValueError, match="At least one threshold"):
        grid.levels_table(spark, [])


def test_terrain(spark):
    assert to_array(grid.synth_heightmap(spark, TerrainSettings(size=50))).shape == (54, 54)
    bare = TerrainSettings(size=20, add_zero_border=False, noise_level=0.5)
    a, b = (to_array(grid.synth_heightmap(spark, bare)) for _ in range(2))
    assert a.shape == (20, 20) and a.std() > 0 and np.array_equal(a, b)


# ---- filling -----------------------------------------------------------------------------------


def frontier(a, k, rounds):
    a = a.copy()
    for _ in range(rounds):
        old = a.copy()
        for i, j in np.argwhere(np.isnan(old)):
            near = old[max(0, i - k) : i + k + 1, max(0, j - k) : j + k + 1]
            if (~np.isnan(near)).any():
                a[i, j] = np.nanmean(near)
    return a


def scan(a, k):
    a = a.copy()
    for i, j in np.argwhere(np.isnan(a)):
        near = a[max(0, i - k) : i + k + 1, max(0, j - k) : j + k + 1]
        near = near[~np.isnan(near)]
        if near.size:
            a[i, j] = near.mean()
    return a


def gappy(seed, shape, share):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 100, shape).astype(float)
    a[rng.random(shape) < share] = np.nan
    return a


@pytest.mark.parametrize("bits,k,rounds", [(2, 1, 3), (7, 1, 20), (3, 2, 2)])
def test_frontier_fill(make, bits, k, rounds):
    a = gappy(3, (21, 17), 0.85)
    got = to_array(fill.fill_missing(make(a), neighborhood=k, max_iterations=rounds, tile_bits=bits))
    np.testing.assert_allclose(got, frontier(a, k, rounds), rtol=1e-9)


@pytest.mark.parametrize("bits,k", [(1, 1), (2, 1), (3, 2), (9, 1)])
def test_reading_order_fill(make, bits, k):
    a = gappy(5, (13, 19), 0.7)
    if k + k * k > 1 << bits:
        pytest.skip("window larger than a tile")
    got = to_array(fill.fill_missing(make(a), mode="scan", neighborhood=k, tile_bits=bits))
    np.testing.assert_allclose(got, scan(a, k), rtol=1e-9)


def test_waves_follow_the_largest_gap_group(make):
    a = np.arange(48.0 * 40).reshape(48, 40)
    a[2::5, 1::5] = np.nan  # single cells all over: no tile waits for another
    assert fill.gap_waves(make(a), 1, 2).isEmpty()
    a[3::10, 1::10] = np.nan  # pairs, some of them across tiles
    a[40, 3:15] = np.nan  # and one group over several tiles
    w = fill.gap_waves(make(a), 1, 2)
    most = {(r.row, r.col): r.wave for r in w.collect()}
    assert max(most.values()) == max(v for (r, c), v in most.items() if r == 40 and 3 <= c < 15) <= 4
    assert max(v for (r, _), v in most.items() if r < 39) <= 2
    got = to_array(fill.fill_missing(make(a), mode="scan", tile_bits=2))
    np.testing.assert_allclose(got, scan(a, 1), rtol=1e-9)


def test_reading_order_joins_groups_within_reach(make):
    a = gappy(11, (24, 24), 0.12)
    a[:, 9] = np.nan
    got = to_array(fill.fill_missing(make(a), mode="scan", neighborhood=2, tile_bits=3))
    np.testing.assert_allclose(got, scan(a, 2), rtol=1e-9)


def test_reading_order_small_rows(make):
    nan = np.nan
    assert (to_array(fill.fill_missing(make([[1, nan, nan, nan]]), mode="scan")) == 1).all()
    got = to_array(fill.fill_missing(make([[nan, nan, nan, 1]]), mode="scan"))
    assert np.isnan(got[0, :2]).all() and (got[0, 2:] == 1).all()


def test_fill_keeps_what_it_cannot_reach(make):
    a = np.full((3, 3), np.nan)
    assert np.isnan(to_array(fill.fill_missing(make(a), max_iterations=50))).all()
    one = np.ones((5, 5))
    one[2, 2] = np.nan
    assert (to_array(fill.fill_missing(make(one))) == 1.0).all()
    r = fill.fill_report(make(one), fill.fill_missing(make(one))).first()
    assert (r["initial"], r["filled"], r["remaining"], r["percent"]) == (1, 1, 0, 100.0)
