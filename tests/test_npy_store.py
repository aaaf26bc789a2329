"""Blocks of cells as a Spark data source: round trips, commits and aborts."""

import json
import os

import numpy as np
import pytest
from conftest import to_array
from pyspark.sql import functions as F

from reliefgrid.sources import npy


def parts(path):
    return sorted(f for f in os.listdir(path) if not f.startswith("_")) if os.path.isdir(path) else []


def test_round_trip_over_blocks(make, spark, tmp_path):
    path = str(tmp_path / "store")
    a = np.arange(1100.0 * 3).reshape(1100, 3)
    a[7, 1] = a[1099, 2] = np.nan
    npy.save_npy(make(a, "x/y z").filter("row <> 600 or col <> 0"), path)
    npy.save_npy(make(np.arange(4.0).reshape(2, 2), "007"), "file:" + path)
    a[600, 0] = np.nan
    back = npy.read_npy(spark, path)
    assert np.array_equal(to_array(back.filter("raster_id = 'x/y z'")), a, equal_nan=True)
    assert sorted(r.value for r in back.filter("raster_id = '007'").collect()) == [0, 1, 2, 3]
    assert back.groupBy("raster_id", "row", "col").count().filter("count > 1").isEmpty()
    assert sum(f.endswith(".npy") for f in parts(path)) == 4  # 512 rows a block


def test_overwrite_replaces_and_removes(make, spark, tmp_path):
    path = str(tmp_path / "store")
    npy.save_npy(make(np.ones((2, 2))), path)
    first = set(parts(path))
    npy.save_npy(make(np.full((1, 2), 5.0)), path, mode="overwrite")
    assert not first & set(parts(path))
    assert [r.value for r in npy.read_npy(spark, path).collect()] == [5.0, 5.0]


def test_a_failed_task_leaves_nothing(make, spark, tmp_path):
    path = str(tmp_path / "store")
    npy.save_npy(make(np.ones((2, 2))), path)
    before, manifest = parts(path), (tmp_path / "store" / "_parts.json").read_text()
    cells = make(np.arange(6.0).reshape(2, 3), "bad")
    spark.dataSource.register(npy.NpyDataSource)
    for wrong in (
        cells.coalesce(1).filter("row <> 1 or col <> 1"),  # a rectangle with a hole
        cells.coalesce(1).union(cells.coalesce(1).limit(1)).coalesce(1),  # a cell twice
        cells.coalesce(1).withColumn("row", F.when(F.col("col") < 2, F.col("row"))),  # no row
    ):
        with pytest.raises(Exception, match="full rectangle|no null"):
            wrong.write.format("npy").mode("append").save(path)
        assert parts(path) == before and (tmp_path / "store" / "_parts.json").read_text() == manifest
    with pytest.raises(Exception, match="columns missing"):
        cells.drop("value").write.format("npy").mode("append").save(path)


def test_abort_removes_what_other_tasks_wrote(make, tmp_path):
    path = str(tmp_path / "store")
    writer = npy.NpyWriter(path, overwrite=False)
    batch = make(np.arange(6.0).reshape(2, 3)).orderBy("row", "col").toArrow().to_batches()
    message = writer.write(iter(batch))
    assert message.blocks == 1 and len(parts(path)) == 2
    writer.abort([message, None])
    assert parts(path) == []
    done = writer.write(iter(batch))
    writer.commit([done, None])
    assert json.loads((tmp_path / "store" / "_parts.json").read_text()) == {"lists": [[done.listing, 1]]}


def test_empty_cells_and_unlisted_files(make, spark, tmp_path):
    path = str(tmp_path / "store")
    npy.save_npy(make(np.ones((1, 1))).filter("row < 0"), path)
    (tmp_path / "store" / "part-lost-0.npy").write_bytes(b"left by a lost executor")
    assert npy.read_npy(spark, path).count() == 0


@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("dtype", ["<f4", ">i2", "<f8"])
def test_plain_files_are_cut_by_the_tasks(spark, tmp_path, monkeypatch, order, dtype):
    a = np.asarray(np.arange(35).reshape(5, 7), dtype=dtype, order=order)
    np.save(tmp_path / "g.npy", a)
    reader = npy.NpyReader(str(tmp_path))
    assert len(reader.partitions()) == 1
    monkeypatch.setattr(npy, "BATCH_CELLS", 4)
    got = np.full((5, 7), np.nan)
    for k in range(3):
        for b in reader.read(npy.FileShare(str(tmp_path / "g.npy"), k, 3)):
            assert b.num_rows <= 4
            p = b.to_pandas()
            assert np.isnan(got[p["row"], p["col"]]).all()
            got[p["row"], p["col"]] = p["value"]
    assert np.array_equal(got, a)


def test_planning_opens_no_file(spark, tmp_path, monkeypatch):
    for i in range(3):
        np.save(tmp_path / f"{i}.npy", np.zeros((2, 2)))
    monkeypatch.setattr("builtins.open", lambda *a, **k: pytest.fail("opened while planning"))
    monkeypatch.setattr(npy, "_header", lambda f: pytest.fail("header read while planning"))
    assert len(npy.NpyReader(str(tmp_path)).partitions()) == 3
