"""Registered queries against DuckDB on the smallest tables; ``python check.py`` compares all."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from catalog import load_all
from check import compare

SF = "/root/testdata/sf0.001"
SOME = [
    "level_outlines", "contour_segments", "regions", "rings", "ring_roles", "solid_triangles", "surface_triangles",
    "map_colors_loose", "palette", "filled_from_neighbours", "cleaned_triangles", "vertex_offsets", "interpolated_segments",
    "obj_file", "npy_files",
]


def test_registry():
    names = set(queries())
    assert set(oracle_sql()) <= names and len(names) > 80
    covered = {c for q in load_all().values() for c in q.covers.split()}
    for family, n in (("P", 16), ("G", 14), ("C", 16), ("M", 16), ("X", 13), ("E", 4)):
        missing = {f"{family}{i}" for i in range(1, n + 1)} - covered
        assert not missing, missing


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["raster_id", "level_idx", "threshold", "segments", "area", "perimeter"]
    assert df.count() == 10


@pytest.mark.parametrize("name", SOME)
def test_query(spark, name):
    result, _ = compare(spark, SF, name, queries()[name], oracle_sql()[name])
    assert result.startswith("ok"), result
