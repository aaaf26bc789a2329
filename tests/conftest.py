import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from check import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("8")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    # tiny inputs: compiling stages would take longer than running them
    s.conf.set("spark.sql.codegen.wholeStage", "false")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Array (NaN = missing) -> cells; cells -> array."""
    from reliefgrid.runtime import local_table

    def build(a, raster_id="r"):
        a = np.asarray(a, dtype=float)
        rows = [
            (raster_id, i, j, None if np.isnan(a[i, j]) else float(a[i, j]))
            for i in range(a.shape[0]) for j in range(a.shape[1])
        ]
        return local_table(spark, rows, "raster_id string, row int, col int, value double").repartition(3)

    return build


def to_array(cells):
    p = cells.toPandas()
    out = np.full((p["row"].max() + 1, p["col"].max() + 1), np.nan)
    out[p["row"], p["col"]] = p["value"].astype(float)
    return out
