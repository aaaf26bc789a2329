"""Queries over the driver tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# helpers of the queries reach the Python workers with their tasks
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Build
    sql: str | None
    covers: str


REGISTRY: dict[str, Query] = {}


def query(covers: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a function as the query of its own name."""

    def add(fn: Build) -> Build:
        REGISTRY[fn.__name__] = Query(fn, sql, covers)
        return fn

    return add


def load_all() -> dict[str, Query]:
    from catalog import contours, grids, meshes, pictures  # noqa: F401

    return REGISTRY
