"""Session helpers: lineage cuts, size-checked small tables, joins that tolerate hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: A per-raster table of at most this many rows may travel with the plan; larger ones are joined.
SMALL_TABLE_ROWS = 10_000
#: Copies of a larger per-raster table, so that one raster's cells meet it in many tasks.
SALTS = 32


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for lineage cuts: the one the session names, else (local mode only) a fresh one."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="reliefgrid-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it again: no lineage, and the size that its files have.

    A checkpoint keeps the size estimate of its plan. Joins multiply estimates, so in a loop of joins their digits
    multiply with every round until they stall the planner and fill the driver.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pinned(df: DataFrame) -> DataFrame:
    """Materialise ``df`` with its partitions and the order of their rows; not for loops (:func:`cut`)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def unbroadcast(df: DataFrame) -> DataFrame:
    """``df`` for a join in which it grows with the input: both sides are shuffled and sorted.

    Sizes are estimated from compressed files, before rows are exploded, so a table that looks small enough to broadcast
    may hold millions of rows, which the driver would collect.
    """
    return df.hint("merge")


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` dealt by ``keys`` to as many tasks as a shuffle has, for groups that are few bytes and much work.

    Partitions of a plain grouping are merged by their bytes, which would leave such groups to one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def local_table(spark: SparkSession, rows: Sequence[Sequence], schema: str | StructType) -> DataFrame:
    """A small table that is part of the plan itself, so the planner knows its size."""
    fields = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(fields)
    columns = [pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), fields)


def bounded_rows(df: DataFrame, limit: int = SMALL_TABLE_ROWS) -> list[Row] | None:
    """The rows of ``df`` if there are at most ``limit`` of them, else None."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def salted_join(
    big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner", condition=None, salts: int = SALTS
) -> DataFrame:
    """Equi-join in which each key of ``big`` is spread over ``salts`` tasks and ``small`` repeated in them.

    No keys: every row of ``big`` meets all of ``small``. Nothing is counted or collected, so ``big`` may be a stream;
    only then may ``small`` be broadcast.
    """
    keys = list(keys)
    spread = [c for c in big.columns if c not in keys] or keys
    big = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    if not big.isStreaming:
        small = unbroadcast(small)  # its estimate knows nothing of the copies
    return _joined(big, small, [*keys, "_salt"], how, condition).drop("_salt")


def _joined(big: DataFrame, small: DataFrame, keys: list[str], how: str, condition) -> DataFrame:
    if condition is None:
        return big.join(small, keys, how)
    on = condition
    for k in keys:
        on = on & F.col(f"_b.{k}").eqNullSafe(F.col(f"_s.{k}"))
    extra = [F.col(f"_s.{c}") for c in small.columns if c not in keys]
    return big.alias("_b").join(small.alias("_s"), on, how).select("_b.*", *extra)


def attach(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    limit: int = SMALL_TABLE_ROWS,
    condition=None,
) -> DataFrame:
    """Join a per-key table to a large one whose keys may be very uneven.

    ``small`` is counted up to ``limit``: within it, its rows become part of the plan and are
    broadcast; beyond it, ``small`` is repeated under ``SALTS`` salts and ``big`` spreads each key
    over them, so a key holding a third of all rows still meets its partner in many tasks. A stream takes
    the second way uncounted: each of its batches is planned with the size ``small`` has.
    """
    rows = None if big.isStreaming else bounded_rows(small, limit)
    if rows is None:
        return salted_join(big, small, keys, how, condition)
    return _joined(big, F.broadcast(local_table(big.sparkSession, rows, small.schema)), list(keys), how, condition)
