"""Input tables of the queries and small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reliefgrid.runtime import scratch_path


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, whatever the optimizer inlines."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read again.

    For loops: a checkpoint keeps the size estimate of its plan, and a loop of joins multiplies it with
    every round until planning stalls; a written table is estimated by its files.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def one_per_key(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose (id, md5 of text) is in ``kept``; of repeated rows the first stays.

    ``kept`` has one row per (_id, _md5). All columns of ``docs`` return, whatever their names.
    """
    columns = docs.columns
    key = docs.select(
        F.col(id_col).alias("_id"),
        F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_md5"),
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"),
    )
    k = kept.select(F.col("_id").alias("_kid"), F.col("_md5").alias("_kmd5"))
    met = key.join(k, F.col("_id").eqNullSafe(F.col("_kid")) & (F.col("_md5") == F.col("_kmd5")), "left_semi")
    first = Window.partitionBy("_id", "_md5").orderBy(F.xxhash64(F.to_json("_row")))
    return met.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("_row.*")
