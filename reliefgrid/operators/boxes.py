"""Pairs of boxes that meet, whatever their sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliefgrid.runtime import attach, unbroadcast


def box_pairs(boxes: DataFrame, by: Sequence[str] = ("mesh_id",), axes: str = "xyz", ident: str = "tid") -> DataFrame:
    """Pairs ``a, b`` (structs of the columns of ``boxes``) of one group ``by`` whose closed boxes meet, each once.

    ``boxes`` has the group, an id unique in it, and ``lo_x``, ``hi_x`` and so on. A box lives in cells no smaller than itself, of
    which it meets two per axis at most, and visits the cells of every larger size in use. A pair meets in the size of its
    larger box and is taken in the one cell that holds the lowest corner of what the two share. So a large box among small
    ones costs no more rows than they do, and boxes far from each other never meet.
    """
    by = list(by)
    columns = [c for c in boxes.columns if c not in by]
    longest = F.greatest(*[F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in axes])
    sized = boxes.withColumn("_k", F.when(longest > 0, F.ceil(F.log2(longest)).cast("int")))
    sized = sized.withColumn("_k", F.when(F.pow(F.lit(2.0), F.col("_k")) < longest, F.col("_k") + 1).otherwise(F.col("_k")))
    used = sized.groupBy(*by).agg(F.sort_array(F.collect_set("_k")).alias("_used"))
    sized = attach(sized, used.withColumn("_used", F.when(F.size("_used") > 0, F.col("_used")).otherwise(F.array(F.lit(0)))), by)
    # a box without extent lives in the smallest cells
    sized = sized.withColumn("_k", F.coalesce("_k", F.col("_used")[0]))

    def in_cells(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.withColumn("_side", F.pow(F.lit(2.0), F.col("_s")))
        for c in axes:
            span = F.sequence(F.floor(F.col(f"lo_{c}") / F.col("_side")), F.floor(F.col(f"hi_{c}") / F.col("_side")))
            rows = rows.withColumn(f"_c{c}", F.explode(span))
        return rows.select(*by, "_s", "_k", *[f"_c{c}" for c in axes], F.struct(*columns).alias(name))

    home = in_cells(sized.withColumn("_s", F.col("_k")), "b").drop("_k")
    guests = in_cells(sized.withColumn("_s", F.explode(F.filter("_used", lambda s: s >= F.col("_k")))), "a")
    met = guests.join(unbroadcast(home), [*by, "_s", *[f"_c{c}" for c in axes]])
    keep = (F.col("_k") < F.col("_s")) | (F.col(f"a.{ident}") < F.col(f"b.{ident}"))
    for c in axes:
        low = F.greatest(F.col(f"a.lo_{c}"), F.col(f"b.lo_{c}"))
        keep = keep & (low <= F.least(F.col(f"a.hi_{c}"), F.col(f"b.hi_{c}"))) & (F.floor(low / F.pow(F.lit(2.0), F.col("_s"))) == F.col(f"_c{c}"))
    return met.filter(keep).select(*by, "a", "b")
