"""Totals in order without one big task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliefgrid.runtime import cut, local_table


def running_sums(rows: DataFrame, by: Sequence[str], order: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """``rows`` with running sums (own row included) of each group ``by`` in ``order``.

    Rows are range-partitioned by group and order, so a group of any size is spread over as many partitions as it fills.
    Sums run inside partitions; the groups that cross a border, fewer than partitions, get what lies before it.
    Groups have no nulls; rows that tie in ``order`` must be equal in what is summed.
    """
    by, names = list(by), list(sums)
    parts = rows.repartitionByRange(*by, *order).withColumn("_p", F.spark_partition_id())
    w = Window.partitionBy("_p", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut(parts.select("*", *[F.sum(c).over(w).alias(n) for n, c in sums.items()], *[c.alias(f"_d_{n}") for n, c in sums.items()]))
    group = F.struct(*by)
    ends = local.groupBy("_p").agg(F.min(group).alias("lo"), F.max(group).alias("hi")).collect()
    seen: dict[tuple, set[int]] = {}
    for r in ends:
        for g in (tuple(r["lo"]), tuple(r["hi"])):
            seen.setdefault(g, set()).add(r["_p"])
    crossing = [g for g, ps in seen.items() if len(ps) > 1]
    plain = local.drop(*[f"_d_{n}" for n in names])
    if not crossing:
        return plain.drop("_p")
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by)
    some = local.join(F.broadcast(local_table(rows.sparkSession, crossing, schema)), by)
    totals = some.groupBy(*by, "_p").agg(*[F.sum(f"_d_{n}").alias(n) for n in names]).collect()
    held: dict[tuple, list[int]] = {}
    carry = []
    for r in sorted(totals, key=lambda r: r["_p"]):
        before = held.setdefault(tuple(r[c] for c in by), [0] * len(names))
        carry.append((*(r[c] for c in by), r["_p"], *before))
        held[tuple(r[c] for c in by)] = [b + r[n] for b, n in zip(before, names)]
    table = local_table(rows.sparkSession, carry, schema + ", `_p` int, " + ", ".join(f"`_c_{n}` bigint" for n in names))
    out = plain.join(F.broadcast(table), [*by, "_p"], "left")
    for n in names:
        out = out.withColumn(n, F.col(n) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)))
    return out.drop("_p", *[f"_c_{n}" for n in names])
