"""Global order without one big task: running totals over range partitions, carried across their borders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliefgrid.llm.tables import saved
from reliefgrid.runtime import local_table


def running(rows: DataFrame, by: str | None, order: Sequence[str | Column], sums: Mapping[str, Column], xors: Mapping[str, Column] | None = None) -> DataFrame:
    """``rows`` with running sums and exclusive ors (own row included) of each group, in ``order`` (long columns).

    ``by`` is a long column without nulls, or None for one order over all rows. Rows are range-partitioned by group and order, so
    a group of any size is spread over as many partitions as it fills. Totals run inside partitions; only the
    groups that cross a border get what lies before it, and of those there are fewer than partitions. Rows that
    tie in ``order`` must be equal in everything that is summed.
    """
    xors = xors or {}
    key = "_g" if by is None else by
    if by is None:
        rows = rows.withColumn(key, F.lit(0).cast("long"))
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    parts = rows.repartitionByRange(key, *order).withColumn("_p", F.spark_partition_id())
    w = Window.partitionBy("_p", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made = {n: F.sum(c).over(w) for n, c in sums.items()} | {n: F.bit_xor(c).over(w) for n, c in xors.items()}
    steps = {f"_d_{n}": c for n, c in (sums | xors).items()}
    local = saved(parts.select("*", *[c.alias(n) for n, c in (made | steps).items()]), "running")
    ends = local.groupBy("_p").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).collect()
    seen: dict[int, set[int]] = {}
    for r in ends:
        for g in (r["lo"], r["hi"]):
            seen.setdefault(g, set()).add(r["_p"])
    crossing = [(g,) for g, ps in seen.items() if len(ps) > 1]
    plain = local.drop(*steps)
    if by is None:
        plain = plain.drop(key) if not crossing else plain
    if not crossing:
        return plain.drop("_p")
    some = local.join(F.broadcast(local_table(rows.sparkSession, crossing, f"`{key}` bigint")), key)
    totals = some.groupBy(key, "_p").agg(*[F.sum(f"_d_{n}").alias(n) for n in sums], *[F.bit_xor(f"_d_{n}").alias(n) for n in xors])
    held: dict[int, dict[str, int]] = {}
    carry = []
    for r in sorted(totals.collect(), key=lambda r: (r[key], r["_p"])):
        before = held.setdefault(r[key], dict.fromkeys([*sums, *xors], 0))
        carry.append((r[key], r["_p"], *(before[n] for n in [*sums, *xors])))
        held[r[key]] = {n: before[n] + r[n] for n in sums} | {n: before[n] ^ r[n] for n in xors}
    table = local_table(rows.sparkSession, carry, f"`{key}` bigint, `_p` int, " + ", ".join(f"`_c_{n}` bigint" for n in [*sums, *xors]))
    out = plain.join(F.broadcast(table), [key, "_p"], "left")
    for n in sums:
        out = out.withColumn(n, F.col(n) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)))
    for n in xors:
        out = out.withColumn(n, F.col(n).bitwiseXOR(F.coalesce(F.col(f"_c_{n}"), F.lit(0).cast("long"))))
    return out.drop("_p", *(f"_c_{n}" for n in [*sums, *xors]), *([key] if by is None else []))
