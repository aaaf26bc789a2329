"""Sharding by balanced label propagation, DataFrame functions only.

Documents that belong together (here: with equal texts) are members of a group. Each starts in a
shard drawn by hash; round by round every group names the shard with most of its members that still
has room, members elsewhere propose to move there, and a shard accepts proposals up to its quota,
small groups first, so groups come together while no shard outgrows its size. Documents without links
cost nothing wherever they are: they fill the shards up to exactly equal counts (law ``rows``: at most
one apart). A group larger than a shard fills one shard after another.

Every step is a join or a grouping: votes are counted per (group, shard) with partial aggregation, the
quotas are decided on histograms of at most shards x classes rows, and ranks are counted in hashed
buckets, so no group, shard or key is ever gathered in one task.

Results: a null text has no bytes and groups with the empty text; repeated rows are documents of their
own and each gets a slot; null ids are kept; an empty table gives an empty one; fewer documents than
shards leave shards empty; the choice among equal votes falls to the lowest shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliefgrid.llm.tables import saved, whole_text

SHARDS = 40
ROUNDS = 8
#: Bytes that a document counts for besides its text.
OVERHEAD = 16
#: Hashed buckets that ranks are counted in.
BUCKETS = 256
#: Hash classes per size class of groups, in which a shard accepts proposals.
CLASSES = 32


def ranked(df: DataFrame, keys: list[str], by: Column, name: str, buckets: int = BUCKETS) -> DataFrame:
    """Adds ``name``: a gapless number from 0 within ``keys``, counted in hashed buckets of ``by``."""
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int"))
    sizes = df.groupBy(*keys, "_bucket").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(by)
    # at most keys x buckets rows
    out = df.withColumn("_at", F.row_number().over(inside) - 1).join(offsets, [*keys, "_bucket"])
    return out.withColumn(name, F.col("_before") + F.col("_at")).drop("_bucket", "_before", "_at")


def propagate(nodes: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``node``, ``shard`` for all ``nodes`` (distinct longs ``node``); ``links`` has (node, group).

    Counts of shards are at most one apart.
    """
    spark = nodes.sparkSession
    start = F.pmod(F.xxhash64("node", F.lit("start")), F.lit(shards)).cast("int")
    total = nodes.count()
    quota = total // shards
    sizes = links.groupBy("group").agg(F.count("*").alias("_n")).filter("_n > 1")
    member = saved(links.join(sizes, "group").select("node", "group", "_n"), "member")
    linked = saved(member.select("node").distinct().select("node", start.alias("shard")), "linked")
    every = spark.range(shards).select(F.col("id").cast("int").alias("shard"))
    size_class = (F.floor(F.log2("_n")) * CLASSES + F.pmod(F.xxhash64("group"), F.lit(CLASSES))).cast("int")
    for turn in range(rounds):
        load = linked.groupBy("shard").agg(F.count("*").alias("_load"))
        room = F.broadcast(every.join(load, "shard", "left").select("shard", (F.lit(quota) - F.coalesce("_load", F.lit(0))).alias("_room")))
        placed = member.join(linked, "node")
        votes = placed.groupBy("group", "_n", "shard").agg(F.count("*").alias("_votes"))
        best = votes.join(room, "shard").filter("_room > 0").groupBy("group").agg(F.max(F.struct("_votes", (-F.col("shard")).alias("_dst"))).alias("_best"))
        # a member moves if more of its group sits there than with it; of several groups the strongest decides
        seen = votes.join(best, "group").select("group", "shard", "_n", "_votes", "_best")
        wish = seen.filter((F.col("shard") != -F.col("_best._dst")) & (F.struct("_votes", -F.col("shard")) < F.struct("_best._votes", "_best._dst")))
        wish = wish.select("group", "shard", (-F.col("_best._dst")).alias("_to"), F.col("_best._votes").alias("_pull"), size_class.alias("_class"))
        moves = placed.select("node", "group", "shard").join(wish, ["group", "shard"])
        strongest = F.max(F.struct("_pull", (-F.col("_to")).alias("_to"), (-F.col("_class")).alias("_class")))
        moves = moves.groupBy("node").agg(strongest.alias("_m"))
        moves = saved(moves.select("node", (-F.col("_m._to")).alias("_to"), (-F.col("_m._class")).alias("_class")), "moves")
        asked = moves.groupBy("_to", "_class").agg(F.count("*").alias("_asked"))
        up_to = Window.partitionBy("_to").orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
        asked = asked.withColumn("_before", F.coalesce(F.sum("_asked").over(up_to), F.lit(0))).join(room.withColumnRenamed("shard", "_to"), "_to")
        share = ((F.col("_room") - F.col("_before")) / F.col("_asked")).alias("_share")
        accepted = moves.join(asked.select("_to", "_class", share), ["_to", "_class"])
        lot = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 20)) / F.lit(1 << 20)
        accepted = accepted.filter((F.col("_share") >= 1) | (lot < F.col("_share"))).select("node", "_to")
        moved = linked.join(accepted, "node", "left")
        moved = saved(moved.select("node", F.coalesce("_to", "shard").alias("shard"), F.col("_to").isNotNull().alias("_moved")), "moved")
        linked = moved.drop("_moved")
        if moved.filter("_moved").isEmpty():
            break
    return _fill(nodes, linked, shards, total)


def _fill(nodes: DataFrame, linked: DataFrame, shards: int, total: int) -> DataFrame:
    """Every linked node keeps its shard up to the quota; all others fill the free places in turn."""
    quota = F.lit(total // shards) + (F.col("shard") < total % shards).cast("int")
    kept = saved(ranked(linked, ["shard"], F.col("node"), "_r").filter(F.col("_r") < quota).select("node", "shard"), "kept")
    taken = kept.groupBy("shard").agg(F.count("*").alias("_taken"))
    every = nodes.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    free = every.join(taken, "shard", "left").withColumn("_free", quota - F.coalesce("_taken", F.lit(0)))
    upto = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    free = free.select("shard", "_free", F.sum("_free").over(upto).alias("_end"))
    ends = F.broadcast(free.agg(F.array_sort(F.collect_list(F.struct("shard", "_end"))).alias("_ends")))
    rest = ranked(nodes.join(kept, "node", "left_anti"), [], F.col("node"), "_r")
    # the first shard whose places end beyond the number; the cross-joined side is one row of ``shards`` entries
    rest = rest.crossJoin(ends).select("node", F.get(F.filter("_ends", lambda e: e["_end"] > F.col("_r")), F.lit(0))["shard"].alias("shard"))
    return kept.unionByName(rest)


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``group`` (md5 of the text), ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard`` of every row."""
    text = whole_text(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.unhex(F.md5(text)).alias("group"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("node"),
    )
    rows = saved(rows, "rows")
    placed = propagate(rows.select("node"), rows.select("node", "group"), shards, rounds)
    out = ranked(rows.join(placed, "node"), ["shard"], F.col("node"), "slot")
    return out.select("doc_id", "group", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))


def sharded(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``shard`` and ``slot`` behind them (replaced where they exist)."""
    columns = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.unhex(F.md5(text)).alias("_group"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"))
    # rows with the same id and text are numbered on both sides
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("_id", "_group").orderBy(F.xxhash64(F.to_json("_row")))))
    places = assign(docs, shards, rounds, id_col, text_col).select(F.col("doc_id").alias("_pid"), F.col("group").alias("_pgroup"), "shard", "slot")
    places = places.withColumn("_pk", F.row_number().over(Window.partitionBy("_pid", "_pgroup").orderBy("shard", "slot")))
    on = F.col("_id").eqNullSafe(F.col("_pid")) & (F.col("_group") == F.col("_pgroup")) & (F.col("_k") == F.col("_pk"))
    return rows.join(places, on).select("_row.*", "shard", "slot")
