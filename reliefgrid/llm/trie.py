"""Prefix trie of conversations, with Count-min screening of prefix digests.

A node is a distinct sequence of first turns. Every prefix gets a 128-bit digest: the exclusive or of hashes of
its turns (place, role, text), which is a running total and can be made over range partitions, so a conversation
of any length is spread over tasks. A Count-min sketch counts all prefixes. It never estimates too little, so
an estimate of one proves that a prefix has one member: its node is finished where the row lies. Only prefixes
that may be shared are shuffled and grouped exactly.

Sums over subtrees need no walk up the tree. A conversation owns the nodes whose smallest member it is; from some
depth on, it owns all nodes of its path. So the distinct nodes below a node are the owned ends of its
members' paths, and each member adds what it knows of its own path.

The sketch has ``SKETCH_ROWS`` rows of twice as many cells as there are prefixes, at most ``SKETCH_CELLS`` (64 MB
in all); with more prefixes it proves fewer singletons and more rows are grouped, with the same result. Its
estimates also tell which prefixes may be crowded: their rows are salted before they meet their node.
``ends_sha256`` is a digest of one string, so the ids of a node are hashed in order by one task; they are
sorted and joined to long strings over many tasks before.

Results: rows are ordered by turn (null first), then role, then a hash of the text; null roles and texts count as
empty; rows without a conversation id belong to none and are left out; repeated rows are turns of their own; an
empty table gives an empty one, without a root; other columns are not looked at. Texts are told apart by 128 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefgrid.llm.order import running
from reliefgrid.llm.tables import saved

#: Rows and cells per row of the Count-min sketch, at most; the cells are unsigned 32-bit numbers.
SKETCH_ROWS, SKETCH_CELLS = 4, 1 << 22
#: Cells of a sketch that travel as one row, and bytes of ids that do.
SLICE, BLOCK_BYTES = 1 << 16, 1 << 16
#: Turns of a conversation, or estimated members of a prefix, that meet their partner under one salt.
CHUNK = 4096
#: Turns that a rebuilt conversation takes over are fewer than this.
HEADS = 9
EMPTY = hashlib.sha256(b"").hexdigest()


def numbered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id``, ``pos`` (from 1), ``t1`` and ``t2`` (hash of role and text), ``bytes`` (of the text), one row per turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("_turn"),
        role.alias("_role"),
        *[F.xxhash64(F.lit(i), role, text).alias(f"t{i}") for i in (1, 2)],
        F.octet_length(text).cast("long").alias("bytes"),
    )
    order = [F.col("_turn").asc_nulls_first(), "_role", "t1", "t2"]
    return running(rows, "conv_id", order, {"pos": F.lit(1).cast("long")}).drop("_turn", "_role")


def _met(turns: DataFrame, pos: str, convs: DataFrame, length: str) -> DataFrame:
    """Each row with its conversation's row of ``convs``; long conversations meet theirs in many tasks."""
    spread = convs.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"`{length}` div {CHUNK}"))))
    return turns.withColumn("_chunk", F.expr(f"`{pos}` div {CHUNK}")).join(spread, ["conv_id", "_chunk"]).drop("_chunk")


def donor(conv: Column) -> Column:
    return conv - conv % 5


def head(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % HEADS


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths (``conv_id``, ``len``) of conversations whose first turns are those of :func:`donor`."""
    sizes = saved(turns.groupBy("conv_id").agg(F.max("pos").alias("own")), "sizes")
    giving = sizes.select(F.col("conv_id").alias("_donor"), F.col("own").alias("_has"))
    convs = sizes.withColumn("h", head(F.col("conv_id"))).withColumn("_donor", donor(F.col("conv_id"))).join(giving, "_donor", "left")
    convs = convs.withColumn("m", F.least("h", F.coalesce("_has", F.lit(0).cast("long"))))
    convs = saved(convs.withColumn("len", F.col("m") + F.greatest(F.lit(0).cast("long"), F.col("own") - F.col("h"))), "conversations")
    first = turns.filter(F.col("pos") < HEADS).withColumnRenamed("conv_id", "_donor")
    taken = first.join(convs.select("conv_id", "_donor", "m", "len"), "_donor").filter("pos <= m").select("conv_id", "pos", "t1", "t2", "bytes", "len")
    kept = _met(turns, "pos", convs.select("conv_id", "own", "h", "m", "len"), "own").filter("pos > h")
    kept = kept.select("conv_id", (F.col("m") + F.col("pos") - F.col("h")).alias("pos"), "t1", "t2", "bytes", "len")
    return taken.unionByName(kept), convs.select("conv_id", "len")


def as_told(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths of the conversations as they are."""
    convs = saved(turns.groupBy("conv_id").agg(F.max("pos").alias("len")), "conversations")
    return _met(turns, "pos", convs, "len").select("conv_id", "pos", "t1", "t2", "bytes", "len"), convs


# ---- the sketch ------------------------------------------------------------------------------


def _cells(x1: np.ndarray, x2: np.ndarray, width: int) -> list[np.ndarray]:
    """A cell in every row of the sketch for each digest."""
    shift = np.uint64(65 - width.bit_length())
    step = x2 | np.uint64(1)
    return [((x1 + np.uint64(r) * step) * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.int64) for r in range(SKETCH_ROWS)]


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).view(np.uint64)


def count_min(digests: DataFrame, width: int) -> np.ndarray:
    """Sketch (rows x ``width``) of the digests ``x1``, ``x2``; tasks' sketches are added slice by slice."""

    def run(batches):
        held = np.zeros((SKETCH_ROWS, width), np.uint32)
        for b in batches:
            for row, cells in zip(held, _cells(_numbers(b, "x1"), _numbers(b, "x2"), width)):
                np.add.at(row, cells, 1)
        flat = held.reshape(-1)
        for i in range(0, len(flat), SLICE):
            part = flat[i : i + SLICE]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i // SLICE], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["slice", "cells"])

    def added(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, cells in zip(b.column("slice").to_pylist(), b.column("cells")):
                now = np.frombuffer(cells.as_buffer(), np.uint32).astype(np.uint64)
                total[i] = total[i] + now if i in total else now
        for i, cells in total.items():
            cells = np.minimum(cells, np.iinfo(np.uint32).max).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([cells.tobytes()], pa.binary())], names=["slice", "cells"])

    parts = digests.select("x1", "x2").mapInArrow(run, "slice int, cells binary").repartition("slice").mapInArrow(added, "slice int, cells binary")
    sketch = np.zeros(SKETCH_ROWS * width, np.uint32)
    for r in parts.collect():  # 64 MB at most
        part = np.frombuffer(r["cells"], np.uint32)
        sketch[r["slice"] * SLICE : r["slice"] * SLICE + len(part)] = part
    return sketch.reshape(SKETCH_ROWS, width)


def screened(prefixes: DataFrame, sketch: np.ndarray) -> DataFrame:
    """Adds ``est`` and ``above``: the most members that a prefix, and the one above it, can have."""
    shared = prefixes.sparkSession.sparkContext.broadcast(sketch)
    width = sketch.shape[1]
    names = prefixes.columns

    def run(batches):
        table = shared.value
        for b in batches:
            made = []
            for one, two in (("x1", "x2"), ("p1", "p2")):
                cells = _cells(_numbers(b, one), _numbers(b, two), width)
                made.append(pa.array(np.minimum.reduce([row[c] for row, c in zip(table, cells)]).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*names, "est", "above"])

    schema = ", ".join(f"`{c}` {t}" for c, t in prefixes.dtypes) + ", est bigint, above bigint"
    return prefixes.mapInArrow(run, schema)


# ---- the nodes -------------------------------------------------------------------------------


def _looked_up(rows: DataFrame, keys: tuple[str, str], estimate: str, nodes: DataFrame, unit: int) -> DataFrame:
    """``rows`` joined (left) with ``nodes`` (``_k1``, ``_k2``, ``_est``); crowded nodes are repeated under salts."""
    spread = nodes.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"_est div {unit}")))).drop("_est")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("conv_id"), F.expr(f"`{estimate}` div {unit} + 1")))
    on = (F.col(keys[0]) == F.col("_k1")) & (F.col(keys[1]) == F.col("_k2")) & (salted["_salt"] == spread["_salt"])
    return salted.join(spread, on, "left").drop("_k1", "_k2", "_salt")


def hashed_ids(ends: DataFrame) -> DataFrame:
    """``_k1``, ``_k2``, ``_sha``: SHA-256 of the ids of each group ``x1``, ``x2``, ascending and joined by commas."""

    def joined(batches):
        key, first, ids, size = None, None, [], 0

        def block():
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([first], pa.int64()), pa.array([",".join(ids)], pa.string())], names=["_k1", "_k2", "first", "ids"])

        for b in batches:
            for x1, x2, c in zip(*(b.column(n).to_pylist() for n in ("x1", "x2", "conv_id"))):
                if (x1, x2) != key or size > BLOCK_BYTES:
                    if ids:
                        yield block()
                    key, first, ids, size = (x1, x2), c, [], 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
        if ids:
            yield block()

    def digested(batches):
        key, state = None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["_k1", "_k2", "_sha"])

        for b in batches:
            for k1, k2, ids in zip(*(b.column(n).to_pylist() for n in ("_k1", "_k2", "ids"))):
                if (k1, k2) != key:
                    if key is not None:
                        yield row()
                    key, state = (k1, k2), hashlib.sha256()
                    state.update(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if key is not None:
            yield row()

    sorted_ = ends.select("x1", "x2", "conv_id").repartitionByRange("x1", "x2", "conv_id").sortWithinPartitions("x1", "x2", "conv_id")
    blocks = sorted_.mapInArrow(joined, "_k1 bigint, _k2 bigint, first bigint, ids string")
    return blocks.repartition("_k1", "_k2").sortWithinPartitions("_k1", "_k2", "first").mapInArrow(digested, "_k1 bigint, _k2 bigint, _sha string")


def prefix_trie(conversations: tuple[DataFrame, DataFrame]) -> DataFrame:
    """All nodes of the trie of ``conversations`` (see :func:`as_told` and :func:`rebuilt`).

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` (over the subtree, members but one times the bytes of the last text), ``ends_sha256`` (of
    the ids of the members that end there).
    """
    turns, convs = conversations
    item = {f"x{i}": F.xxhash64(F.lit(i), "pos", "t1", "t2") for i in (1, 2)}
    turns = turns.withColumns({f"_i{i}": item[f"x{i}"] for i in (1, 2)})
    paths = running(turns, "conv_id", ["pos"], {"through": F.col("bytes")}, {"x1": F.col("_i1"), "x2": F.col("_i2")})
    paths = paths.select(
        "conv_id",
        F.col("pos").alias("depth"),
        "len",
        (F.col("through") - F.col("bytes")).alias("before"),
        "through",
        "x1",
        "x2",
        *[F.col(f"x{i}").bitwiseXOR(F.col(f"_i{i}")).alias(f"p{i}") for i in (1, 2)],
    )
    n = paths.count()
    width = min(SKETCH_CELLS, 1 << max(16, (2 * n).bit_length()))
    unit = CHUNK + 4 * (n // width)  # a full sketch estimates too much for all
    marked = saved(screened(paths, count_min(paths, width)), "screened")
    alone, shared = marked.filter("est <= 1"), marked.filter("est > 1")

    # whose is each shared node, and does anyone go on from it?
    members = shared.groupBy("x1", "x2").agg(F.min("conv_id").alias("_low"), F.max("len").alias("_far"), F.max("est").alias("_est"))
    lows = saved(members.withColumnsRenamed({"x1": "_k1", "x2": "_k2"}), "lows")
    owned = _looked_up(shared, ("x1", "x2"), "est", lows, unit)
    owned = saved(owned.withColumn("_own", F.col("conv_id") == F.col("_low")), "owned")

    # from which depth on does each conversation own its path, and does it own a leaf?
    per_row = owned.select("conv_id", "depth", "before", "through", "len", "_own", (F.col("_own") & (F.col("_far") == F.col("depth"))).alias("_leaf"))
    per_row = per_row.unionByName(alone.select("conv_id", "depth", "before", "through", "len", F.lit(True).alias("_own"), (F.col("depth") == F.col("len")).alias("_leaf")))
    mine = F.when(F.col("_own"), F.struct("depth", "before"))
    whole = per_row.groupBy("conv_id").agg(F.min(mine).alias("_o"), F.max("through").alias("_all"), F.max(F.col("_leaf") & (F.col("depth") == F.col("len"))).alias("_leaf"), F.max("len").alias("_len"))
    whole = saved(
        whole.select("conv_id", F.coalesce("_o.depth", F.col("_len") + 1).alias("_from"), F.coalesce("_o.before", "_all").alias("_given"), F.col("_leaf").cast("long").alias("_leaf"), "_len"), "owners"
    )

    root, root_row = _root(turns.sparkSession, convs, whole)
    if root_row is None:
        return root
    added = _met(owned.select("conv_id", "depth", "len", "before", "x1", "x2", "p1", "p2", "est", "above"), "depth", whole.drop("_len").join(convs.select("conv_id", F.col("len").alias("_far")), "conv_id"), "_far")
    grouped = added.groupBy("x1", "x2").agg(
        F.min("conv_id").alias("conv_id"),
        F.first("depth").alias("depth"),
        F.first("p1").alias("p1"),
        F.first("p2").alias("p2"),
        F.first("above").alias("above"),
        F.count("*").alias("n_convs"),
        F.sum(((F.col("_from") <= F.col("depth") + 1) & (F.col("depth") < F.col("len"))).cast("long")).alias("n_children"),
        F.sum("_leaf").alias("n_leaves"),
        F.sum(F.greatest(F.lit(0).cast("long"), F.col("_given") - F.col("before"))).alias("saved_tokens"),
    )
    grouped = grouped.join(hashed_ids(shared.filter("depth = len")), (F.col("x1") == F.col("_k1")) & (F.col("x2") == F.col("_k2")), "left")
    grouped = grouped.withColumn("ends_sha256", F.coalesce("_sha", F.lit(EMPTY)))
    single = alone.select(
        "conv_id", "depth", "p1", "p2", "above",
        F.lit(1).cast("long").alias("n_convs"),
        (F.col("depth") < F.col("len")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("depth") == F.col("len"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(EMPTY).alias("ends_sha256"),
    )
    figures = ["n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = grouped.select(*single.columns).unionByName(single)
    # below the root all have one parent; below a proven singleton, the same member; else look the node up
    known = F.when(F.col("depth") == 1, F.lit(root_row["conv_id"])).when(F.col("above") <= 1, F.col("conv_id"))
    nodes = nodes.withColumn("_known", known)
    sure = nodes.filter("_known is not null").withColumnRenamed("_known", "parent_conv_id")
    asked = _looked_up(nodes.filter("_known is null"), ("p1", "p2"), "above", lows.select("_k1", "_k2", "_est", "_low"), unit)
    out = [root, *(x.select("conv_id", "depth", "parent_conv_id", *figures) for x in (sure, asked.withColumnRenamed("_low", "parent_conv_id")))]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _root(spark: SparkSession, convs: DataFrame, whole: DataFrame) -> tuple[DataFrame, object]:
    """The node without turns as a table, and its row; without conversations an empty table and None."""
    told = convs.join(whole, "conv_id", "left").agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.coalesce(F.sum((F.col("_from") == 1).cast("long")), F.lit(0)).cast("long").alias("n_children"),
        F.coalesce(F.sum("_leaf"), F.lit(0)).cast("long").alias("n_leaves"),
        F.coalesce(F.sum("_given"), F.lit(0)).cast("long").alias("saved_tokens"),
        F.max("len").alias("_far"),
    )
    row = told.first()
    some = row["n_convs"] > 0
    told = told.filter("n_convs > 0").withColumn("n_leaves", F.when(F.col("_far") == 0, 1).otherwise(F.col("n_leaves")).cast("long"))
    silent = convs.filter("len = 0").select(F.lit(0).cast("long").alias("x1"), F.lit(0).cast("long").alias("x2"), "conv_id")
    names = told.join(hashed_ids(silent), F.lit(True), "left") if some else told.withColumn("_sha", F.lit(EMPTY))
    table = names.select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("_sha", F.lit(EMPTY)).alias("ends_sha256"),
    )
    return table, row if some else None


def oracle() -> str:
    """The same in SQL over ``conversations``, prefixes told apart by chained digests."""
    return f"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM (
    WITH RECURSIVE bits AS (
      SELECT b::BIGINT AS b, b::BIGINT AS c, 0 AS k FROM range(256) r(b)
      UNION ALL SELECT b, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM bits WHERE k < 8
    ) SELECT b, c FROM bits WHERE k = 8)
), ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL
), crc AS (
  SELECT conv_id, 1 AS i, 4294967295::BIGINT AS c FROM ids
  UNION ALL SELECT conv_id, i + 1, xor(c >> 8, (SELECT t FROM crc_table)[(xor(c, ascii(substr(conv_id::VARCHAR, i, 1))) & 255) + 1]) FROM crc WHERE i <= length(conv_id::VARCHAR)
), told AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, xor(c, 4294967295) % {HEADS} AS h, conv_id - conv_id % 5 AS d, coalesce((SELECT count(*) FROM told t WHERE t.conv_id = crc.conv_id - crc.conv_id % 5), 0) AS has
  FROM crc WHERE i = length(conv_id::VARCHAR) + 1
), turns AS (
  SELECT c.conv_id, t.pos, t.role, t.text FROM convs c JOIN told t ON t.conv_id = c.d AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, least(c.h, c.has) + t.pos - c.h, t.role, t.text FROM convs c JOIN told t ON t.conv_id = c.conv_id AND t.pos > c.h
), lengths AS (SELECT conv_id, count(t.pos) AS len FROM convs LEFT JOIN turns t USING (conv_id) GROUP BY conv_id
), paths AS MATERIALIZED (
  SELECT conv_id, pos AS depth, octet_length(encode(text)) AS size, sha256(string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY conv_id ORDER BY pos)) AS x FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), full_paths AS MATERIALIZED (SELECT p.*, len, lag(x) OVER (PARTITION BY p.conv_id ORDER BY depth) AS px FROM paths p JOIN lengths USING (conv_id)
), nodes AS MATERIALIZED (
  SELECT x, min(conv_id) AS conv_id, min(depth) AS depth, min(px) AS px, count(*) AS n, min(size) AS size, max(len) AS far,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len = depth), '')) AS ends
  FROM full_paths GROUP BY x
), below AS (
  SELECT a.x, sum((m.n - 1) * m.size) AS saved, sum((m.far = m.depth)::INT) AS leaves, sum((m.depth = a.depth + 1)::INT) AS children
  FROM nodes m JOIN full_paths a ON a.conv_id = m.conv_id AND a.depth <= m.depth GROUP BY a.x
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n AS n_convs, b.children::BIGINT AS n_children, b.leaves::BIGINT AS n_leaves,
  b.saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN below b USING (x) LEFT JOIN nodes p ON p.x = n.px"""
