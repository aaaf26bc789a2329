"""SimHash near-duplicates: vantage-point trees over Hamming space find all pairs within a radius.

Fingerprints are made once per text; equal ones meet in a grouping, so copies never form pairs. The
distinct fingerprints are dealt to shards by a vantage-point tree: at each node the distance to the
vantage point decides the side, and, by the triangle inequality, only inner points within ``radius``
of the border can have partners outside, so only those are also handed to the outer side. Every pair
within the radius therefore meets in at least one shard, and a shard returns a spanning star for each
of its linked sets, never its pairs. Shards are joined by distributed connected components.

Near copies by the Jaccard index of five-word shingles (:func:`near_duplicates`) are linked by the same trees first, and
each link is confirmed by the two shingle sets. Pairs beyond the radius are proposed by MinHash bands and the rarest
shingles of the sets, and confirmed alike.

Results: null and empty texts have fingerprint zero and link like any other; repeated rows are
repeated in the output; a component of rows without ids has a null id; an empty table gives an empty
one; other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliefgrid.llm.tables import saved
from reliefgrid.operators.regions import connected_components
from reliefgrid.runtime import cut

#: Bytes of a text that are split into words at a time.
CHUNK_BYTES = 1 << 20
#: Fingerprints that shape the tree on the driver, at most (2 MB). They decide only which shard a
#: fingerprint goes to, never which pairs are found.
SAMPLE = 262_144
#: Fingerprints aimed at in one shard.
SHARD_ROWS = 16_384
#: Fingerprints link at so many differing bits or fewer.
RADIUS = 2
#: Below this, a node inside a shard compares all its points.
BRUTE_ROWS = 1_024


@dataclass(frozen=True)
class Features:
    """What a fingerprint is made of: shingles of ``words`` words, each counted once if ``distinct``."""

    name: str
    words: int = 3
    seed: int = 42
    distinct: bool = False


def word_chunks(data: bytes, carry: int) -> Iterator[list[bytes]]:
    """Words (ASCII white space parts them, A-Z lower-cased) in runs; each run repeats the last ``carry`` words."""
    kept: list[bytes] = []
    at, end = 0, len(data)
    while at < end or at == 0:
        stop = min(end, at + CHUNK_BYTES)
        while stop < end and data[stop] not in b"\t\n\x0b\x0c\r ":
            stop += 1
        words = kept + data[at:stop].lower().split()
        yield words
        kept = words[max(0, len(words) - carry) :] if carry else []
        at = stop
        if not end:
            return


def shingles(words: list[bytes], n: int) -> Iterator[bytes]:
    return map(b" ".join, zip(*(words[i:] for i in range(n)))) if n > 1 else iter(words)


def simhash(data: bytes, features: Features) -> int:
    """64-bit fingerprint: a bit is 1 if over half of the shingles' hashes have it."""
    n = features.words
    ones, total = np.zeros(64, np.int64), 0
    seen: set[bytes] = set()
    words: list[bytes] = []
    for words in word_chunks(data, n - 1):
        found = shingles(words, n)
        if features.distinct:
            fresh = set(found) - seen
            seen |= fresh
            found = iter(fresh)
        h = np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(features.seed)), np.uint64)
        if len(h):
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(h)
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(words), features.seed) if words else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, features: list[Features], id_col: str = "doc_id", text_col: str = "text", extra: dict | None = None) -> DataFrame:
    """``doc_id``, the columns of ``extra``, and one long per entry of ``features`` for every row."""
    extra = extra or {}
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        *[c.alias(k) for k, c in extra.items()],
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("_text"),
    )
    keep = ["doc_id", *extra]

    def run(batches):
        for b in batches:
            texts = [v.as_py() for v in b.column("_text")]
            made = [np.array([simhash(t, f) for t in texts], np.uint64).view(np.int64) for f in features]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *map(pa.array, made)], names=[*keep, *(f.name for f in features)])

    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep), *(f"`{f.name}` bigint" for f in features)])
    return rows.mapInArrow(run, schema)


# ---- the tree --------------------------------------------------------------------------------


def distances(points: np.ndarray, vantage: int | np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(vantage))


def best_cut(points: np.ndarray, radius: int) -> tuple[np.uint64, int, float]:
    """Vantage point and border with the smallest larger side (share of the points)."""
    best = (points[0], 0, 1.0)
    for v in points[np.linspace(0, len(points) - 1, 8).astype(int)]:
        below = np.concatenate([[0], np.cumsum(np.bincount(distances(points, v), minlength=65))]) / len(points)
        mu = np.arange(1, 65)
        larger = np.maximum(below[mu], 1 - below[np.maximum(mu - radius, 0)])
        k = int(larger.argmin())
        if larger[k] < best[2]:
            best = (v, int(mu[k]), float(larger[k]))
    return best


def build_tree(sample: np.ndarray, scale: float, radius: int, shard_rows: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage, border, inner child, outer child); a child below zero is shard ``-child - 1``."""
    nodes: list[tuple[int, int, int, int]] = []
    shards = 0

    def grow(points: np.ndarray, depth: int) -> int:
        nonlocal shards
        cut_at = best_cut(points, radius) if len(points) * scale > shard_rows and len(points) >= 64 and depth < 40 else None
        if cut_at is None or cut_at[2] > 0.9:
            shards += 1
            return -shards
        me = len(nodes)
        nodes.append((0, 0, 0, 0))
        d = distances(points, cut_at[0])
        nodes[me] = (int(cut_at[0]), cut_at[1], grow(points[d < cut_at[1]], depth + 1), grow(points[d >= cut_at[1] - radius], depth + 1))
        return me

    grow(np.unique(sample), 0) if len(sample) else None
    return nodes


def route(points: np.ndarray, nodes: list[tuple[int, int, int, int]], radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, indexes) for the shards in which each point belongs or may have partners."""
    todo = [(0 if nodes else -1, np.arange(len(points)))]
    while todo:
        node, idx = todo.pop()
        if not len(idx):
            continue
        if node < 0:
            yield -node - 1, idx
            continue
        vantage, border, inner, outer = nodes[node]
        d = distances(points[idx], vantage)
        todo += [(inner, idx[d < border]), (outer, idx[d >= border - radius])]


def _settle(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Unite the ends of links in ``parent``; every point ends at the smallest index of its set."""
    while len(u):
        pu, pv = parent[u], parent[v]
        open_ = pu != pv
        u, v, pu, pv = u[open_], v[open_], pu[open_], pv[open_]
        np.minimum.at(parent, np.maximum(pu, pv), np.minimum(pu, pv))
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


def linked_sets(points: np.ndarray, radius: int, also: np.ndarray | None = None, also_radius: int = 0) -> np.ndarray:
    """For each point the smallest index of its linked set, by a tree inside the shard.

    With ``also`` a link needs both distances. Pairs are united block by block and never kept.
    """
    parent = np.arange(len(points))
    todo = [np.arange(len(points))]
    while todo:
        idx = todo.pop()
        at = best_cut(points[idx], radius) if len(idx) > BRUTE_ROWS else None
        if at is not None and at[2] <= 0.9:
            d = distances(points[idx], at[0])
            todo += [idx[d < at[1]], idx[d >= at[1] - radius]]
            continue
        p = points[idx]
        for lo in range(0, len(idx), 128):
            near = np.bitwise_count(p[lo : lo + 128, None] ^ p[None, lo:]) <= radius
            i, j = np.nonzero(near)
            u, v = idx[i + lo], idx[j + lo]
            if also is not None:
                ok = np.bitwise_count(also[u] ^ also[v]) <= also_radius
                u, v = u[ok], v[ok]
            _settle(parent, u, v)
    return parent


def links(nodes: DataFrame, by: str, radius: int, also: str | None = None, also_radius: int = 0, sample: int = SAMPLE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Edges ``a``, ``b`` between values of ``node`` whose sets are linked by a Hamming distance.

    ``nodes`` has distinct longs ``node``, the fingerprint ``by`` and, if links must also hold there,
    ``also``. The edges are spanning stars within shards: they connect exactly what the pairs connect.
    """
    count = nodes.count()
    stride = max(1, -(-2 * count // sample))
    picked = nodes.filter(F.pmod(F.xxhash64(by, F.lit("tree")), F.lit(stride)) == 0).select(by).limit(sample)
    # as Arrow: eight bytes a fingerprint on the driver, where rows would take a hundred
    shape = np.sort(picked.toArrow().column(by).to_numpy().astype(np.int64).view(np.uint64))
    tree = build_tree(shape, count / max(1, len(shape)), radius, shard_rows)
    columns = ["node", by, *([also] if also else [])]

    def deal(batches):
        for b in batches:
            points = b.column(by).to_numpy(zero_copy_only=False).view(np.uint64)
            for shard, idx in route(points, tree, radius):
                part = b.take(pa.array(idx))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(idx), shard, np.int32)), *(part.column(c) for c in columns)], names=["shard", *columns])

    def search(table: pa.Table) -> pa.Table:
        ids = table.column("node").to_numpy()
        order = np.argsort(ids, kind="stable")  # the result doesn't depend on the order of arrival
        ids = ids[order]
        points = table.column(by).to_numpy()[order].view(np.uint64)
        second = table.column(also).to_numpy()[order].view(np.uint64) if also else None
        parent = linked_sets(points, radius, second, also_radius)
        k = np.nonzero(parent != np.arange(len(ids)))[0]
        return pa.table({"a": ids[k], "b": ids[parent[k]]})

    dealt = nodes.select(*columns).mapInArrow(deal, "shard int, " + ", ".join(f"`{c}` bigint" for c in columns))
    return dealt.groupBy("shard").applyInArrow(search, "a bigint, b bigint")


def linked_fingerprints(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``node``, ``root`` of the fingerprints in ``distinct`` (``fp``) that have others within the radius, by the trees."""
    return connected_components(links(distinct.select(F.col("fp").alias("node"), F.col("fp").alias("by")), "by", radius))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = RADIUS) -> DataFrame:
    """``doc_id``, ``fingerprint`` (long), ``component_id``: the smallest doc_id reachable over links."""
    made = cut(fingerprints(docs, [Features("fp", words)], id_col, text_col))
    first = made.groupBy("fp").agg(F.min("doc_id").alias("low"))
    first = cut(first)
    found = linked_fingerprints(first, radius)
    rooted = first.join(found, first["fp"] == found["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    ids = rooted.join(lowest, "root").select(F.col("fp").alias("_fp"), "component_id")
    return made.join(ids, made["fp"] == ids["_fp"]).select("doc_id", F.col("fp").alias("fingerprint"), "component_id")


#: Near copies: Jaccard index of the sets of ``NEAR_WORDS``-word shingles, at least ``SIMILARITY``.
NEAR_WORDS = 5
SIMILARITY = 0.8
#: MinHashes of a text, ``BANDS`` bands of ``BAND_ROWS``. At a Jaccard index of 0.8 all bands of two texts
#: differ with a chance of (1 - 0.8**5)**40 = 1.2e-7.
BANDS, BAND_ROWS = 40, 5
#: Shingles that a task hands on at a time, about.
BATCH_SHINGLES = 1_000_000
_MIX = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 63, (2, BANDS * BAND_ROWS, 1), np.uint64)


def shingle_set(data: bytes, n: int = NEAR_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text of fewer words is one shingle, one without words none."""
    found, words = [np.zeros(0, np.uint64)], []
    for words in word_chunks(data, n - 1):
        found.append(np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles(words, n), repeat(42)), np.uint64)))
    every = np.unique(np.concatenate(found))
    return every if len(every) or not words else np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)


def minhashes(found: np.ndarray) -> np.ndarray:
    low = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(found), 2_048):
        np.minimum(low, ((found[lo : lo + 2_048] ^ _MIX[0]) * (_MIX[1] | np.uint64(1))).min(axis=1), out=low)
    return low


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id``, ``_md5``, ``node`` (hash of the shingle set), ``bands``, ``fp`` (fingerprint of the trees) of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.md5(text).alias("_md5"), text.cast("binary").alias("_text"))

    def run(batches):
        for b in batches:
            nodes, bands, fps = [], [], []
            for t in b.column("_text"):
                found = shingle_set(t.as_py())
                nodes.append(xxhash.xxh64_intdigest(found.tobytes()))
                low = minhashes(found).reshape(BANDS, BAND_ROWS)
                keys = [xxhash.xxh64_intdigest(v.tobytes(), k) for k, v in enumerate(low)] if len(found) else []
                bands.append(np.array(keys, np.uint64).view(np.int64))
                fps.append(simhash(t.as_py(), Features("fp")))
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), b.column("_md5"), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(np.array(fps, np.uint64).view(np.int64))],
                names=["_id", "_md5", "node", "bands", "fp"],
            )

    return rows.mapInArrow(run, "_id bigint, _md5 string, node bigint, bands array<bigint>, fp bigint")


def _sets(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """``node``, ``size`` and ``set`` (sorted shingle hashes) of the texts ``_md5`` in ``wanted``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.md5(text).alias("_md5"), text.cast("binary").alias("_text")).join(wanted, "_md5", "left_semi").dropDuplicates(["_md5"])

    def run(batches):
        for b in batches:
            found = [shingle_set(t.as_py()) for t in b.column("_text")]
            nodes = np.array([xxhash.xxh64_intdigest(f.tobytes()) for f in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(list(map(len, found)), pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())], names=["node", "size", "set"])

    return rows.select("_text").mapInArrow(run, "node bigint, size bigint, set binary")


def _prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """``shingle``, ``node``, ``size``, ``rest``, ``own``: the rarest shingles of each set, one of which every near set shares.

    Shingles are ordered by the number of sets that hold them, the rarest first. Of two sets whose Jaccard index
    reaches ``similarity`` each shares that part of its shingles at least, so their first ``1 - similarity`` parts meet.
    Shingles of no other set (``own`` of them) meet nothing: a set with more of them than that has no partner at all.
    ``rest`` counts the shingles from this one on, the most that can be shared if this is the first that is.
    """

    def run(batches):
        for b in batches:
            found = [np.frombuffer(v.as_buffer(), np.int64) for v in b.column("set")]
            lengths = np.array(list(map(len, found)), np.int64)
            nodes, sizes = (b.column(c).to_numpy(zero_copy_only=False) for c in ("node", "size"))
            part = np.cumsum(lengths) // BATCH_SHINGLES
            for rows in np.split(np.arange(len(found)), np.nonzero(np.diff(part))[0] + 1):
                if len(rows):
                    flat = np.concatenate([found[i] for i in rows])
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes[rows], lengths[rows])), pa.array(np.repeat(sizes[rows], lengths[rows])), pa.array(flat)], names=["node", "size", "shingle"])

    each = sets.mapInArrow(run, "node bigint, size bigint, shingle bigint")
    held = each.groupBy("shingle").agg(F.count("*").alias("_in")).filter("_in > 1")
    per = each.join(held, "shingle").groupBy("node").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("_in", "shingle"))).alias("_s"))
    length = F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1
    per = per.withColumn("own", F.col("size") - F.size("_s")).withColumn("_k", (length - F.col("own")).cast("int")).filter("_k > 0")
    rows = per.select("node", "size", "own", F.posexplode(F.slice("_s", F.lit(1), F.col("_k"))).alias("_i", "_x"))
    return rows.select(F.col("_x.shingle").alias("shingle"), "node", "size", "own", (F.col("size") - F.col("own") - F.col("_i")).alias("rest"))


def _tree_pairs(marked: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b``: the nodes of each component of fingerprints (:func:`linked_fingerprints`) with its smallest node."""
    held = saved(marked.select("fp", "node").distinct(), "fingerprints")
    found = linked_fingerprints(saved(held.select("fp").distinct(), "distinct")).withColumnRenamed("node", "fp")
    rooted = held.join(found, "fp", "left").select("node", F.coalesce("root", "fp").alias("root"))
    hubs = rooted.groupBy("root").agg(F.min("node").alias("b"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return rooted.join(hubs, "root").filter("node <> b").select(F.col("node").alias("a"), "b").distinct()


def _merged(labels: DataFrame, found: DataFrame) -> DataFrame:
    """``labels`` with the sets joined that the confirmed pairs ``found`` link."""
    roots = [labels.select(F.col("node").alias(c), F.col("root").alias(f"_{c}")) for c in ("a", "b")]
    edges = found.join(roots[0], "a").join(roots[1], "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    merged = connected_components(edges).select(F.col("node").alias("root"), F.col("root").alias("_to"))
    return saved(labels.join(merged, "root", "left").select("node", F.coalesce("_to", "root").alias("root")), "labels")


def _met_pairs(met: DataFrame, others: DataFrame, similarity: float, twice: bool = False) -> DataFrame:
    """Pairs ``a``, ``b`` of different sets that share a shingle whose place leaves room for ``similarity``; ``twice``: both sides have all rows."""
    columns = ("node", "size", "rest", "root")
    right = others.select("shingle", *[F.col(c).alias(f"_p_{c}") for c in columns])
    size, rest = F.col("size") + F.col("_p_size"), F.least("rest", "_p_rest")
    room = (rest * (1 + similarity) + 1e-6 >= size * similarity) & (F.least("size", "_p_size") >= F.greatest("size", "_p_size") * similarity - 1e-9)
    apart = (F.col("root") != F.col("_p_root")) & (F.col("node") > F.col("_p_node") if twice else F.lit(True))
    pairs = met.select("shingle", *columns).join(right, "shingle").filter(apart & room)
    return pairs.select(F.greatest("node", "_p_node").alias("a"), F.least("node", "_p_node").alias("b")).distinct()


def _near_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a``, ``b`` whose sets have a Jaccard index of ``similarity``."""
    one, two = (sets.select(F.col("node").alias(c), F.col("set").alias(f"_{c}")) for c in ("a", "b"))

    def run(batches):
        for b in batches:
            found = ([np.frombuffer(v.as_buffer(), np.uint64) for v in b.column(c)] for c in ("_a", "_b"))
            ok = [jaccard(x, y) >= similarity for x, y in zip(*found)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(two, "b").join(one, "a").select("a", "b", "_a", "_b").mapInArrow(run, "a bigint, b bigint")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return both / union if union else 1.0


def near_roots(marked: DataFrame, docs: DataFrame, text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``node``, ``root`` for the nodes of ``marked`` that may have near copies: the smallest node of a linked set.

    The trees come first: what they link is confirmed by the shingle sets and starts out as one set. Beyond their radius,
    texts that share a band meet again by the rarest shingles of their sets (:func:`_prefixes`), which a passage or a
    template that many texts share is not among. In every round each shingle compares one text of its largest linked
    set, and a number of other texts that doubles, with its texts of other sets; the text with the fewest shingles of
    its own goes first, which in a crowd of copies is the one that all were made from. A pair is read only if sizes
    and places of the shingle leave room for the similarity, and rows without any such partner in another set are dropped.
    A compared text is done at that shingle, and a shingle is done when one set is left: every possible pair
    is compared or already linked by others. Once the pairs of different sets that are left
    are no more than the rows at the start, all of them are compared at once.
    """
    nodes = saved(marked.groupBy("node").agg(F.first("_md5").alias("_md5"), F.first("bands").alias("bands")), "nodes")
    bands = nodes.select(F.explode("bands").alias("band"), "node")
    shared = bands.groupBy("band").agg(F.count("*").alias("_n")).filter("_n > 1").select("band")
    met = bands.join(shared, "band", "left_semi").select("node").distinct()
    close = saved(_tree_pairs(marked), "close")
    wanted = met.unionByName(close.select(F.explode(F.array("a", "b")).alias("node")))
    sets = saved(_sets(docs, nodes.join(wanted, "node", "left_semi").select("_md5"), text_col), "sets")
    rows = saved(_prefixes(sets, similarity), "prefixes")
    labels = saved(rows.select("node").distinct().withColumn("root", F.col("node")), "labels")
    found = saved(_near_pairs(close, sets, similarity), "near")
    if not found.isEmpty():
        labels = _merged(labels, found)
    # the largest partner that the rest allows
    reach = F.floor(F.col("rest") * ((1 + similarity) / similarity) + 1e-6) - F.col("size")
    rank = F.struct((F.col("own") / F.col("size")).alias("own"), F.xxhash64("node", F.lit("pivot")).alias("lot"), "node")
    most, others = rows.count(), 0
    while True:
        met = rows.join(labels, "node").withColumn("_reach", reach).withColumn("_rank", rank)
        per = met.groupBy("shingle", "root").agg(F.count("*").alias("_n"), F.min("_rank").alias("_first"), F.min("size").alias("_least"), F.max("_reach").alias("_most"))
        main = per.groupBy("shingle").agg(
            F.count("*").alias("_sets"),
            F.min(F.struct((-F.col("_n")).alias("n"), "_first", "root")).alias("_main"),
            F.min("_least").alias("_least"),
            F.max("_most").alias("_most"),
        )
        main = main.filter("_sets > 1").select("shingle", F.col("_main.root").alias("_main"), "_least", "_most")
        fits = (F.col("_reach") >= F.greatest("_least", F.ceil(F.col("size") * similarity - 1e-9))) & (F.col("_most") >= F.col("size"))
        met = saved(met.join(main, "shingle").filter(fits).drop("_least", "_most"), "met")
        own = F.col("root") == F.col("_main")
        crowds = met.groupBy("shingle").agg(F.count_if(own).cast("double").alias("_m"), F.count_if(~own).cast("double").alias("_o"))
        left = crowds.agg(F.sum(F.col("_o") * (F.col("_m") + (F.col("_o") - 1) / 2))).first()[0]
        if left is None:
            return labels
        if left <= most:
            found = saved(_near_pairs(_met_pairs(met, met, similarity, twice=True), sets, similarity), "near")
            return labels if found.isEmpty() else _merged(labels, found)
        slot = F.when(F.col("root") == F.col("_main"), F.lit(-1)).otherwise(F.pmod(F.xxhash64("node"), F.lit(max(1, others))).cast("int"))
        pivots = met.withColumn("_slot", slot).filter(F.lit(others > 0) | (F.col("_slot") < 0))
        pivots = pivots.groupBy("shingle", "_slot").agg(F.min(F.struct("_rank", "node", "size", "rest", "root")).alias("_p"))
        pivots = saved(pivots.select("shingle", *[F.col(f"_p.{c}").alias(c) for c in ("node", "size", "rest", "root")]), "pivots")
        if pivots.isEmpty():
            others = max(4, 2 * others)  # the main sets have no row that fits; go on with the rest
            rows = met.select(*rows.columns)
            continue
        found = saved(_near_pairs(_met_pairs(met, pivots, similarity), sets, similarity), "near")
        if not found.isEmpty():
            labels = _merged(labels, found)
        done = pivots.select("shingle", "node")
        rows = saved(met.select(*rows.columns).join(done, ["shingle", "node"], "left_anti"), "rows")
        others = max(4, 2 * others)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per (_id, _md5) of ``docs``: ``_group`` numbers its group of near copies, ``_keep`` marks one per group.

    Two texts are linked if the Jaccard index of their sets of five-word shingles is ``similarity`` or more.
    Vantage-point trees over SimHashes, as in :func:`components`, propose links first, MinHash bands and rare shingles the
    pairs beyond the trees' radius; each is confirmed by its sets. Trees alone cannot reach that index: SimHashes differ by about
    ten bits there, a radius at which trees prune nothing.
    """
    made = saved(_marked(docs, id_col, text_col), "marked")
    found = near_roots(made, docs, text_col, similarity).withColumnRenamed("node", "_node")
    texts = made.groupBy("node", "_id", "_md5").agg(F.lit(1).alias("_one"))
    texts = texts.join(found, texts["node"] == found["_node"], "left").withColumn("_group", F.coalesce("root", "node"))
    # the smallest id stays; among rows without id, or with the same one, the smallest text hash
    rank = F.struct(F.col("_id").isNull().alias("none"), "_id", "_md5")
    best = texts.groupBy("_group").agg(F.min(rank).alias("_best")).withColumnRenamed("_group", "_g")
    joined = texts.join(best, texts["_group"] == best["_g"])
    return joined.select("_id", "_md5", "_group", (rank == F.col("_best")).alias("_keep"))
