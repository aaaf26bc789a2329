"""Centroid clustering with Ptolemaic pivots: exact k-means on integer vectors.

Components are turned into integers ``floor(scale * x)``, so distances, sums and centroids are exact and a
round does not depend on the order of rows. A few vectors of a small sample are fixed as pivots, in pairs.
The distances of every vector to the pivots are computed once and stored with it. For a pivot pair (p, s),
Ptolemy's inequality gives, for any vector q and centroid c,

    d(q, c) * d(p, s) >= |d(q, p) * d(c, s) - d(q, s) * d(c, p)|

so each round needs the pivot distances of the few centroids only. A vector is compared with the centroid
of the smallest bound, then with those whose bound, rounded down, does not exceed that distance. Survivors
are compared in integers; ties go to the smaller number.

A round is one pass over the stored vectors: every task adds up its vectors per centroid, and only those
sums (centroids x components x tasks) are shuffled. The driver holds the centroids and nothing else.

Results: vectors with another number of components, a null or a non-finite one are left out, as null
vectors are; repeated rows are vectors of their own; a null id is kept and seeds after all others; ids that
repeat are told apart by their components; fewer vectors than centroids make fewer centroids; an empty
table gives an empty one; other columns are not looked at. A component beyond ``LIMIT`` raises: distances
would not fit into a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefgrid.llm.tables import saved

#: Largest scaled component; 64 squared differences of twice that size fit into a long.
LIMIT = 1 << 27
#: Pivot pairs, and vectors that pivots are chosen from. Pivots decide how much is pruned, never the result.
PAIRS = 8
PIVOT_SAMPLE = 512
#: Relative slack of a bound: many times the rounding errors of the few float operations in it.
SLACK = 1e-12


def integer_vectors(vectors: DataFrame, size: int = 64, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id`` and ``v`` (array of long) of the vectors that have ``size`` finite components."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.coalesce((F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    whole = F.transform(v, lambda x: F.floor(x * scale))
    kept = vectors.filter(fine).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("_v"), whole.alias("v"))
    far = F.exists("_v", lambda x: F.abs(x * scale) > LIMIT)
    told = F.raise_error(F.concat(F.lit("component too large in vector "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))))
    return kept.select("vec_id", F.when(far, told.cast("array<bigint>")).otherwise(F.col("v")).alias("v"))


def first_vectors(kept: DataFrame, k: int, rank: Column, size: int) -> np.ndarray:
    """The ``k`` vectors of the lowest ``rank``, as rows of an array."""
    rows = kept.select("v", rank.alias("_rank")).orderBy(F.col("_rank").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(len(rows), size)


def seed_rank(seed: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)


def squared(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    gap = points - centre
    return np.einsum("...i,...i->...", gap, gap)


def pivots(sample: np.ndarray, pairs: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """Pivots, far from each other, and the index pairs used for bounds (no pair at distance zero)."""
    if not len(sample):
        return sample, np.zeros((0, 2), np.int64)
    chosen = [0]
    nearest = squared(sample, sample[0])
    while len(chosen) < 2 * pairs and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, squared(sample, sample[chosen[-1]]))
    points = sample[chosen]
    # consecutive pivots were each the farthest from all before
    return points, np.array([(i, i + 1) for i in range(0, len(points) - 1, 2)], np.int64).reshape(-1, 2)


def lower_bounds(to_pivots: np.ndarray, centre_to_pivots: np.ndarray, between: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """A number not above the squared distance of each vector (rows) to each centroid (columns)."""
    best = np.zeros((len(to_pivots), len(centre_to_pivots)))
    for (p, s), apart in zip(pairs, between):
        one = np.multiply.outer(to_pivots[:, p], centre_to_pivots[:, s])
        two = np.multiply.outer(to_pivots[:, s], centre_to_pivots[:, p])
        # the products may cancel, so their errors count in proportion to their sizes
        sure = np.abs(one - two) - SLACK * (one + two)
        np.maximum(best, sure / (apart * (1 + SLACK)), out=best)
    return best * best * (1 - SLACK)


def assign(points: np.ndarray, to_pivots: np.ndarray, centres: np.ndarray, pivot_points: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid, squared distance, and the number of distances computed, for each vector."""
    centre_to_pivots = np.sqrt(squared(centres[:, None], pivot_points[None]).astype(float))
    between = np.sqrt(squared(pivot_points[pairs[:, 0]], pivot_points[pairs[:, 1]]).astype(float))
    bounds = lower_bounds(to_pivots, centre_to_pivots, between, pairs)
    first = bounds.argmin(axis=1)
    nearest, distance = first.copy(), squared(points, centres[first])
    open_ = bounds <= distance[:, None]
    open_[np.arange(len(points)), first] = False
    compared = 1 + open_.sum(axis=1)
    for c in range(len(centres)):
        rows = np.nonzero(open_[:, c])[0]
        d = squared(points[rows], centres[c])
        better = (d < distance[rows]) | ((d == distance[rows]) & (c < nearest[rows]))
        nearest[rows[better]], distance[rows[better]] = c, d[better]
    return nearest, distance, compared


def _matrix(column: pa.Array, size: int, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(v.as_py() for v in column), kind).reshape(-1, size)


def _stored(kept: DataFrame, pivot_points: np.ndarray) -> DataFrame:
    """``vec_id``, ``v`` and ``to_pivots`` (packed numbers), written once."""

    def run(batches):
        for b in batches:
            points = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
            gaps = np.sqrt(np.stack([squared(points, p) for p in pivot_points], axis=1).astype(float)) if len(pivot_points) else np.zeros((len(b), 0))
            small = points.astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([r.tobytes() for r in small], pa.binary()), pa.array([r.tobytes() for r in gaps], pa.binary())], names=["vec_id", "v", "to_pivots"])

    return saved(kept.mapInArrow(run, "vec_id bigint, v binary, to_pivots binary"), "vectors")


def _assigned(stored: DataFrame, centres: np.ndarray, pivot_points: np.ndarray, pairs: np.ndarray, size: int, use: Callable, schema: str) -> DataFrame:
    """``use(batch, points, nearest, distance, compared)`` for every batch, and ``use(None, ...)`` at the end of a task."""

    def run(batches):
        for b in batches:
            if len(b):
                points = _matrix(b.column("v"), size, np.int32).astype(np.int64)
                gaps = _matrix(b.column("to_pivots"), len(pivot_points), float)
                yield from use(b, points, *assign(points, gaps, centres, pivot_points, pairs))
        yield from use(None, None, None, None, None)

    return stored.mapInArrow(run, schema)


class _Sums:
    """Adds up vectors per centroid within a task, in Python integers beyond one batch."""

    def __init__(self, k: int, size: int):
        self.total = [[0] * size for _ in range(k)]
        self.count = [0] * k

    def __call__(self, batch, points, nearest, distance, compared):
        if batch is None:
            rows = [(c, n, [str(x) for x in t]) for c, (n, t) in enumerate(zip(self.count, self.total)) if n]
            if rows:
                c, n, t = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(n, pa.int64()), pa.array(t, pa.list_(pa.string()))], names=["cluster", "n", "total"])
            return
        for c in np.unique(nearest):
            rows = points[nearest == c]
            self.count[c] += len(rows)
            self.total[c] = [a + int(b) for a, b in zip(self.total[c], rows.sum(axis=0))]


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: str = "3", size: int = 64, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id``, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia``, ``centroid_sha256``, ``compared``.

    Centroids start as the ``k`` vectors with the smallest SHA-256 of ``seed:vec_id``. ``compared`` counts
    the centroids that a vector was compared with in the last assignment; the others were pruned.
    """
    kept = integer_vectors(vectors, size, scale, id_col, vector_col)
    centres = first_vectors(kept, k, seed_rank(seed), size)
    pivot_points, pairs = pivots(first_vectors(kept, PIVOT_SAMPLE, seed_rank(f"pivot {seed}"), size))
    stored = _stored(kept, pivot_points)
    for _ in range(rounds if len(centres) else 0):
        sums = _assigned(stored, centres, pivot_points, pairs, size, _Sums(len(centres), size), "cluster int, n bigint, total array<string>")
        each = sums.select("cluster", "n", F.posexplode("total").alias("i", "t"))
        exact = each.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("t").cast("decimal(38,0)")).alias("t"))
        centres = centres.copy()
        for r in exact.collect():  # centroids x components
            centres[r["cluster"], r["i"]] = int(r["t"]) // r["n"]

    def labelled(batch, points, nearest, distance, compared):
        if batch is not None:
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(nearest, pa.int32()), pa.array(distance, pa.int64()), pa.array(compared, pa.int32())], names=["vec_id", "cluster", "distance", "compared"])

    out = saved(_assigned(stored, centres, pivot_points, pairs, size, labelled, "vec_id bigint, cluster int, distance bigint, compared int"), "assigned")
    per = {r["cluster"]: r["d"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    facts = [F.struct(F.lit(per.get(c, 0)).cast("long").alias("own"), F.lit(n).alias("name")) for c, n in enumerate(names)]
    facts = F.get(F.array(*facts), F.col("cluster")) if facts else F.lit(None).cast("struct<own:bigint,name:string>")
    return out.select(
        "vec_id", "cluster", "distance", facts["own"].alias("cluster_inertia"), F.lit(sum(per.values())).cast("long").alias("inertia"), facts["name"].alias("centroid_sha256"), "compared"
    )


def oracle(k: int = 8, rounds: int = 10, seed: str = "3", size: int = 64, scale: int = 1024) -> str:
    """The same in SQL, every vector against every centroid; without ``compared``."""
    square = "list_sum(list_transform(range(1, %d), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT" % (size + 1)
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f", a{r} AS MATERIALIZED (SELECT vec_id, v, arg_min(n, d * {k} + n) AS n, min(d) AS d "
            f"FROM (SELECT id, vec_id, v, n, {square} AS d FROM kept, c{r}) GROUP BY id, vec_id, v)"
        )
        if r < rounds:
            steps.append(
                f", s{r} AS (SELECT n, list(m ORDER BY i) AS c FROM (SELECT n, i, ((s - ((s % c) + c) % c) // c)::BIGINT AS m FROM "
                f"(SELECT n, i, sum(v[i])::HUGEINT AS s, count(*) AS c FROM a{r}, (SELECT unnest(range(1, {size + 1})) AS i) GROUP BY n, i)) GROUP BY n)"
                f", c{r + 1} AS MATERIALIZED (SELECT c{r}.n, coalesce(s{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN s{r} ON c{r}.n = s{r}.n)"
            )
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {scale})::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS n, v AS c FROM (SELECT v, sha256('{seed}:' || vec_id) AS h FROM kept ORDER BY h, v LIMIT {k})
)
{"".join(steps)}
SELECT vec_id, a.n::INT AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.n)::BIGINT AS cluster_inertia,
  sum(a.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(f.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} f ON a.n = f.n"""
