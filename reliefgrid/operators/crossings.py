"""Triangles of a mesh that cross each other."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliefgrid.operators.boxes import box_pairs
from reliefgrid.operators.mesh import Mesh, triangle_corners

AXES = "xyz"
CORNERS = [f"p{i}{c}" for i in range(3) for c in AXES]


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Is there a plane between the triangles ``a[i]`` and ``b[i]`` (n x 3 corners x 3)? Touching ones are not apart."""
    a, b = a - a[:, :1], b - a[:, :1]
    sides_a, sides_b = np.roll(a, -1, 1) - a, np.roll(b, -1, 1) - b
    normal_a, normal_b = np.cross(sides_a[:, 0], sides_a[:, 1]), np.cross(sides_b[:, 0], sides_b[:, 1])
    products = [np.cross(sides_a[:, i], sides_b[:, j]) for i in range(3) for j in range(3)]
    # normals, products of two sides and, for triangles in one plane, directions across each side
    axes = [normal_a, normal_b, *products, *[np.cross(n, s[:, i]) for n, s in ((normal_a, sides_a), (normal_b, sides_b)) for i in range(3)]]
    out = _between(a, b, axes)
    thin = np.nonzero(~(normal_a.any(1) & normal_b.any(1)))[0]
    if len(thin):  # segments and points: also along and across their lines and from one to the other
        step = b[:, 0] - a[:, 0]
        sides = [s[:, i] for s in (sides_a, sides_b) for i in range(3)]
        more = [step, *sides, *[np.cross(np.cross(step, s), s) for s in sides]]
        more += [np.cross(c, s) for k, c in enumerate(products) for s in (sides_a[:, k // 3], sides_b[:, k % 3])]
        out[thin] |= _between(a[thin], b[thin], [axis[thin] for axis in more])
    return out


def _between(a: np.ndarray, b: np.ndarray, axes: list[np.ndarray]) -> np.ndarray:
    """Does one of the directions have all of ``a[i]`` before all of ``b[i]``, or behind?"""
    out = np.zeros(len(a), bool)
    for axis in axes:
        on_a, on_b = np.einsum("nij,nj->ni", a, axis), np.einsum("nij,nj->ni", b, axis)
        out |= (on_a.max(1) < on_b.min(1)) | (on_b.max(1) < on_a.min(1))
    return out


def crossing_triangles(mesh: Mesh) -> DataFrame:
    """Pairs ``mesh_id, a, b`` (``a < b``) of triangles that meet without a common vertex.

    Triangles without area count as the segment or point that they are. Distances are decided in doubles, so on
    coordinates whose products are exact in them (lattices, halves) the answer is exact.
    """
    at = [F.col(f"p{i}.{c}").alias(f"p{i}{c}") for i in range(3) for c in AXES]
    flat = triangle_corners(mesh).select("mesh_id", "tid", F.array("v0", "v1", "v2").alias("corners"), *at)
    ends = [f(*[F.col(f"p{i}{c}") for i in range(3)]).alias(f"{e}_{c}") for e, f in (("lo", F.least), ("hi", F.greatest)) for c in AXES]
    pairs = box_pairs(flat.select("*", *ends)).filter(~F.arrays_overlap("a.corners", "b.corners"))
    both = pairs.select(
        "mesh_id", F.least("a.tid", "b.tid").alias("a"), F.greatest("a.tid", "b.tid").alias("b"), *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in CORNERS]
    )

    def run(batches):
        for batch in batches:
            one, two = (np.stack([batch.column(f"{s}_{c}").to_numpy(zero_copy_only=False) for c in CORNERS], 1).reshape(-1, 3, 3) for s in "ab")
            yield batch.select(["mesh_id", "a", "b"]).filter(pa.array(~apart(one, two)))

    types = dict(both.dtypes)
    return both.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in ("mesh_id", "a", "b")))
