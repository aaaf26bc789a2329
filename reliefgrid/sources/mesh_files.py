"""Mesh files: STL, PLY, OBJ and OFF.

A file is written in parallel: records are range-sorted, one small job adds up the bytes per
partition, and every task writes its own byte range of the final file. That needs a path all
executors share. On stores without random writes, save ``mesh_lines`` with ``df.write.text``; its
part files in order are the file.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefgrid.operators.cleanup import dense_ids, remap
from reliefgrid.operators.inspect import require_mesh
from reliefgrid.operators.mesh import Mesh, _unit, cross_product, triangle_corners
from reliefgrid.runtime import pinned

FORMATS = (".stl", ".ply", ".obj", ".off")


def check_export(mesh: Mesh, path: str) -> str:
    """Reject empty meshes and unknown suffixes, create parent folders; returns the suffix."""
    require_mesh(mesh, "export")
    suffix = os.path.splitext(path)[1].lower()
    if suffix not in FORMATS:
        raise ValueError(f"Unsupported mesh format: {suffix}")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    return suffix


def facets(mesh: Mesh) -> DataFrame:
    """One row per triangle: unit normal and the three corners."""
    n = cross_product()
    c = triangle_corners(mesh).select("mesh_id", "tid", "p0", "p1", "p2", *[k.alias(m) for k, m in zip(n, "uvw")])
    return c.select(
        "mesh_id", "tid",
        *[k.alias(m) for k, m in zip(_unit(F.col("u"), F.col("v"), F.col("w")), ("nx", "ny", "nz"))],
        *[F.col(f"p{i}.{a}").alias(f"{a}{i}") for i in range(3) for a in "xyz"],
    )


def indexed(mesh: Mesh) -> Mesh:
    """Vertices numbered 0, 1, ... and triangles re-pointed to these numbers."""
    v = dense_ids(mesh.vertices, ["mesh_id", "vid"], "idx")
    t = remap(mesh.triangles, v.select("mesh_id", "vid", F.col("idx").alias("to")))
    return Mesh(v.select("mesh_id", F.col("idx").alias("vid"), "x", "y", "z"), t)


def mesh_lines(mesh: Mesh, fmt: str) -> DataFrame:
    """Text of a PLY, OBJ or OFF file as ``section, ord, line``, in file order."""
    m = indexed(mesh)
    coords = [F.col(c).cast("string") for c in ("x", "y", "z")]
    corners = [F.col(c) for c in ("v0", "v1", "v2")]
    if fmt == "obj":
        v_line = F.concat_ws(" ", F.lit("v"), *coords)
        f_line = F.concat_ws(" ", F.lit("f"), *[(c + 1).cast("string") for c in corners])
        head: list[str] = []
    elif fmt in ("ply", "off"):
        v_line = F.concat_ws(" ", *coords)
        f_line = F.concat_ws(" ", F.lit("3"), *[c.cast("string") for c in corners])
        nv, nt = mesh.vertices.count(), mesh.triangles.count()
        head = (
            ["OFF", f"{nv} {nt} 0"]
            if fmt == "off"
            else [
                "ply", "format ascii 1.0", f"element vertex {nv}",
                "property double x", "property double y", "property double z",
                f"element face {nt}", "property list uchar int vertex_indices", "end_header",
            ]
        )
    else:
        raise ValueError(f"Unsupported mesh format: {fmt}")
    lines = m.vertices.select(F.lit(1).alias("section"), F.col("vid").alias("ord"), v_line.alias("line")).unionByName(
        m.triangles.select(F.lit(2).alias("section"), F.col("tid").alias("ord"), f_line.alias("line"))
    )
    if head:
        from reliefgrid.runtime import local_table

        top = local_table(mesh.vertices.sparkSession, [(0, i, h) for i, h in enumerate(head)], "section int, ord long, line string")
        lines = top.unionByName(lines)
    return lines


def _write_ranges(
    df: DataFrame,
    order: Sequence[str],
    path: str,
    header: Callable[[int], bytes],
    size: Column,
    encode: Callable[[pd.DataFrame], bytes],
) -> int:
    """Write ``df`` in order into one file, each partition into its own byte range."""
    fixed = pinned(df.repartitionByRange(*order).sortWithinPartitions(*order))
    part = F.shiftright(F.monotonically_increasing_id(), 33)
    marked = fixed.withColumn("_p", part)
    sizes = marked.groupBy("_p").agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).orderBy("_p").collect()
    head = header(sum(r["n"] for r in sizes))
    starts, at = {}, len(head)
    for r in sizes:
        starts[r["_p"]] = at
        at += r["bytes"]
    with open(path, "wb") as f:
        f.write(head)
        f.truncate(at)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pos = None
        for pdf in batches:
            if pdf.empty:
                continue
            if pos is None:
                pos = starts[pdf["_p"].iloc[0]]
            data = encode(pdf)
            with open(path, "r+b") as f:
                f.seek(pos)
                f.write(data)
            pos += len(data)
            yield pd.DataFrame({"bytes": [len(data)]})

    written = marked.mapInPandas(write, "bytes long").agg(F.sum("bytes").alias("b")).first()["b"] or 0
    if written + len(head) != at:
        raise OSError(f"wrote {written + len(head)} of {at} bytes to {path}")
    return at


def write_stl(mesh: Mesh, path: str) -> int:
    """Binary STL: 80-byte header, facet count, 50 bytes per facet."""
    check_export(mesh, path)
    cols = ["nx", "ny", "nz", *[f"{a}{i}" for i in range(3) for a in "xyz"]]

    def encode(pdf: pd.DataFrame) -> bytes:
        out = np.zeros(len(pdf), dtype=[("f", "<f4", 12), ("attr", "<u2")])
        out["f"] = pdf[cols].to_numpy(dtype=np.float32)
        return out.tobytes()

    def header(n: int) -> bytes:
        return b"binary stl".ljust(80, b"\0") + np.uint32(n).tobytes()

    return _write_ranges(facets(mesh), ["mesh_id", "tid"], path, header, F.lit(50), encode)


def stl_lines(mesh: Mesh) -> DataFrame:
    """ASCII STL as ordered lines: seven per facet, between ``solid`` and ``endsolid``."""
    def triple(*names: str) -> Column:
        return F.concat_ws(" ", *[F.col(n).cast("string") for n in names])

    parts = [
        F.concat(F.lit("facet normal "), triple("nx", "ny", "nz")),
        F.lit("outer loop"),
        *[F.concat(F.lit("vertex "), triple(f"x{i}", f"y{i}", f"z{i}")) for i in range(3)],
        F.lit("endloop"),
        F.lit("endfacet"),
    ]
    return facets(mesh).select("mesh_id", "tid", F.posexplode(F.array(*parts)).alias("part", "line"))


def write_lines(mesh: Mesh, path: str) -> int:
    """PLY, OBJ or OFF by suffix."""
    suffix = check_export(mesh, path)

    def encode(pdf: pd.DataFrame) -> bytes:
        return ("\n".join(pdf["line"]) + "\n").encode()

    lines = mesh_lines(mesh, suffix[1:])
    return _write_ranges(lines, ["section", "ord"], path, lambda n: b"", F.octet_length("line") + 1, encode)


def write_mesh(mesh: Mesh, path: str) -> int:
    """Write one mesh file, the format by suffix; returns its size in bytes."""
    return write_stl(mesh, path) if check_export(mesh, path) == ".stl" else write_lines(mesh, path)
