"""Facts about meshes and levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefgrid.operators.mesh import Mesh, cross_product, triangle_corners
from reliefgrid.operators.regions import connected_components
from reliefgrid.runtime import cut, unbroadcast

_SIDES = (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))


def _real() -> Column:
    """Does a triangle name three vertices?"""
    return (F.col("v0") != F.col("v1")) & (F.col("v1") != F.col("v2")) & (F.col("v2") != F.col("v0"))


def edge_uses(mesh: Mesh) -> DataFrame:
    """Each undirected edge with its uses, those by triangles of three vertices (``real``), and how often it is used in its own direction."""
    sides = F.array(*[F.struct(F.col(p).alias("p"), F.col(q).alias("q")) for p, q in _SIDES])
    return (
        mesh.triangles.select("mesh_id", _real().alias("_real"), F.inline(sides))
        .groupBy("mesh_id", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
        .agg(F.count("*").alias("uses"), F.count_if("_real").alias("real"), F.count_if(F.col("p") < F.col("q")).alias("forward"))
    )


def vertex_fans(mesh: Mesh) -> DataFrame:
    """Number of separate face fans around each vertex; a clean surface has one everywhere.

    Two corners at a vertex belong together if their faces share an edge there. Each corner is named
    by face and place; the corners are linked through their shared edge and counted by component.
    """
    corner = F.array(
        *[
            F.struct(
                F.col(v).alias("vid"), F.col(o).alias("other"),
                (F.col("tid") * 3 + i).alias("corner"),
            )
            for i, v in enumerate(("v0", "v1", "v2"))
            for o in ("v0", "v1", "v2")
            if o != v
        ]
    )
    arms = mesh.triangles.select("mesh_id", F.inline(corner))
    # faces at the same edge end: link all of them to the smallest corner, which forms no pairs
    low = arms.groupBy("mesh_id", "vid", "other").agg(F.min("corner").alias("b"))
    edges = arms.join(unbroadcast(low), ["mesh_id", "vid", "other"]).select("mesh_id", F.col("corner").alias("a"), "b")
    parts = connected_components(edges, ["mesh_id"]).withColumnRenamed("node", "corner")
    owner = arms.select("mesh_id", "vid", "corner").distinct()
    return (
        owner.join(unbroadcast(parts), ["mesh_id", "corner"])
        .groupBy("mesh_id", "vid")
        .agg(F.count_distinct("root").alias("fans"))
    )


def face_links(mesh: Mesh) -> DataFrame:
    """Edges that exactly two triangles have: ``mesh_id, a, b`` (triangle ids) and ``alike`` (both turn the same way round).

    Triangles that name a vertex twice have no orientation and no links.
    """
    real = mesh.triangles.filter(_real())
    sides = F.array(*[F.struct(F.col(p).alias("p"), F.col(q).alias("q")) for p, q in _SIDES])
    each = real.select("mesh_id", "tid", F.inline(sides))
    met = each.groupBy("mesh_id", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi")).agg(
        F.count("*").alias("uses"), F.count_if(F.col("p") < F.col("q")).alias("forward"), F.min("tid").alias("a"), F.max("tid").alias("b")
    )
    return met.filter("uses = 2").select("mesh_id", "a", "b", (F.col("forward") == 1).alias("alike"))


def unorientable(mesh: Mesh) -> DataFrame:
    """The meshes (``mesh_id``) whose triangles cannot be turned so that neighbours run along their edge in opposite ways.

    Every triangle stands for two nodes, itself (its id) and itself turned over (the id's complement, below zero). A link
    of triangles that turn alike joins equal sides, any other link opposite ones. A mesh cannot be
    oriented if some triangle is connected with itself turned over: a path of links, however long and wherever its
    parts lie, comes back with the other sign. An edge of three or more triangles rules it out as well.
    """
    crowded = edge_uses(mesh).filter("real > 2").select("mesh_id")
    other = F.when(F.col("alike"), F.col("b")).otherwise(-F.col("b") - 1)
    links = face_links(mesh).withColumn("_b", other)
    both = F.array(
        F.struct(F.col("a").alias("a"), F.col("_b").alias("b")),
        F.struct((-F.col("a") - 1).alias("a"), (-F.col("_b") - 1).alias("b")),
    )
    parts = connected_components(links.select("mesh_id", F.inline(both)), ["mesh_id"])
    sides = parts.withColumn("_t", F.greatest("node", -F.col("node") - 1)).groupBy("mesh_id", "_t").agg(F.min("root").alias("_l"), F.max("root").alias("_h"))
    return sides.filter("_l = _h").select("mesh_id").unionByName(crowded).distinct()


def mesh_info(mesh: Mesh, fans: bool = False) -> DataFrame:
    """One row per mesh: counts, normals, closedness, orientation and bounds.

    Watertight: every edge in exactly two triangles (and with ``fans`` one face fan per vertex).
    Orientable: the triangles can be turned alike (:func:`unorientable`). Meshes that are turned alike as they stand
    are known from their edges; only the others are searched.
    """
    v = mesh.vertices
    normals = "nx" in v.columns
    per_v = v.groupBy("mesh_id").agg(
        F.count("*").alias("num_vertices"),
        F.array(*[F.min(c) for c in ("x", "y", "z")]).alias("bounding_box_min"),
        F.array(*[F.max(c) for c in ("x", "y", "z")]).alias("bounding_box_max"),
        F.array(*[F.max(c) - F.min(c) for c in ("x", "y", "z")]).alias("bounding_box_extent"),
    )
    per_t = mesh.triangles.groupBy("mesh_id").agg(F.count("*").alias("num_triangles"))
    per_e = cut(
        edge_uses(mesh).groupBy("mesh_id").agg(
            F.min(F.col("uses") == 2).alias("closed"),
            F.max("real").alias("_most"),
            F.min((F.col("forward") <= 1) & (F.col("uses") - F.col("forward") <= 1)).alias("is_orientable"),
        )
    )
    asked = per_e.filter("not is_orientable and _most <= 2").select("mesh_id")
    if not asked.isEmpty():
        turned = mesh.triangles.join(asked, "mesh_id", "left_semi")
        bad = unorientable(Mesh(v, turned)).withColumn("_bad", F.lit(True))
        per_e = per_e.join(asked.withColumn("_asked", F.lit(True)), "mesh_id", "left").join(bad, "mesh_id", "left")
        per_e = per_e.withColumn("is_orientable", F.col("is_orientable") | (F.col("_asked").isNotNull() & F.col("_bad").isNull()))
    per_e = per_e.select("mesh_id", "closed", "is_orientable")
    out = per_v.join(per_t, "mesh_id", "left").join(per_e, "mesh_id", "left")
    tight = F.coalesce("closed", F.lit(False))
    if fans:
        single = vertex_fans(mesh).groupBy("mesh_id").agg(F.min(F.col("fans") == 1).alias("single"))
        out = out.join(single, "mesh_id", "left")
        tight = tight & F.coalesce("single", F.lit(False))
    return out.select(
        "mesh_id", "num_vertices", F.coalesce("num_triangles", F.lit(0)).alias("num_triangles"),
        F.lit(normals).alias("has_vertex_normals"),
        F.lit("nx" in mesh.triangles.columns).alias("has_triangle_normals"),
        tight.alias("is_watertight"),
        F.coalesce("is_orientable", F.lit(True)).alias("is_orientable"),
        "bounding_box_min", "bounding_box_max", "bounding_box_extent",
    )


def require_mesh(mesh: Mesh, action: str = "get info from") -> Mesh:
    if mesh.vertices.isEmpty():
        raise ValueError(f"Cannot {action} empty mesh")
    return mesh


def mesh_volume(mesh: Mesh) -> DataFrame:
    """Enclosed volume and surface area per mesh, from signed tetrahedra."""
    n = cross_product()
    dot = sum((F.col(f"p0.{c}") * k for c, k in zip("xyz", n)), F.lit(0.0))
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    return triangle_corners(mesh).groupBy("mesh_id").agg(
        (F.sum(dot) / 6).alias("volume"), (F.sum(size) / 2).alias("surface")
    )


def cleanup_report(before: Mesh, after: Mesh) -> DataFrame:
    """Vertices and triangles before, after and removed, per mesh."""

    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("mesh_id").agg(F.count("*").alias(name))

    out = counts(before.vertices, "vertices_before")
    for df, name in (
        (before.triangles, "triangles_before"), (after.vertices, "vertices_after"), (after.triangles, "triangles_after"),
    ):
        out = out.join(counts(df, name), "mesh_id", "left")
    out = out.fillna(0)
    return out.withColumns(
        {
            "vertices_removed": F.col("vertices_before") - F.col("vertices_after"),
            "triangles_removed": F.col("triangles_before") - F.col("triangles_after"),
        }
    )


def level_report(levels: DataFrame, rings: DataFrame) -> DataFrame:
    """Polygons, holes and points per level; levels without any polygon are flagged."""
    per = rings.groupBy("level_idx").agg(
        F.count_distinct("raster_id", "poly_id").alias("polygons"),
        F.count_distinct(F.when(F.col("role") == "hole", F.struct("raster_id", "ring_id"))).alias("holes"),
        F.count("*").alias("points"),
    )
    out = levels.select("level_idx", "threshold").join(per, "level_idx", "left").fillna(0, ["polygons", "holes", "points"])
    return out.withColumn("empty", F.col("polygons") == 0)
