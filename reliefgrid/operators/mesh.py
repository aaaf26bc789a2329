"""Meshes as two tables, and the operators that build them.

``vertices(mesh_id, vid, x, y, z)`` and ``triangles(mesh_id, tid, v0, v1, v2)``. Ids are unique
within a mesh and derived from positions, so no numbering step is needed before export.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefgrid.operators.contour import corner_case, contour_segments, level_keys
from reliefgrid.operators.grid import join_levels, raster_meta, validate_cells
from reliefgrid.operators.rings import point_key
from reliefgrid.operators.tiles import TILE_BITS, blocks
from reliefgrid.runtime import attach, local_table, unbroadcast


@dataclass(frozen=True)
class Mesh:
    vertices: DataFrame
    triangles: DataFrame

    def cache(self) -> "Mesh":
        return Mesh(self.vertices.cache(), self.triangles.cache())


# ---- surface ---------------------------------------------------------------------------------


def surface_mesh(
    cells: DataFrame,
    units: tuple[float, float, float] = (1.0, 1.0, 1.0),
    axes: DataFrame | None = None,
    meta: DataFrame | None = None,
    validate: bool = True,
    tile_bits: int = TILE_BITS,
) -> Mesh:
    """One vertex per cell, two triangles per 2x2 block (cut from upper right to lower left).

    Vertex ids are ``row * width + col``. ``axes(raster_id, axis, idx, coord)`` replaces the even
    spacing by own coordinates.
    """
    if validate:
        validate_cells(cells)
    sx, sy, sz = (float(u) for u in units)
    meta = raster_meta(cells) if meta is None else meta
    width = meta.select("raster_id", F.col("width").cast("long").alias("_w"))
    sized = attach(cells, width, ["raster_id"])
    x, y = F.col("col") * sx, F.col("row") * sy
    if axes is not None:
        for name, index in (("x", "col"), ("y", "row")):
            a = axes.filter(F.col("axis") == name).select(
                "raster_id", F.col("idx").alias(index), F.col("coord").alias(f"_{name}")
            )
            sized = attach(sized, a, ["raster_id", index])
        x, y = F.col("_x") * sx, F.col("_y") * sy
    vertices = sized.select(
        F.col("raster_id").alias("mesh_id"),
        (F.col("row") * F.col("_w") + F.col("col")).alias("vid"),
        x.cast("double").alias("x"),
        y.cast("double").alias("y"),
        (F.col("value") * sz).alias("z"),
    )
    full = attach(blocks(cells, tile_bits).filter("inside = 4"), width, ["raster_id"])
    w = F.col("_w")
    ul = F.col("row") * w + F.col("col")
    quad = F.array(
        F.struct((ul * 2).alias("tid"), ul.alias("v0"), (ul + 1).alias("v1"), (ul + w).alias("v2")),
        F.struct((ul * 2 + 1).alias("tid"), (ul + 1).alias("v0"), (ul + w + 1).alias("v1"), (ul + w).alias("v2")),
    )
    triangles = full.select(F.col("raster_id").alias("mesh_id"), F.inline(quad))
    return Mesh(vertices, triangles)


# ---- slices without a solver -----------------------------------------------------------------

# The high part of a block per corner pattern, as a fan of points in the order
# x right, y down turning from x to y; a..d are the corners upper-left, upper-right, lower-right,
# lower-left, and T, R, B, L the middles of the sides.
FILL_TABLE = {
    1: ("aTL",), 2: ("TbR",), 3: ("abRL",), 4: ("LBd",), 5: ("aTBd",), 6: ("TbR", "LBd"), 7: ("abRBd",),
    8: ("RcB",), 9: ("aTL", "RcB"), 10: ("TbcB",), 11: ("abcBL",), 12: ("LRcd",), 13: ("aTRcd",),
    14: ("TbcdL",), 15: ("abcd",),
}
POINT_OFFSET = {
    "a": (0, 0), "T": (1, 0), "b": (2, 0), "R": (2, 1), "c": (2, 2), "B": (1, 2), "d": (0, 2), "L": (0, 1),
}


def _fill_rows(spark) -> DataFrame:
    rows = []
    for case, parts in FILL_TABLE.items():
        n = 0
        for part in parts:
            for i in range(1, len(part) - 1):
                corners = (part[0], part[i], part[i + 1])
                rows.append((case, n, *[v for c in corners for v in POINT_OFFSET[c]]))
                n += 1
    return local_table(spark, rows, "case int, n int, ax int, ay int, bx int, by int, cx int, cy int")


def triangulate_grid(cells: DataFrame, levels: DataFrame, tile_bits: int = TILE_BITS) -> DataFrame:
    """Triangles covering each level's slice, block by block from a 15-row table.

    Columns: ``raster_id, level_idx, tid, x0, y0, x1, y1, x2, y2`` in doubled coordinates, turning
    from x to y. Neighbouring blocks agree on their shared side, so the cover has no cracks and its
    border is exactly the segments of ``contour_segments``.
    """
    b = blocks(cells, tile_bits)
    t = F.col("threshold")
    hits = join_levels(b, level_keys(levels), t <= F.greatest("ul", "ur", "ll", "lr"))
    hits = hits.withColumn("case", corner_case(t))
    x, y = F.col("col") * 2, F.col("row") * 2
    tid = (F.shiftleft((F.col("row") + 1).cast("long"), 31) + F.col("col") + 1) * 4 + F.col("n")
    return hits.join(F.broadcast(_fill_rows(cells.sparkSession)), "case").select(
        "raster_id", "level_idx", tid.alias("tid"),
        *[(base + F.col(c)).alias(n) for base, c, n in (
            (x, "ax", "x0"), (y, "ay", "y0"), (x, "bx", "x1"), (y, "by", "y1"), (x, "cx", "x2"), (y, "cy", "y2"),
        )],
    )


def level_mesh_id() -> Column:
    return F.concat_ws("/", F.col("raster_id"), F.col("level_idx"))


def flat_cover(faces: DataFrame, units: tuple[float, float] = (1.0, 1.0)) -> Mesh:
    """Triangles in doubled coordinates -> 2-D mesh per raster and level (``x``, ``y`` only).

    A vertex is named by its position, so vertices are found by grouping the corners once.
    """
    corners = F.array(*[F.struct(F.col(f"x{i}").alias("px"), F.col(f"y{i}").alias("py")) for i in range(3)])
    key = [level_mesh_id().alias("mesh_id"), "raster_id", "level_idx"]
    vertices = (
        faces.select("raster_id", "level_idx", F.inline(corners))
        .distinct()
        .select(
            *key, point_key(F.col("px"), F.col("py")).alias("vid"),
            (F.col("px") / 2 * units[0]).alias("x"), (F.col("py") / 2 * units[1]).alias("y"),
        )
    )
    triangles = faces.select(
        *key, "tid", *[point_key(F.col(f"x{i}"), F.col(f"y{i}")).alias(f"v{i}") for i in range(3)]
    )
    return Mesh(vertices, triangles)


#: Added to a bottom vertex id to get the vertex above it; larger than any position key.
TOP = 1 << 62


def level_columns(levels: DataFrame) -> list[str]:
    return [c for c in ("raster_id", "level_idx") if c in levels.columns]


def place_flat(cover: Mesh, height: float | None = None, levels: DataFrame | None = None) -> Mesh:
    """A 2-D cover at one height, or at each level's ``base_z``."""
    if levels is None:
        vertices = cover.vertices.withColumn("z", F.lit(float(height)))
    else:
        key = level_columns(levels)
        vertices = attach(cover.vertices, levels.select(*key, F.col("base_z").alias("z")), key)
    return Mesh(
        vertices.select("mesh_id", "vid", "x", "y", "z"),
        cover.triangles.select("mesh_id", "tid", "v0", "v1", "v2"),
    )


def extrude(cover: Mesh, levels: DataFrame, thickness: float, outward: bool = True) -> Mesh:
    """Bottom at each level's ``base_z``, top ``thickness`` above it; side walls come separately.

    Triangles of ``cover`` turn from x to y. With ``outward`` the bottom looks down and the top up;
    otherwise the bottom keeps the triangulator's order and the top is reversed.
    """
    key = level_columns(levels)
    z = F.col("base_z")
    both = F.array(
        F.struct(F.col("vid").alias("vid"), z.alias("z")),
        F.struct((F.col("vid") + TOP).alias("vid"), (z + F.lit(float(thickness))).alias("z")),
    )
    vertices = (
        attach(cover.vertices, levels.select(*key, "base_z"), key)
        .withColumn("_b", both)
        .select("mesh_id", "x", "y", F.inline("_b"))
        .select("mesh_id", "vid", "x", "y", "z")
    )

    def face(n: int, order: tuple[str, str, str], up: int) -> Column:
        return F.struct(
            (F.col("tid") * 4 + n).alias("tid"), *[(F.col(c) + F.lit(up)).alias(f"v{i}") for i, c in enumerate(order)]
        )

    kept, turned = ("v0", "v1", "v2"), ("v2", "v1", "v0")
    bottom, top = (turned, kept) if outward else (kept, turned)
    triangles = cover.triangles.select("mesh_id", F.inline(F.array(face(0, bottom, 0), face(1, top, TOP))))
    return Mesh(vertices, triangles)


def side_walls(edges: DataFrame) -> DataFrame:
    """Two triangles per directed boundary edge ``mesh_id, a, b`` of bottom vertex ids.

    Every ring given gets walls; pass only exterior edges to wall only those. An edge is named by
    its start, at which only one boundary edge begins.
    """
    a, b = F.col("a"), F.col("b")

    def face(n: int, *corners: Column) -> Column:
        return F.struct((a * 4 + n).alias("tid"), *[c.alias(f"v{i}") for i, c in enumerate(corners)])

    return edges.select("mesh_id", F.inline(F.array(face(2, a, b, b + TOP), face(3, a, b + TOP, a + TOP))))


def boundary_edges(cells: DataFrame, levels: DataFrame, tile_bits: int = TILE_BITS) -> DataFrame:
    """Directed boundary edges of ``triangulate_grid``'s cover, by vertex id."""
    segments = contour_segments(cells, levels, tile_bits=tile_bits)
    return segments.select(
        level_mesh_id().alias("mesh_id"),
        point_key(F.col("x1"), F.col("y1")).alias("a"),
        point_key(F.col("x2"), F.col("y2")).alias("b"),
    )


def cover_edges(cover: Mesh) -> DataFrame:
    """Directed edges ``mesh_id, a, b`` that only one triangle of the cover has."""
    sides = F.array(*[F.struct(F.col(f"v{i}").alias("a"), F.col(f"v{(i + 1) % 3}").alias("b")) for i in range(3)])
    each = cover.triangles.select("mesh_id", F.inline(sides))
    pair = [F.least("a", "b").alias("_lo"), F.greatest("a", "b").alias("_hi")]
    once = each.groupBy("mesh_id", *pair).agg(F.count("*").alias("n"), F.min(F.col("a") < F.col("b")).alias("_up")).filter("n = 1")
    ends = [F.when(F.col("_up"), F.col(p)).otherwise(F.col(q)) for p, q in (("_lo", "_hi"), ("_hi", "_lo"))]
    return once.select("mesh_id", ends[0].alias("a"), ends[1].alias("b"))


def check_faces(mesh: Mesh) -> Mesh:
    """Raise if a triangle names a vertex that does not exist."""
    if not missing_corners(mesh).isEmpty():
        raise ValueError("Invalid face indices")
    return mesh


def missing_corners(mesh: Mesh) -> DataFrame:
    """Vertex ids used by triangles but absent from the vertices."""
    corners = mesh.triangles.select("mesh_id", F.explode(F.array("v0", "v1", "v2")).alias("vid"))
    return corners.join(mesh.vertices.select("mesh_id", "vid"), ["mesh_id", "vid"], "left_anti").distinct()


def grid_solid(
    cells: DataFrame,
    levels: DataFrame,
    thickness: float,
    units: tuple[float, float] = (1.0, 1.0),
    walls: str = "all",
    tile_bits: int = TILE_BITS,
    faces: DataFrame | None = None,
) -> Mesh:
    """Extruded slice of every level: covers, walls, one mesh per raster and level.

    ``faces`` are those of ``triangulate_grid``'s triangles to be used, if not all.
    """
    cover = flat_cover(triangulate_grid(cells, levels, tile_bits) if faces is None else faces, units)
    body = extrude(cover, levels, thickness)
    if walls == "all" and faces is not None:
        edges = cover_edges(cover)
    elif walls == "all":
        edges = boundary_edges(cells, levels, tile_bits)
    elif walls == "exterior":
        from reliefgrid.operators.polygons import slice_polygons

        points = slice_polygons(cells, levels, tile_bits=tile_bits).filter("role = 'exterior'")
        edges = points.select(
            level_mesh_id().alias("mesh_id"),
            point_key(F.col("x") * 2, F.col("y") * 2).alias("a"),
            point_key(F.col("nx") * 2, F.col("ny") * 2).alias("b"),
        )
    else:
        raise ValueError(f"Unknown walls: {walls}")
    return Mesh(body.vertices, body.triangles.unionByName(side_walls(edges)))


# ---- normals ---------------------------------------------------------------------------------


def triangle_corners(mesh: Mesh) -> DataFrame:
    """Triangles with their corner points ``p0, p1, p2``.

    One join per corner: that moves each triangle three times, where exploding the corners and
    grouping them again would move it six times. The vertices' exchange is reused.
    """
    place = mesh.vertices.select("mesh_id", "vid", F.struct("x", "y", "z").alias("_p"))
    out = mesh.triangles.select("mesh_id", "tid", "v0", "v1", "v2")
    for i in range(3):
        out = out.join(unbroadcast(place.withColumnsRenamed({"vid": f"v{i}", "_p": f"p{i}"})), ["mesh_id", f"v{i}"])
    return out.select("mesh_id", "tid", "v0", "v1", "v2", "p0", "p1", "p2")


def cross_product() -> list[Column]:
    """Unnormalised face normal from ``p0, p1, p2``."""
    u = [F.col(f"p1.{c}") - F.col(f"p0.{c}") for c in "xyz"]
    w = [F.col(f"p2.{c}") - F.col(f"p0.{c}") for c in "xyz"]
    return [u[1] * w[2] - u[2] * w[1], u[2] * w[0] - u[0] * w[2], u[0] * w[1] - u[1] * w[0]]


def _unit(x: Column, y: Column, z: Column) -> list[Column]:
    """Unit vector; a zero vector becomes (0, 0, 1)."""
    n = F.sqrt(x * x + y * y + z * z)
    return [F.when(n > 0, c / n).otherwise(F.lit(d)) for c, d in ((x, 0.0), (y, 0.0), (z, 1.0))]


def triangle_normals(mesh: Mesh) -> DataFrame:
    """Unit normal and area of each triangle."""
    n = cross_product()
    flat = triangle_corners(mesh).select("mesh_id", "tid", *[c.alias(k) for c, k in zip(n, ("cx", "cy", "cz"))])
    c = [F.col(k) for k in ("cx", "cy", "cz")]
    area = F.sqrt(c[0] * c[0] + c[1] * c[1] + c[2] * c[2]) / 2
    return flat.select("mesh_id", "tid", *[u.alias(k) for u, k in zip(_unit(*c), ("nx", "ny", "nz"))], area.alias("area"))


def vertex_normals(mesh: Mesh) -> DataFrame:
    """Vertices with normals: the faces' cross products summed per corner, then made unit length."""
    n = cross_product()
    faces = triangle_corners(mesh).select("mesh_id", "v0", "v1", "v2", *[c.alias(k) for c, k in zip(n, ("cx", "cy", "cz"))])
    sums = (
        faces.select("mesh_id", F.explode(F.array("v0", "v1", "v2")).alias("vid"), "cx", "cy", "cz")
        .groupBy("mesh_id", "vid")
        .agg(*[F.sum(k).alias(k) for k in ("cx", "cy", "cz")])
    )
    c = [F.coalesce(F.col(k), F.lit(0.0)) for k in ("cx", "cy", "cz")]
    joined = mesh.vertices.join(unbroadcast(sums), ["mesh_id", "vid"], "left")
    return joined.select(
        "mesh_id", "vid", "x", "y", "z", *[u.alias(k) for u, k in zip(_unit(*c), ("nx", "ny", "nz"))]
    )
