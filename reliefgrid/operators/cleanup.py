"""Cleaning, merging, combining and reducing meshes. All steps are keyed by ``mesh_id``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefgrid.config import CleanupSettings
from reliefgrid.operators.mesh import Mesh, cross_product, triangle_corners, vertex_normals
from reliefgrid.operators.regions import connected_components
from reliefgrid.runtime import attach, cut, pinned, local_table, unbroadcast

_CORNERS = ("v0", "v1", "v2")


#: Up to this many moved vertices are sent to the triangles instead of shuffling the triangles.
BROADCAST_MOVES = 500_000


def remap(triangles: DataFrame, moved: DataFrame) -> DataFrame:
    """Re-point triangles: ``moved`` (mesh_id, vid, to) lists only the vertices that change.

    The list is written once and counted: if it is empty the triangles are returned untouched, if it
    is short it is broadcast, and only a long one is joined corner by corner.
    """
    moved = cut(moved.select("mesh_id", "vid", "to"))
    n = moved.count()
    out = triangles.select("mesh_id", "tid", *_CORNERS)
    if n == 0:
        return out
    moved = F.broadcast(moved) if n <= BROADCAST_MOVES else unbroadcast(moved)
    for c in _CORNERS:
        step = moved.withColumnsRenamed({"vid": c, "to": "_to"})
        out = out.join(step, ["mesh_id", c], "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    return out.select("mesh_id", "tid", *_CORNERS)


def remove_degenerate(mesh: Mesh, by: str = "index") -> Mesh:
    """Drop triangles that name a vertex twice, or with ``by="area"`` those without area."""
    distinct = (F.col("v0") != F.col("v1")) & (F.col("v1") != F.col("v2")) & (F.col("v0") != F.col("v2"))
    if by == "index":
        return Mesh(mesh.vertices, mesh.triangles.filter(distinct))
    c = cross_product()
    area2 = c[0] * c[0] + c[1] * c[1] + c[2] * c[2]
    kept = triangle_corners(mesh).filter(area2 > 0).select("mesh_id", "tid", *_CORNERS)
    return Mesh(mesh.vertices, kept)


def remove_duplicate_vertices(mesh: Mesh) -> Mesh:
    """Merge vertices at exactly the same place into the one with the smallest id."""
    place = ["mesh_id", "x", "y", "z"]
    first = cut(mesh.vertices.groupBy(*place).agg(F.min("vid").alias("vid"), F.count("*").alias("n")))
    vertices = first.select("mesh_id", "vid", "x", "y", "z")
    repeated = first.filter("n > 1").select(*place, F.col("vid").alias("to"))
    if repeated.isEmpty():
        return Mesh(vertices, mesh.triangles.select("mesh_id", "tid", *_CORNERS))
    moved = mesh.vertices.join(unbroadcast(repeated), place).filter("vid <> to").select("mesh_id", "vid", "to")
    return Mesh(vertices, remap(mesh.triangles, moved))


def remove_duplicate_triangles(mesh: Mesh, ignore_orientation: bool = False) -> Mesh:
    """Keep one triangle per set of corners; by default only equal turning directions match."""
    v0, v1, v2 = (F.col(c) for c in _CORNERS)
    if ignore_orientation:
        low, high = F.least(v0, v1, v2), F.greatest(v0, v1, v2)
        key = [low, v0 + v1 + v2 - low - high, high]
        form = (
            F.when((v0 == low) & (v2 == high), 0).when((v1 == low) & (v0 == high), 1).when((v2 == low) & (v1 == high), 2)
            .when((v0 == low) & (v1 == high), 3).when((v1 == low) & (v2 == high), 4).otherwise(5)
        )
        forms = [(0, 1, 2), (2, 0, 1), (1, 2, 0), (0, 2, 1), (1, 0, 2), (2, 1, 0)]
    else:
        form = F.when((v0 <= v1) & (v0 <= v2), 0).when((v1 <= v0) & (v1 <= v2), 1).otherwise(2)
        turns = ((v0, v1, v2), (v1, v2, v0), (v2, v0, v1))
        key = [F.when(form == 0, a).when(form == 1, b).otherwise(c) for a, b, c in zip(*turns)]
        forms = [(0, 1, 2), (2, 0, 1), (1, 2, 0)]
    # smallest id per form of the same corners: plain numbers, so the grouping is hashed, not sorted
    grouped = (
        mesh.triangles.withColumns({"_f": form, "_a": key[0], "_b": key[1], "_c": key[2]})
        .groupBy("mesh_id", "_a", "_b", "_c")
        .agg(*[F.min(F.when(F.col("_f") == i, F.col("tid"))).alias(f"_t{i}") for i in range(len(forms))])
        .withColumn("tid", F.least(*[F.col(f"_t{i}") for i in range(len(forms))]))
    )
    named = [F.col("_a"), F.col("_b"), F.col("_c")]

    def corner(k: int) -> Column:
        out = None
        for i, order in enumerate(forms):
            hit, value = F.col(f"_t{i}") == F.col("tid"), named[order[k]]
            out = F.when(hit, value) if out is None else out.when(hit, value)
        return out

    kept = grouped.select("mesh_id", "tid", *[corner(k).alias(c) for k, c in enumerate(_CORNERS)])
    return Mesh(mesh.vertices, kept)


def remove_unreferenced(mesh: Mesh) -> Mesh:
    """Drop vertices no triangle uses. The triangles are cut: they are read for the vertices, and again with the result."""
    triangles = cut(mesh.triangles)
    used = triangles.select("mesh_id", F.explode(F.array(*_CORNERS)).alias("vid")).distinct()
    return Mesh(mesh.vertices.join(unbroadcast(used), ["mesh_id", "vid"], "left_semi"), triangles)


#: Side of the cells that rule out lonely vertices, in units of the merge distance.
CELL_EPS = 1_000.0
#: Where the cells start, in units of their side: nothing that round coordinates hit.
CELL_START = 0.3819660112501051


def company_cells(points: DataFrame, eps: float) -> DataFrame:
    """Cells of side ``CELL_EPS * eps`` (hashed) of each point, with those whose border it lies within ``eps`` of.

    The cells are moved off the origin: places with round coordinates would lie on the borders of cells and stand in
    eight of them.
    """
    side, reach = CELL_EPS * eps, 1.01 * eps
    out = points.select("mesh_id", "vid", "x", "y", "z")
    for c in ("x", "y", "z"):
        ends = [F.floor((F.col(c) - CELL_START * side + d) / side) for d in (-reach, reach)]
        out = out.withColumn(f"c{c}", F.explode(F.sequence(*ends)))
    return out.select("mesh_id", "vid", F.xxhash64("mesh_id", "cx", "cy", "cz").alias("cell"))


def with_company(points: DataFrame, eps: float) -> DataFrame:
    """The points that share a cell with another (:func:`company_cells`).

    That is about one row per point from which the search for close pairs starts. Two cells of one hash add points to the
    search and lose none.
    """
    cells = company_cells(points, eps)
    # written, so that few shared cells are sent to the points instead of shuffling the points
    shared = cut(cells.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1").select("cell"))
    if shared.isEmpty():
        return points.limit(0)
    near = cells.join(shared, "cell", "left_semi").select("mesh_id", "vid").distinct()
    return points.join(near, ["mesh_id", "vid"], "left_semi")


def _close_links(points: DataFrame, eps: float) -> DataFrame:
    """Edges that join all distinct positions within ``eps`` of each other.

    Space is cut into cubes so small that a cube's points are all within reach: they are linked to
    the cube's first point, without pairs. Between cubes one link is enough, so a cube is first
    described by its octants' bounding boxes; most cube pairs are decided by them, and only the
    boxes of undecided pairs are divided further until they are, or hold a single point each.
    """
    side = eps / 3.0**0.5
    axes = ("x", "y", "z")

    def cube(c: str, size: float) -> Column:
        return F.floor(F.col(c) / size).cast("long")

    home = cut(with_company(points, eps).select("mesh_id", "vid", *axes, *[cube(c, side).alias(f"q{c}") for c in axes]))
    q = ["mesh_id", "qx", "qy", "qz"]
    cubes = home.groupBy(*q).agg(F.min("vid").alias("hub"))
    inside = home.join(cubes, q).filter("vid <> hub").select("mesh_id", F.col("vid").alias("a"), F.col("hub").alias("b"))
    steps = [
        (dx, dy, dz)
        for dx in (-2, -1, 0, 1, 2) for dy in (-2, -1, 0, 1, 2) for dz in (-2, -1, 0, 1, 2)
        if (dx, dy, dz) > (0, 0, 0)
    ]
    near = F.broadcast(local_table(points.sparkSession, steps, "dx int, dy int, dz int"))
    other = cubes.select("mesh_id", *[F.col(f"q{c}").alias(f"n{c}") for c in axes], F.col("hub").alias("b"))
    pairs = cut(
        cubes.crossJoin(near)
        .select(*q, F.col("hub").alias("a"), *[(F.col(f"q{c}") + F.col(f"d{c}")).alias(f"n{c}") for c in axes])
        .join(other, ["mesh_id", "nx", "ny", "nz"])
    )
    links = inside
    if pairs.isEmpty():
        return links
    open_pairs = pairs.select("mesh_id", "a", "b")
    members = home.join(cubes, q).select("mesh_id", "hub", *axes)
    size = side
    # boxes of the two sides still to be compared; at the start each cube is one box
    level = open_pairs.select("mesh_id", "a", "b", *[F.lit(0).cast("long").alias(f"{s}{c}") for s in "ab" for c in axes])
    first = True
    for _ in range(40):
        keys = [F.col("mesh_id"), F.col("hub")] + ([F.lit(0).cast("long").alias(f"k{c}") for c in axes] if first
                else [cube(c, size).alias(f"k{c}") for c in axes])
        boxes = members.groupBy(*keys).agg(
            *[F.min(c).alias(f"lo_{c}") for c in axes], *[F.max(c).alias(f"hi_{c}") for c in axes]
        )
        if first:
            cand = level
        else:
            up = F.lit(2)

            def kids(s: str) -> DataFrame:
                parent = [
                    (F.lit(0).cast("long") if second else F.floor(F.col(f"k{c}") / up)).alias(f"{s}{c}") for c in axes
                ]
                return boxes.select("mesh_id", F.col("hub").alias(s), *parent, *[F.col(f"k{c}").alias(f"{s}k{c}") for c in axes])
            cand = level.join(kids("a"), ["mesh_id", "a", *[f"a{c}" for c in axes]]).join(
                kids("b"), ["mesh_id", "b", *[f"b{c}" for c in axes]]
            )
            cand = cand.select("mesh_id", "a", "b", *[F.col(f"{s}k{c}").alias(f"{s}{c}") for s in "ab" for c in axes])

        def side_box(s: str) -> DataFrame:
            return boxes.select(
                "mesh_id", F.col("hub").alias(s), *[F.col(f"k{c}").alias(f"{s}{c}") for c in axes],
                *[F.col(f"{e}_{c}").alias(f"{s}_{e}_{c}") for e in ("lo", "hi") for c in axes],
            )

        both = cand.join(side_box("a"), ["mesh_id", "a", *[f"a{c}" for c in axes]]).join(
            side_box("b"), ["mesh_id", "b", *[f"b{c}" for c in axes]]
        )
        zero = F.lit(0.0)
        gap = [F.greatest(F.col(f"a_lo_{c}") - F.col(f"b_hi_{c}"), F.col(f"b_lo_{c}") - F.col(f"a_hi_{c}"), zero) for c in axes]
        far = [F.greatest(F.col(f"a_hi_{c}") - F.col(f"b_lo_{c}"), F.col(f"b_hi_{c}") - F.col(f"a_lo_{c}")) for c in axes]
        dmin = F.sqrt(sum((g * g for g in gap), zero))
        dmax = F.sqrt(sum((g * g for g in far), zero))
        judged = cut(both.withColumns({"_sure": dmax <= eps, "_open": dmin <= eps}).filter("_open"))
        yes = judged.filter("_sure").select("mesh_id", "a", "b").distinct()
        links = links.unionByName(yes)
        level = judged.filter("not _sure").select("mesh_id", "a", "b", *[f"{s}{c}" for s in "ab" for c in axes])
        level = cut(level.join(yes, ["mesh_id", "a", "b"], "left_anti"))
        if level.isEmpty():
            return links
        second = first
        first = False
        size = size / 2
    raise RuntimeError("positions too close to the threshold to tell apart")


def _close_moves(vertices: DataFrame, eps: float) -> tuple[DataFrame, DataFrame]:
    """The vertices left when those within ``eps`` are merged, and the moves (mesh_id, vid, to) of the others."""
    place = ["mesh_id", "x", "y", "z"]
    spots = vertices.groupBy(*place).agg(F.min("vid").alias("vid"), F.count("*").alias("n"))
    spots = cut(spots)
    links = cut(_close_links(spots, eps))
    same = vertices.join(
        spots.filter("n > 1").select(*place, F.col("vid").alias("spot")), place
    ).filter("vid <> spot").select("mesh_id", "vid", "spot")
    if links.isEmpty():
        return spots.select("mesh_id", "vid", "x", "y", "z"), same.withColumnRenamed("spot", "to")
    roots = cut(connected_components(links, ["mesh_id"]))
    spot_root = spots.join(roots.withColumnRenamed("node", "vid"), ["mesh_id", "vid"], "left").withColumn(
        "root", F.coalesce("root", "vid")
    )
    merged = spot_root.groupBy("mesh_id", F.col("root").alias("vid")).agg(
        *[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in ("x", "y", "z")]
    )
    moved = spot_root.filter("vid <> root").select("mesh_id", "vid", F.col("root").alias("to"))
    follow = same.join(roots.withColumnRenamed("node", "spot"), ["mesh_id", "spot"], "left").select(
        "mesh_id", "vid", F.coalesce("root", "spot").alias("to")
    )
    return merged, moved.unionByName(follow)


def merge_close_vertices(mesh: Mesh, eps: float = 1e-6) -> Mesh:
    """Merge vertices connected by steps of at most ``eps``; the merged place is their mean."""
    vertices, moved = _close_moves(mesh.vertices, eps)
    return Mesh(vertices, remap(mesh.triangles, moved))


def clean_mesh(mesh: Mesh, config: CleanupSettings = CleanupSettings()) -> Mesh:
    """The configured steps in fixed order; an empty mesh passes through."""
    if config.remove_degenerate:
        mesh = remove_degenerate(mesh)
    if config.remove_duplicate_vertices:
        mesh = remove_duplicate_vertices(mesh)
    if config.remove_duplicate_triangles:
        mesh = remove_duplicate_triangles(mesh)
    if config.remove_unreferenced:
        mesh = remove_unreferenced(mesh)
    if config.merge_close:
        mesh = merge_close_vertices(mesh, config.merge_threshold)
    if config.simplification == "vertex_clustering":
        mesh = cluster_vertices(mesh, config.voxel_size)
    elif config.simplification == "quadric_decimation":
        mesh = decimate_to(mesh, config.target_triangles)
    elif config.simplification != "none":
        raise ValueError(f"Unknown simplification: {config.simplification}")
    return mesh


def quick_cleanup(mesh: Mesh, merge_threshold: float = 1e-6) -> Mesh:
    return clean_mesh(mesh, CleanupSettings(merge_close=True, merge_threshold=merge_threshold))


# ---- numbering and combining -----------------------------------------------------------------


def dense_ids(df: DataFrame, order: Sequence[str], name: str, start: int = 0) -> DataFrame:
    """Number rows ``start, start + 1, ...`` in the given order without a global window.

    Rows are range-partitioned and sorted, the partition sizes (one row per partition) give each
    partition its first number.
    """
    ordered = pinned(df.repartitionByRange(*order).sortWithinPartitions(*order))
    marked = ordered.withColumn("_m", F.monotonically_increasing_id())
    part = F.shiftright("_m", 33)
    sizes = marked.groupBy(part.alias("_p")).agg(F.count("*").alias("n")).orderBy("_p").collect()
    rows, at = [], start
    for r in sizes:
        rows.append((r["_p"], at))
        at += r["n"]
    starts = F.broadcast(local_table(df.sparkSession, rows, "_p long, _s long"))
    return (
        marked.withColumn("_p", part)
        .join(starts, "_p")
        .withColumn(name, F.col("_s") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_m", "_p", "_s")
    )


def vertex_offsets(mesh: Mesh) -> DataFrame:
    """Vertices of each mesh and the number of vertices before it, in order of ``mesh_id``.

    The per-mesh counts are range-partitioned; partition totals (one row each) give every partition
    its start, and a window runs only within a partition.
    """
    from pyspark.sql import Window

    counts = mesh.vertices.groupBy("mesh_id").agg(F.count("*").alias("vertices"))
    ordered = pinned(counts.repartitionByRange("mesh_id").sortWithinPartitions("mesh_id"))
    marked = ordered.withColumn("_p", F.shiftright(F.monotonically_increasing_id(), 33))
    rows, at = [], 0
    for r in marked.groupBy("_p").agg(F.sum("vertices").alias("n")).orderBy("_p").collect():
        rows.append((r["_p"], at))
        at += r["n"]
    starts = F.broadcast(local_table(mesh.vertices.sparkSession, rows, "_p long, _s long"))
    w = Window.partitionBy("_p").orderBy("mesh_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_s") + F.coalesce(F.sum("vertices").over(w), F.lit(0))
    return marked.join(starts, "_p").withColumn("first_vertex", before).drop("_p", "_s")


def _numbered(mesh: Mesh, mesh_id: Column | None) -> tuple[DataFrame, DataFrame, DataFrame, Column]:
    """Renumbered vertices, the moves of their ids, renumbered triangles that keep their corners, and the new mesh id."""
    numbered = dense_ids(mesh.vertices, ["mesh_id", "vid"], "new_vid")
    ids = numbered.select("mesh_id", "vid", F.col("new_vid").alias("to"))
    triangles = dense_ids(mesh.triangles, ["mesh_id", "tid"], "new_tid").withColumn("tid", F.col("new_tid"))
    mesh_id = F.lit("combined") if mesh_id is None else mesh_id
    vertices = numbered.select(mesh_id.alias("mesh_id"), F.col("new_vid").alias("vid"), "x", "y", "z")
    return vertices, ids, triangles.select("mesh_id", "tid", *_CORNERS), mesh_id


def concat_meshes(mesh: Mesh, mesh_id: Column | None = None) -> Mesh:
    """Put meshes together under new ids; vertices are renumbered 0, 1, ... in order of mesh."""
    vertices, ids, triangles, mesh_id = _numbered(mesh, mesh_id)
    return Mesh(vertices, remap(triangles, ids).select(mesh_id.alias("mesh_id"), "tid", *_CORNERS))


def combine_meshes(
    meshes: Mesh | Sequence[Mesh], merge_threshold: float = 1e-6, mesh_id: Column | None = None
) -> Mesh:
    """Concatenate, merge close vertices, drop degenerate triangles and unused vertices.

    The numbers of the concatenated meshes and the merged vertices reach the triangles together.
    Takes one keyed mesh table pair or a list of them (with distinct ids). ``mesh_id`` says which
    meshes belong together. No meshes at all is an error; empty meshes add nothing.
    """
    if isinstance(meshes, Mesh):
        meshes = [meshes]
    if not meshes:
        raise ValueError("No meshes provided for combination")
    all_v, all_t = meshes[0].vertices, meshes[0].triangles
    for m in meshes[1:]:
        all_v, all_t = all_v.unionByName(m.vertices), all_t.unionByName(m.triangles)
    vertices, ids, triangles, mesh_id = _numbered(Mesh(all_v.select("mesh_id", "vid", "x", "y", "z"), all_t), mesh_id)
    vertices, moved = _close_moves(vertices, merge_threshold)
    # new numbers are unique over all meshes; both moves in one, so that the triangles are re-pointed once
    again = unbroadcast(moved.select(F.col("vid").alias("to"), F.col("to").alias("_to")))
    ids = ids.join(again, "to", "left").select("mesh_id", "vid", F.coalesce("_to", "to").alias("to"))
    triangles = remap(triangles, ids).select(mesh_id.alias("mesh_id"), "tid", *_CORNERS)
    return remove_unreferenced(remove_degenerate(Mesh(vertices, triangles)))


def with_normals(mesh: Mesh) -> Mesh:
    return Mesh(vertex_normals(mesh), mesh.triangles)


# ---- reduction -------------------------------------------------------------------------------


def _voxels(mesh: Mesh, size: float | DataFrame) -> tuple[DataFrame, list[Column]]:
    """Vertices with their voxel, for one ``size`` or a table (mesh_id, size)."""
    if isinstance(size, DataFrame):
        v = attach(mesh.vertices, size.select("mesh_id", F.col("size").alias("_size")), ["mesh_id"])
    else:
        v = mesh.vertices.withColumn("_size", F.lit(float(size)))
    low = [F.floor(F.col(c) / F.col("_size")).cast("long").alias(f"q{c}") for c in ("x", "y", "z")]
    return v.select("*", *low), [F.col(f"q{c}") for c in ("x", "y", "z")]


def cluster_vertices(mesh: Mesh, voxel_size: float = 0.05) -> Mesh:
    """One vertex per voxel at the mean place; collapsed and repeated triangles go."""
    v, q = _voxels(mesh, voxel_size)
    vertices = v.groupBy("mesh_id", *q).agg(
        F.min("vid").alias("vid"), *[F.avg(c).alias(c) for c in ("x", "y", "z")]
    )
    key = ["mesh_id", "qx", "qy", "qz"]
    moved = (
        v.select(*key, "vid")
        .join(vertices.select(*key, F.col("vid").alias("to")), key)
        .filter("vid <> to")
        .select("mesh_id", "vid", "to")
    )
    out = Mesh(vertices.select("mesh_id", "vid", "x", "y", "z"), remap(mesh.triangles, moved))
    return remove_duplicate_triangles(remove_degenerate(out))


def _quadric_vertices(mesh: Mesh, voxel_size: float | DataFrame) -> tuple[DataFrame, DataFrame]:
    """Voxel vertices at the least squared distance to their faces' planes, and the id moves."""
    v, q = _voxels(mesh, voxel_size)
    key = ["mesh_id", "qx", "qy", "qz"]
    v = cut(v)
    n = cross_product()
    planes = triangle_corners(mesh).select(
        "mesh_id", F.explode(F.array(*_CORNERS)).alias("vid"),
        *[c.alias(k) for c, k in zip(n, ("a", "b", "c"))],
        F.col("p0").alias("p"),
    )
    planes = planes.withColumn(
        "d", -(F.col("a") * F.col("p.x") + F.col("b") * F.col("p.y") + F.col("c") * F.col("p.z"))
    )
    sums = [
        F.sum(F.col(s) * F.col(t)).alias(s + t)
        for s, t in ("aa", "ab", "ac", "ad", "bb", "bc", "bd", "cc", "cd")
    ]
    quad = planes.join(v.select("mesh_id", "vid", "qx", "qy", "qz"), ["mesh_id", "vid"]).groupBy(*key).agg(*sums)
    mean = v.groupBy(*key).agg(F.min("vid").alias("to"), F.first("_size").alias("_size"), *[F.avg(c).alias(f"m{c}") for c in ("x", "y", "z")])
    j = mean.join(quad, key, "left")
    c = {k: F.col(k) for k in ("aa", "ab", "ac", "ad", "bb", "bc", "bd", "cc", "cd")}

    def det(m) -> Column:
        return (
            m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1])
            - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0])
            + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
        )

    a = [[c["aa"], c["ab"], c["ac"]], [c["ab"], c["bb"], c["bc"]], [c["ac"], c["bc"], c["cc"]]]
    rhs = [-c["ad"], -c["bd"], -c["cd"]]
    full = det(a)
    trace = c["aa"] + c["bb"] + c["cc"]
    sound = F.abs(full) > 1e-6 * trace * trace * trace
    solved = [
        det([[rhs[r] if k == i else a[r][k] for k in range(3)] for r in range(3)]) / full for i in range(3)
    ]
    # the optimum may lie far away where faces are nearly parallel: stay within the voxel
    low = [F.col(f"q{k}") * F.col("_size") for k in ("x", "y", "z")]
    inside = F.lit(True)
    for s, lo in zip(solved, low):
        inside = inside & (s >= lo) & (s <= lo + F.col("_size"))
    place = [
        F.when(sound & inside, s).otherwise(F.col(f"m{k}")).alias(k) for s, k in zip(solved, ("x", "y", "z"))
    ]
    vertices = j.select(*key, F.col("to").alias("vid"), *place)
    moved = v.select(*key, "vid").join(vertices.select(*key, F.col("vid").alias("to")), key)
    return vertices.select("mesh_id", "vid", "x", "y", "z"), moved.filter("vid <> to").select("mesh_id", "vid", "to")


def decimate_to(mesh: Mesh, target: int, max_steps: int = 12) -> Mesh:
    """At most ``target`` triangles in each mesh: quadric vertex clustering (Lindstrom, 2000).

    Each mesh has its own voxel size, found by doubling and halving on triangle counts; a step is one
    aggregate job over all meshes still too large. Vertices sit where the squared distance to their
    faces' planes is least. Raises if a mesh cannot come down to ``target``.
    """
    mesh = Mesh(cut(mesh.vertices), cut(mesh.triangles))
    heavy = mesh.triangles.groupBy("mesh_id").agg(F.count("*").alias("n")).filter(F.col("n") > target).select("mesh_id")
    spans = [F.max(c) - F.min(c) for c in ("x", "y", "z")]
    extent = mesh.vertices.groupBy("mesh_id").agg(F.greatest(*spans).alias("extent"))
    extent = extent.join(heavy, "mesh_id", "left_semi").withColumn("extent", F.when(F.col("extent") > 0, F.col("extent")).otherwise(1.0))
    sizes = cut(extent.withColumn("size", F.col("extent") / max(target, 1) ** 0.5))
    if sizes.isEmpty():
        return mesh
    large = Mesh(mesh.vertices.join(sizes, "mesh_id", "left_semi"), mesh.triangles.join(sizes, "mesh_id", "left_semi"))

    def too_many(at: DataFrame) -> DataFrame:
        """``at`` with ``over``: does the mesh keep more than ``target`` triangles at its ``size``?"""
        part = Mesh(large.vertices.join(at, "mesh_id", "left_semi"), large.triangles.join(at, "mesh_id", "left_semi"))
        v, q = _voxels(part, at)
        ids = v.select("mesh_id", "vid", F.xxhash64("mesh_id", *q).alias("to"))
        left = remove_duplicate_triangles(remove_degenerate(Mesh(part.vertices, remap(part.triangles, ids)))).triangles
        n = left.groupBy("mesh_id").agg(F.count("*").alias("n"))
        return cut(at.join(n, "mesh_id", "left").withColumn("over", F.coalesce(F.col("n") > target, F.lit(False))).drop("n"))

    fits, todo = None, sizes
    while not todo.isEmpty():
        judged = too_many(todo)
        good = judged.filter("not over").drop("over")
        fits = good if fits is None else fits.unionByName(good)
        todo = judged.filter("over").drop("over").withColumn("size", F.col("size") * 2)
        lost = todo.filter("size > 8 * extent").first()
        if lost is not None:
            raise ValueError(f"mesh {lost['mesh_id']} cannot be reduced to {target} triangles")
    state = cut(fits.select("mesh_id", (F.col("size") / 2).alias("lo"), F.col("size").alias("hi")))
    for _ in range(max_steps):
        open_ = state.filter("hi - lo >= 0.02 * hi")
        if open_.isEmpty():
            break
        judged = too_many(open_.withColumn("size", (F.col("lo") + F.col("hi")) / 2))
        moved = judged.select("mesh_id", F.when(F.col("over"), F.col("size")).otherwise(F.col("lo")).alias("lo"), F.when(F.col("over"), F.col("hi")).otherwise(F.col("size")).alias("hi"))
        state = cut(moved.unionByName(state.filter("not (hi - lo >= 0.02 * hi)")))
    vertices, moves = _quadric_vertices(large, state.withColumnRenamed("hi", "size"))
    out = remove_unreferenced(remove_duplicate_triangles(remove_degenerate(Mesh(vertices, remap(large.triangles, moves)))))
    light = Mesh(mesh.vertices.join(sizes, "mesh_id", "left_anti"), mesh.triangles.join(sizes, "mesh_id", "left_anti"))
    return Mesh(
        light.vertices.select(*out.vertices.columns).unionByName(out.vertices),
        light.triangles.select(*out.triangles.columns).unionByName(out.triangles),
    )
