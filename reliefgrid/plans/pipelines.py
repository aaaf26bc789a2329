"""Whole jobs: images to heights, heights to meshes, and presets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefgrid.config import ImageSettings, MeshSettings, TerrainSettings
from reliefgrid.operators import grid, mesh as M
from reliefgrid.operators.cleanup import clean_mesh, combine_meshes, with_normals
from reliefgrid.operators.fill import fill_missing
from reliefgrid.operators.inspect import mesh_info
from reliefgrid.operators.mesh import Mesh
from reliefgrid.operators.pixels import check_rgb, compile_rules, crop, map_colors, resample
from reliefgrid.operators.polygons import bounding_polygon, faces_of_polygons, polygon_labels, slice_polygons
from reliefgrid.operators.triangulate import triangulate_polygons
from reliefgrid.runtime import cut
from reliefgrid.sources.images import read_images
from reliefgrid.sources.mesh_files import write_mesh
from reliefgrid.sources.tables import write_cells

MESH_TYPES = ("flat", "extruded", "surface", "contour")


def image_to_heightmap(pixels: DataFrame, config: ImageSettings = ImageSettings(), save_path: str | None = None) -> DataFrame:
    """Pixels -> heights: shrink, crop, map colours, fill gaps; many images in one job."""
    pixels = check_rgb(pixels)
    if config.max_dimension is not None:
        pixels = resample(pixels, config.max_dimension)
    if config.region is not None:
        pixels = crop(pixels, config.region, config.region_unit)
    cells = map_colors(pixels, compile_rules(config.color_map, config.default_fuzziness))
    if config.fill_missing:
        # filling looks at the heights several times; decode and match the pixels only once
        cells = fill_missing(cut(cells), config.fill_mode, config.fill_neighborhood, config.fill_max_iterations)
    if save_path is not None:
        write_cells(cells, save_path)
    return cells


def image_file_to_heightmap(spark: SparkSession, path: str, config: ImageSettings = ImageSettings(), save_path: str | None = None) -> DataFrame:
    """The same from image files; every file is one raster."""
    return image_to_heightmap(read_images(spark, path), config, save_path)


def prepare_heights(cells: DataFrame, config: MeshSettings = MeshSettings()) -> DataFrame:
    """Scale, offset and pad."""
    h = config.heightmap
    return grid.pad(
        grid.scale_offset(cells, h.units.z, h.data_offset), h.exterior_buffer_width, h.exterior_buffer_value
    )


def raster_of(parts: int):
    """Raster of a mesh id: everything before its last ``parts`` components."""
    return F.regexp_replace("mesh_id", f"(/[^/]*){{{parts}}}$", "")


def _thickness(config: MeshSettings) -> float:
    if config.thickness is not None:
        return config.thickness
    return 1.0 if config.mode == "compat" else config.heightmap.layer_thickness


def write_stages(path: str, **tables: DataFrame) -> dict[str, DataFrame]:
    """Save stage tables to Parquet, by level where they have one, and return them read back."""
    out = {}
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if "level_idx" in df.columns:
            writer = writer.partitionBy("level_idx")
        writer.parquet(f"{path}/{name}")
        out[name] = df.sparkSession.read.parquet(f"{path}/{name}")
    return out


def level_solids(cells: DataFrame, levels: DataFrame, config: MeshSettings = MeshSettings()) -> Mesh:
    """One extruded mesh per raster and level (grid method) or per polygon (Delaunay method).

    The area filters of ``ContourSettings`` hold for both; simplification is for polygons, the grid
    method covers each slice exactly.
    """
    units = (config.heightmap.units.x, config.heightmap.units.y)
    thickness = _thickness(config)
    cells = cut(cells)  # covers, walls, regions and rings each read them
    exact = config.mode == "slice" and config.triangulation.method == "grid"
    c = config.contour
    if exact:
        faces, labels = None, None
        if c.min_polygon_area > 0 or c.min_area_fraction > 0:
            labels = polygon_labels(cells, levels) if config.stages_path is not None else None
            faces = faces_of_polygons(M.triangulate_grid(cells, levels), cells, levels, c.min_polygon_area, c.min_area_fraction, labels=labels)
        if config.stages_path is not None:
            # the mesh is made from the stage tables, so they cannot differ
            rings = slice_polygons(cells, levels, c.min_polygon_area, c.min_area_fraction, labels=labels)
            faces = M.triangulate_grid(cells, levels) if faces is None else faces
            faces = write_stages(config.stages_path, faces=faces, contours=rings)["faces"].select(*faces.columns)
            cover = M.flat_cover(faces, units)
            write_stages(config.stages_path, vertices_2d=cover.vertices, triangles=cover.triangles)
        return M.grid_solid(cells, levels, thickness, units, faces=faces)
    rings = cut(
        slice_polygons(
            cells, levels, c.min_polygon_area, c.min_area_fraction, config.mode,
            max_segments=c.max_segments, tolerance=c.simplify_tolerance,
        )
    )
    if config.mode != "compat":
        # units are configured but not applied to contour meshes in the original
        scale = {"x": units[0], "nx": units[0], "y": units[1], "ny": units[1]}
        rings = rings.withColumns({k: F.col(k) * v for k, v in scale.items()})
    t = config.triangulation
    cover, edges = triangulate_polygons(
        rings, t.interior_point_density if t.add_interior_points else None, check_valid=False
    )
    if config.stages_path is not None:
        write_stages(config.stages_path, contours=rings, vertices_2d=cover.vertices, triangles=cover.triangles)
    body = M.extrude(cover, levels, thickness, outward=config.mode != "compat")
    if config.mode == "compat":
        edges = edges.filter("exterior")
    return Mesh(body.vertices, body.triangles.unionByName(M.side_walls(edges)))


def heightmap_to_mesh(
    cells: DataFrame,
    config: MeshSettings = MeshSettings(),
    levels: DataFrame | None = None,
    save_path: str | None = None,
) -> Mesh:
    """All levels stacked into one mesh per raster: slice, extrude, clean, combine, clean."""
    h = config.heightmap
    prepared = prepare_heights(cells, config)
    if levels is None:
        levels = grid.levels_table(cells.sparkSession, h.thresholds, h.base_height, h.layer_thickness)
    solids = level_solids(prepared, levels, config)
    cleanup = config.cleanup
    # reducing is for the finished mesh only
    per_level = replace(cleanup, simplification="none")
    mesh = clean_mesh(solids, per_level) if cleanup.apply else solids
    mesh = Mesh(cut(mesh.vertices), mesh.triangles if cleanup.apply and cleanup.remove_unreferenced else cut(mesh.triangles))
    parts = 1 if config.mode == "slice" and config.triangulation.method == "grid" else 2
    mesh = combine_meshes(mesh, config.combine_threshold, raster_of(parts))
    if cleanup.apply:
        mesh = clean_mesh(mesh, cleanup)
    mesh = with_normals(mesh)
    if save_path is not None:
        write_mesh(mesh, save_path)
    return mesh


def grid_to_mesh(
    cells: DataFrame, n_levels: int, config: MeshSettings = MeshSettings(), lowest: float | None = None,
    save_path: str | None = None,
) -> Mesh:
    """Mesh with offset and thresholds taken from the data.

    One aggregate gives each raster's range; heights are lifted by -1.1 times the lowest, and the
    thresholds run from ``lowest`` (default: 90 % of the border height) to the lifted highest.
    """
    stats = cut(grid.grid_summary(cells))
    offsets = stats.select("raster_id", (F.col("min") * -1.1).alias("offset"))
    lifted = grid.apply_offsets(cells, offsets, config.heightmap.units.z)
    start = config.heightmap.exterior_buffer_value * 0.9 if lowest is None else lowest
    bounds = stats.select(
        "raster_id", F.lit(float(start)).alias("lo"), (F.col("min") * -1.1 + F.col("max")).alias("hi")
    )
    levels = grid.level_heights(
        grid.levels_linspace_by(bounds, n_levels), config.heightmap.base_height, config.heightmap.layer_thickness
    )
    inner = replace(config.heightmap, data_offset=0.0, units=replace(config.heightmap.units, z=1.0))
    return heightmap_to_mesh(lifted, replace(config, heightmap=inner), levels, save_path)


# ---- single meshes by type -------------------------------------------------------------------


def _bounding_cover(cells: DataFrame, units) -> tuple[Mesh, DataFrame]:
    rings = bounding_polygon(grid.raster_meta(cells), units[0], units[1])
    cover, edges = triangulate_polygons(rings.withColumn("level_idx", F.lit(0)), density=None, check_valid=False)
    return cover, edges


def flat_mesh(cells: DataFrame, height: float = 0.0, use_contours: bool = False, threshold: float | None = None,
              units=(1.0, 1.0, 1.0)) -> Mesh:
    """The slice at a threshold, or the whole rectangle, at one height."""
    if use_contours:
        if threshold is None:
            raise ValueError("threshold is required when contours are used")
        levels = grid.levels_table(cells.sparkSession, [threshold])
        return M.place_flat(M.flat_cover(M.triangulate_grid(cells, levels), units[:2]), height)
    return M.place_flat(_bounding_cover(cells, units)[0], height)


def extruded_mesh(cells: DataFrame, base_height: float = 0.0, thickness: float = 1.0, use_contours: bool = False,
                  threshold: float | None = None, units=(1.0, 1.0, 1.0)) -> Mesh:
    """The slice at a threshold, or the whole rectangle, as a solid."""
    if use_contours and threshold is None:
        raise ValueError("threshold is required when contours are used")
    levels = grid.levels_table(cells.sparkSession, [threshold if use_contours else 0.0], base_height)
    if use_contours:
        return M.grid_solid(cells, levels, thickness, units[:2])
    cover, edges = _bounding_cover(cells, units)
    body = M.extrude(cover, levels, thickness)
    return Mesh(body.vertices, body.triangles.unionByName(M.side_walls(edges)))


def contour_mesh(cells: DataFrame, threshold: float | None = None, thickness: float = 1.0, extrude: bool = True,
                 units=(1.0, 1.0, 1.0)) -> Mesh:
    """Mesh of one contour; without a threshold each raster is cut at the middle of its range."""
    spark = cells.sparkSession
    if threshold is None:
        mid = grid.grid_summary(cells).select(
            "raster_id", F.lit(0).alias("level_idx"), ((F.col("min") + F.col("max")) / 2).alias("threshold"),
            F.lit(0.0).alias("base_z"),
        )
        levels = cut(mid)
    else:
        levels = grid.levels_table(spark, [threshold])
    if extrude:
        return M.grid_solid(cells, levels, thickness, units[:2])
    return M.place_flat(M.flat_cover(M.triangulate_grid(cells, levels), units[:2]), 0.0)


def make_mesh(cells: DataFrame, mesh_type: str, units=(1.0, 1.0, 1.0), save_path: str | None = None, **options) -> Mesh:
    """Dispatch on ``flat``, ``extruded``, ``surface`` or ``contour``."""
    kind = str(getattr(mesh_type, "value", mesh_type)).lower()
    builders = {"flat": flat_mesh, "extruded": extruded_mesh, "contour": contour_mesh}
    if kind == "surface":
        out = M.surface_mesh(cells, units, **options)
    elif kind in builders:
        out = builders[kind](cells, units=units, **options)
    else:
        raise ValueError(f"Unknown mesh type: {mesh_type}; choose one of {', '.join(MESH_TYPES)}")
    if save_path is not None:
        write_mesh(out, save_path)
    return out


def supported_mesh_types() -> list[str]:
    return list(MESH_TYPES)


def multi_level_mesh(cells: DataFrame, thresholds: Sequence[float], mesh_type: str = "extruded", base_height: float = 0.0,
                     thickness: float = 0.5, layer_spacing: float | None = None, units=(1.0, 1.0, 1.0)) -> Mesh:
    """All levels stacked and combined; levels lie ``thickness`` or ``layer_spacing`` apart."""
    levels = grid.levels_table(cells.sparkSession, thresholds, base_height, thickness, layer_spacing)
    if mesh_type == "flat":
        stacked = M.place_flat(M.flat_cover(M.triangulate_grid(cells, levels), units[:2]), levels=levels)
    elif mesh_type in ("extruded", "contour"):
        stacked = M.grid_solid(cells, levels, thickness, units[:2])
    else:
        raise ValueError(f"Unknown mesh type for levels: {mesh_type}")
    stacked = Mesh(cut(stacked.vertices), cut(stacked.triangles))
    return combine_meshes(stacked, mesh_id=raster_of(1))


# ---- preset ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class QuickSettings:
    mesh_type: str = "surface"
    terrain: TerrainSettings = TerrainSettings()
    thresholds: tuple[float, ...] = ()
    thickness: float = 0.5
    units: tuple[float, float, float] = (1.0, 1.0, 1.0)
    output_path: str | None = None


@dataclass(frozen=True)
class QuickResult:
    heightmap: DataFrame
    stats: DataFrame
    mesh: Mesh
    info: DataFrame

    def summary(self) -> str:
        s = self.stats.first()
        return (
            "Debug Workflow Results\n"
            f"Heightmap shape: ({s['height']}, {s['width']})\n"
            f"Heightmap range: {s['min']} to {s['max']}"
        )


def quick_run(spark: SparkSession, config: QuickSettings | None = None, generator=None, **options) -> QuickResult:
    """Generated (or caller-made) terrain to mesh in one call."""
    if config is not None and options:
        raise ValueError("Cannot provide both a config object and keyword options")
    cfg = config or QuickSettings(**options)
    cells = grid.from_generator(spark, generator) if generator else grid.synth_heightmap(spark, cfg.terrain)
    if cfg.thresholds:
        mesh = multi_level_mesh(cells, cfg.thresholds, cfg.mesh_type, thickness=cfg.thickness, units=cfg.units)
    else:
        mesh = make_mesh(cells, cfg.mesh_type, cfg.units)
    if cfg.output_path is not None:
        write_mesh(mesh, cfg.output_path)
    return QuickResult(cells, grid.grid_stats(cells), mesh, mesh_info(mesh))
