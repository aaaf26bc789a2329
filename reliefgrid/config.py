"""Settings of the pipelines, with the documented defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


def _default_thresholds() -> tuple[float, ...]:
    return tuple(50.0 * i / 9 for i in range(10))


# The default colour rules, in order of priority.
DEFAULT_COLOR_MAP: dict[str, dict[str, float]] = {
    "#0000FF": {"value": -10.0, "fuzziness": 5.0},
    "#00FFFF": {"value": -5.0, "fuzziness": 5.0},
    "#00FF00": {"value": 0.0, "fuzziness": 5.0},
    "#FFFF00": {"value": 5.0, "fuzziness": 5.0},
    "#FF0000": {"value": 10.0, "fuzziness": 5.0},
}


@dataclass(frozen=True)
class Units:
    x: float = 1.0
    y: float = 1.0
    z: float = 1.0


@dataclass(frozen=True)
class HeightmapSettings:
    exterior_buffer_width: int = 0
    exterior_buffer_value: float = 0.0
    data_offset: float = 0.0
    units: Units = Units()
    thresholds: tuple[float, ...] = field(default_factory=_default_thresholds)
    base_height: float = 0.0
    layer_thickness: float = 0.5


@dataclass(frozen=True)
class ContourSettings:
    min_polygon_area: float = 1e-2
    simplify_tolerance: float = 0.5
    max_segments: int = 100
    min_area_fraction: float = 0.01


@dataclass(frozen=True)
class TriangulationSettings:
    method: str = "grid"
    add_interior_points: bool = True
    interior_point_density: float = 1.0


@dataclass(frozen=True)
class CleanupSettings:
    apply: bool = True
    remove_degenerate: bool = True
    remove_duplicate_vertices: bool = True
    remove_duplicate_triangles: bool = True
    remove_unreferenced: bool = True
    merge_close: bool = False
    merge_threshold: float = 1e-6
    simplification: str = "none"
    target_triangles: int = 100_000
    voxel_size: float = 0.05


@dataclass(frozen=True)
class MeshSettings:
    heightmap: HeightmapSettings = HeightmapSettings()
    contour: ContourSettings = ContourSettings()
    triangulation: TriangulationSettings = TriangulationSettings()
    cleanup: CleanupSettings = CleanupSettings()
    combine_threshold: float = 1e-6
    #: "slice" builds the documented slices, "compat" the net effect of the original steps.
    mode: str = "slice"
    #: extrusion height; None means ``heightmap.layer_thickness`` (1.0 in compat mode)
    thickness: float | None = None
    #: folder for the stage tables; None keeps no snapshots
    stages_path: str | None = None


@dataclass(frozen=True)
class ImageSettings:
    max_dimension: int | None = None
    region: tuple[float, float, float, float] | None = None
    region_unit: str = "fraction"
    fill_missing: bool = True
    fill_mode: str = "frontier"
    fill_max_iterations: int = 100
    fill_neighborhood: int = 1
    color_map: dict = field(default_factory=lambda: dict(DEFAULT_COLOR_MAP))
    default_fuzziness: float = 10.0


@dataclass(frozen=True)
class TerrainSettings:
    size: int = 300
    x_range: tuple[float, float] = (-1.0, 1.0)
    y_range: tuple[float, float] = (-1.0, 1.0)
    central_peak: float = 0.8
    secondary_peak: float = 1.8
    wave_pattern: float = 1.8
    noise_level: float = 0.0
    add_zero_border: bool = True
    border_width: int = 2
    seed: int = 42
