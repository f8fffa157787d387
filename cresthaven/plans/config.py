"""Parameters of the terrain pipeline, checked before anything runs."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

CRS = ("ENU", "WGS84", "BOTH")
# Ranges a job request may use.
RANGES = {"grid_res_m": (0.25, 10), "platform_slope_deg": (1, 45), "face_slope_deg": (10, 85), "min_line_m": (1, 500), "link_gap_m": (0, 150), "auto_gap_max_m": (10, 200)}
SWITCHES = ("auto_gap_enabled", "enhanced_link")


@dataclass(frozen=True)
class Config:
    # The parameters' names and defaults.
    input: str = ""
    output: str = ""
    grid_res_m: float = 1.0
    platform_slope_deg: float = 10.0
    face_slope_deg: float = 32.0
    min_step_drop_m: float = 2.0
    min_face_height_m: float = 3.0
    min_line_m: float = 25.0
    min_platform_px: int = 80
    min_arc_px: int = 8
    edge_seed_enabled: bool = True
    edge_seed_regions: list = field(default_factory=list)
    edge_seed_region_params: list = field(default_factory=list)
    edge_seed_protect_links: bool = False
    edge_seed_protected_region_indices: list = field(default_factory=list)
    guided_links: list = field(default_factory=list)
    guided_links_file: str = ""
    auto_gap_enabled: bool = False
    auto_gap_min_m: float = 25.0
    auto_gap_max_m: float = 120.0
    auto_gap_sample_step_m: float = 5.0
    auto_gap_edge_drop_m: float = 1.5
    auto_gap_edge_center_slope_deg: float = 32.0
    auto_gap_edge_support_2m_min: float = 0.75
    auto_gap_novelty_min: float = 0.75
    auto_gap_length_ratio_max: float = 1.5
    auto_gap_weak_edge_support_2m_min: float = 0.7
    auto_gap_weak_novelty_min: float = 0.65
    auto_gap_nms_radius_m: float = 20.0
    auto_gap_max_bridges: int = 60
    auto_gap_max_path_candidates: int = 2000
    edge_seed_center_slope_deg: float = 25.0
    edge_seed_drop_m: float = 2.0
    edge_seed_min_line_m: float = 15.0
    edge_seed_min_px: int = 8
    edge_seed_dedup_dist_m: float = 4.0
    edge_seed_local_link_enabled: bool = True
    edge_seed_local_link_buffer_m: float = 25.0
    edge_seed_local_link_gap_m: float = 50.0
    edge_seed_local_link_dz_max_m: float = 6.0
    edge_seed_local_link_min_cos: float = 0.0
    edge_seed_local_link_lateral_max_m: float = 25.0
    multiscale_enabled: bool = True
    multiscale_slope_deg: float = 12.0
    multiscale_min_platform_px: int = 50
    multiscale_min_line_m: float = 20.0
    multiscale_dedup_dist_m: float = 4.0
    multiscale_drop_m: float = 2.0
    multiscale_edge_center_slope_deg: float = 25.0
    multiscale_edge_dist_m: float = 2.0
    multiscale_edge_min_fraction: float = 0.6
    multiscale_network_gap_m: float = 60.0
    multiscale_isolated_min_length_m: float = 30.0
    multiscale_isolated_edge_fraction: float = 0.8
    simplify_tol_m: float = 1.2
    smooth_sigma_cells: float = 1.0
    ray_m: list = field(default_factory=lambda: [2.0, 3.0, 4.0, 5.0])
    output_crs: str = "WGS84"
    link_gap_m: float = 0.0
    link_dz_max_m: float = 5.0
    link_min_cos: float = 0.35
    link_lateral_max_m: float = 15.0
    link_w_dist: float = 4.0
    link_w_z: float = 1.0
    link_passes: int = 4
    enhanced_link: bool = True
    link_short_gap_m: float = 25.0
    link_short_dz_max_m: float = 3.0
    link_short_lateral_max_m: float = 18.0
    link_infer_gap_m: float = 100.0
    link_infer_dz_max_m: float = 9.0
    link_infer_min_cos: float = 0.1
    link_infer_lateral_max_m: float = 18.0
    link_edge_dist_m: float = 2.0
    link_edge_min_fraction: float = 0.7
    link_w_edge: float = 2.5
    link_allow_inferred: bool = True
    link_max_candidates_per_endpoint: int = 6
    preview: bool = True
    preview_show_enhanced_links: bool = False
    preview_line_width: float = 1.2
    preview_halo_width: float = 0.0
    enu_origin: dict = field(default_factory=lambda: {"lat": 25.66087416, "lon": 113.34421763, "h": 507.004})

    # our own: as the published figures came about (rays end at their component's bounding box, chains step in the
    # order of a Python set, crest and toe cells are paired by place)
    compat: bool = False

    def __post_init__(self):
        if self.output_crs not in CRS:
            raise ValueError(f"output_crs must be one of {CRS}")
        if self.grid_res_m <= 0 or not self.ray_m:
            raise ValueError("grid_res_m must be positive and ray_m not empty")

    @classmethod
    def from_dict(cls, values: dict, base: str | Path = ".") -> Config:
        """Known keys only; relative input, output and guide paths start from ``base``; a guide file replaces guided_links."""
        known = {f.name for f in fields(cls)}
        kept = {k: v for k, v in values.items() if k in known and v is not None}
        for k in ("input", "output", "guided_links_file"):
            if kept.get(k) and "://" not in kept[k]:
                kept[k] = str(Path(base, kept[k]))
        if kept.get("guided_links_file"):
            found = json.loads(Path(kept["guided_links_file"]).read_text(encoding="utf-8"))
            kept["guided_links"] = found.get("guided_links", []) if isinstance(found, dict) else found
        return cls(**kept)

    @classmethod
    def load(cls, path: str | Path) -> Config:
        return cls.from_dict(json.loads(Path(path).read_text(encoding="utf-8")), Path(path).parent)

    def but(self, **changes) -> Config:
        return replace(self, **changes)


def checked_request(params: dict) -> dict:
    """A job request's parameters: known names, finite numbers within range, real booleans."""
    for name, value in params.items():
        if name in SWITCHES:
            if not isinstance(value, bool):
                raise ValueError(f"{name} must be true or false")
        elif name in RANGES:
            low, high = RANGES[name]
            if isinstance(value, bool) or not isinstance(value, (int, float)) or not low <= value <= high:
                raise ValueError(f"{name} must be a number from {low} to {high}")
        else:
            raise ValueError(f"unknown parameter {name}")
    return dict(params)
