"""Settings of the travel-diary operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Every threshold that an operator uses; semantics chooses between the known behaviour ("reference") and the plainly intended one
    ("corrected") where the two differ. Distances are metres, times seconds."""

    semantics: str = "reference"
    zone: str = "America/Toronto"
    min_points: int = 100
    max_accuracy: float = 100.0
    outlier_angle: float = 15.0
    outlier_distance: float = 100.0
    gap_distance: float = 1000.0
    min_gap_seconds: float | None = None
    subway_radius: float = 200.0
    segment_points: int = 5
    segment_seconds: float = 3600.0
    interpolation_distance: float = 30.0
    walking_speed: float = 5000 / 3600
    temporal_gap: float = 600.0
    weight_cutoff: float = 500.0
    kernel_bandwidth: float = 25.0
    kde_cells: int = 10
    kde_limit: int = 75_000
    minimum_activity: float = 600.0
    location_distance: float = 100.0
    naming_radius: float = 200.0
    emission_bandwidth: float = 75.0
    day_start_hour: int = 0

    def __post_init__(self):
        if self.interpolation_distance >= self.location_distance:
            raise ValueError("interpolation_distance must be below location_distance")
        if self.semantics not in ("reference", "corrected"):
            raise ValueError("semantics is reference or corrected")
