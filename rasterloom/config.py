"""Parameters of the raster jobs, as frozen dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

#: The lower bounds of the seven brightness classes; a class ends where the next begins.
NATURAL_BREAKS = (float("-inf"), 0.001, 0.00325, 0.0065, 0.0125, 0.025, 0.1, float("inf"))


@dataclass(frozen=True)
class CleanConfig:
    """How raw counts become values: nodata is dropped first, then quality over the limit, then two divisions."""

    nodata: int | None = 65535
    max_quality: int = 1
    radiance_divisor: float = 10.0
    feature_scale: float = 100.0


@dataclass(frozen=True)
class GraphConfig:
    """Neighbourhood and edges: ``search_node`` neighbours out of a cube that grows from ext_range by up to max_ext."""

    search_node: int = 32
    ext_range: int = 6
    max_ext: int = 20
    edge_scale: float = 8.0
    edge_time: int = 50
    edge_height: int = 50
    edge_width: int = 50
    sample_per_class: int = 20_000
    breaks: tuple[float, ...] = NATURAL_BREAKS
    seed: int = 0

    @property
    def limits(self) -> dict[int, int]:
        """Quadrant -> neighbours to take from it."""
        return {q: self.search_node // 6 + (q <= self.search_node % 6) for q in range(1, 7)}

    @property
    def reach(self) -> int:
        return self.ext_range + self.max_ext

    def with_nodes(self, n: int) -> GraphConfig:
        return replace(self, search_node=n)


@dataclass(frozen=True)
class QualityConfig:
    """Scheme A: windows and exponents of the quality score, and the node count that follows from it."""

    window: int = 5
    alpha: float = 0.5
    beta: float = 0.3
    gamma: float = 0.2
    n_min: int = 18
    n_max: int = 54
    n_base: int = 36
    offset: float = 0.5
    slope: float = 1.0


@dataclass(frozen=True)
class HeterogeneityConfig:
    """Scheme B: the cube radius, the threshold and steepness of the weights, and the dynamic edges' reach."""

    radius: int = 5
    threshold: float = 0.25
    steepness: float = 10.0
    min_pixels: int = 8
    min_mean: float = 1e-6
    spatial_boost: float = 1.5
    temporal_extend: int = 3


@dataclass(frozen=True)
class CandidateConfig:
    """Scheme C: the candidate pool, its windows, the nodes kept and their nearest neighbours."""

    pool: int = 64
    initial_radius: int = 4
    max_radius: int = 20
    n_nodes: int = 36
    knn: int = 4
    feature_scale: float = 108.3
    edge_scale: float = 8.0
    include_center: bool = False

    @property
    def caps(self) -> tuple[int, ...]:
        q, rest = divmod(self.pool, 6)
        return tuple(int(q * 1.5) + (2 if i < rest else 0) for i in range(6))

    @property
    def least(self) -> int:
        return -(-self.pool // 6)


@dataclass(frozen=True)
class Config:
    """All of a job."""

    clean: CleanConfig = field(default_factory=CleanConfig)
    graph: GraphConfig = field(default_factory=GraphConfig)
    quality: QualityConfig = field(default_factory=QualityConfig)
    heterogeneity: HeterogeneityConfig = field(default_factory=HeterogeneityConfig)
    candidates: CandidateConfig = field(default_factory=CandidateConfig)
