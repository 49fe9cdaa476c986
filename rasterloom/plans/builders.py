"""Whole jobs: graphs for training and prediction, and the three adaptive schemes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CandidateConfig, GraphConfig, HeterogeneityConfig, QualityConfig
from ..operators import edges as E
from ..operators import graphs, heterogeneity, positions, quality
from ..operators import neighborhood as N


@dataclass(frozen=True)
class Graphs:
    """Centres (graph_id, t, h, w, value, ...), nodes without centres, and edges; cells are all valid cells seen; kept is in the cluster's cache."""

    centers: DataFrame
    nodes: DataFrame
    edges: DataFrame
    cells: DataFrame
    kept: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        """Empties the cache of what building kept there, once the graphs are written."""
        for table in self.kept:
            table.unpersist()

    def packed(self, edge_scale: float = 8.0) -> DataFrame:
        return graphs.pack(self.centers, self.nodes, self.edges, edge_scale)

    def summary(self) -> DataFrame:
        return graphs.summarise(self.nodes, self.edges)


def numbered(centers: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Adds graph_id, a centre's place in the grid; sampled centres that repeat need an id of their own instead."""
    return centers.withColumn("graph_id", ((F.col("t") * shape[1] + F.col("h")) * shape[2] + F.col("w")).cast("long"))


def build(centers: DataFrame, voxels: DataFrame, shape: tuple[int, int, int], config: GraphConfig) -> Graphs:
    """The graphs of all centres at once: graph_id, t, h, w and perhaps n, the centre's own number of neighbours.

    Centres whose final cube leaves the grid, or whose quadrants stay short of their quota, make no graph.
    """
    cells = N.measured(N.extract(centers, voxels, config.reach))
    kept: list[DataFrame] = []
    nodes = N.inside_grid(N.nodes_of(centers, voxels, config, kept), shape)
    truth = centers.join(voxels.select("t", "h", "w", "value"), ["t", "h", "w"], "left")
    return Graphs(truth, nodes, E.all_edges(nodes), cells, tuple(kept))


def for_prediction(voxels: DataFrame, shape: tuple[int, int, int], config: GraphConfig) -> Graphs:
    """Graphs of every gap of the region; centres carry day, counted from the region's first."""
    edges = (config.edge_time, config.edge_height, config.edge_width)
    gaps = numbered(positions.missing(voxels, shape, edges), shape)
    return build(gaps.withColumn("day", F.col("t") - edges[0]), voxels, shape, config)


def for_training(voxels: DataFrame, shape: tuple[int, int, int], config: GraphConfig) -> Graphs:
    """Graphs of sampled valid centres of each class; repeats of a position are graphs of their own."""
    drawn = positions.training_centers(voxels, shape, config)
    return build(drawn.withColumn("graph_id", F.col("class").cast("long") * 1_000_000_000 + F.col("sample_id")), voxels, shape, config)


def adaptive_nodes(centers: DataFrame, voxels: DataFrame, shape: tuple[int, int, int], config: GraphConfig, scheme: QualityConfig) -> Graphs:
    """Scheme A: the number of neighbours follows the quality of the centre's pixel."""
    return build(quality.with_node_count(centers, quality.quality_map(voxels, scheme), scheme), voxels, shape, config)


def weighted(centers: DataFrame, voxels: DataFrame, shape: tuple[int, int, int], config: GraphConfig, scheme: HeterogeneityConfig, dynamic: bool = False) -> tuple[Graphs, DataFrame]:
    """Scheme B: graphs and, by graph_id, the index and weights of each; dynamic edges take the place of the usual ones if asked for."""
    made = build(centers, voxels, shape, config)
    w = heterogeneity.weights(heterogeneity.index(centers.select("graph_id", "t", "h", "w"), voxels, scheme), scheme)
    if dynamic:
        made = Graphs(made.centers, made.nodes, E.dynamic_edges(made.nodes, made.cells, w.select("graph_id", "w_spatial", "w_temporal"), scheme), made.cells, made.kept)
    return made, w


def from_candidates(centers: DataFrame, voxels: DataFrame, config: CandidateConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scheme C: the pool, the nodes (its nearest, idx from 0) and their first edges."""
    pool = N.candidates(centers, voxels, config)
    nodes = pool.where(F.col("rank") <= config.n_nodes).withColumn("idx", F.col("rank") - 1)
    nodes = nodes.withColumn("feature", (F.col("value") / F.lit(config.feature_scale)).cast("float"))
    return pool, nodes, E.scaled(E.nearest(nodes, config), config.edge_scale)
