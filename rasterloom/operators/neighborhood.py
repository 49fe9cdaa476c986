"""Neighbours of centres: cube extraction, the adaptive radius, directional selection, candidate pools.

A band join on three axes becomes an equi-join: valid cells are stored as short runs of one pixel's days, keyed by
(h, w, block of days), and a centre asks for the pixels and blocks that its cube touches: (2r + 1) squared times at
most two keys instead of (2r + 1) cubed. Everything after the join is keyed by graph_id, so one exchange serves all.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CandidateConfig, GraphConfig
from ..functions.geometry import chebyshev, quadrant, region, squared

ORDER = ("d2", "dt", "dh", "dw")
#: The tables that this module has put in the cluster's cache, for whoever made the plan to release.
CACHED: list[DataFrame] = []


def cached(table: DataFrame) -> DataFrame:
    CACHED.append(table.persist())
    return table


@contextmanager
def releasing() -> Iterator[list[DataFrame]]:
    """The tables that go to the cache meanwhile, as a list for the caller to unpersist once its results are written."""
    before, mine = CACHED[:], []
    CACHED.clear()
    try:
        yield mine
    finally:
        mine += CACHED
        CACHED[:] = before


def runs(voxels: DataFrame, width: int) -> DataFrame:
    """Rows (h, w, block, cells): the valid cells of one pixel and ``width`` days, as structs (t, value)."""
    held = voxels.where(F.col("value").isNotNull())
    block = F.floor(F.col("t") / width).cast("int")
    return held.groupBy(F.col("h").alias("ph"), F.col("w").alias("pw"), block.alias("block")).agg(F.collect_list(F.struct("t", "value")).alias("cells"))


def extract(centers: DataFrame, voxels: DataFrame, radius: int, with_center: bool = False) -> DataFrame:
    """Valid cells of each centre's cube: graph_id, t, h, w, any other columns of centers, dt, dh, dw, value.

    The grid clips the cube. The centre itself is left out unless asked for.
    """
    spark, width = centers.sparkSession, 2 * radius + 1
    spatial = spark.range(width * width).select((F.floor(F.col("id") / width) - radius).cast("int").alias("dh"), (F.col("id") % width - radius).cast("int").alias("dw"))
    low, high = F.floor((F.col("t") - radius) / width).cast("int"), F.floor((F.col("t") + radius) / width).cast("int")
    asked = centers.crossJoin(F.broadcast(spatial)).withColumn("block", F.explode(F.sequence(low, high)))  # width squared rows
    asked = asked.withColumn("ph", F.col("h") + F.col("dh")).withColumn("pw", F.col("w") + F.col("dw"))
    found = asked.join(runs(voxels, width), ["ph", "pw", "block"]).drop("ph", "pw", "block")
    cells = found.withColumn("cell", F.explode("cells")).drop("cells").withColumn("dt", F.col("cell.t") - F.col("t"))
    inside = F.abs(F.col("dt")) <= radius
    if not with_center:
        inside = inside & ((F.col("dt") != 0) | (F.col("dh") != 0) | (F.col("dw") != 0))
    return cells.where(inside).select(*centers.columns, "dt", "dh", "dw", F.col("cell.value").alias("value"))


def measured(cells: DataFrame) -> DataFrame:
    """Adds d2, cheb and quadrant, and deals the cells out by graph once for all windows to come."""
    d = [F.col(c) for c in ("dt", "dh", "dw")]
    return cells.repartition("graph_id").withColumn("d2", squared(*d)).withColumn("cheb", chebyshev(*d)).withColumn("quadrant", quadrant(*d))


def quota(n: Column) -> Column:
    """Neighbours that a row's quadrant gives to n."""
    return F.floor(n / 6).cast("int") + (F.col("quadrant") <= n % 6).cast("int")


def quadrant_counts(cells: DataFrame, n: int) -> DataFrame:
    """Rows (graph_id, quadrant, valid, quota, enough) for the six quadrants of every graph, empty ones included."""
    counts = cells.where("quadrant > 0").groupBy("graph_id", "quadrant").agg(F.count("*").alias("valid"))
    every = cells.select("graph_id").distinct().withColumn("quadrant", F.explode(F.sequence(F.lit(1), F.lit(6))))
    full = every.join(counts, ["graph_id", "quadrant"], "left").withColumn("valid", F.coalesce("valid", F.lit(0)))
    return full.withColumn("quota", quota(F.lit(n))).withColumn("enough", F.col("valid") >= F.col("quota"))


def ranked_by_radius(cells: DataFrame, config: GraphConfig) -> DataFrame:
    """Cells with their graph's final radius; null where a quadrant cannot meet its quota.

    Growing the cube by one until every quadrant holds its quota ends at the Chebyshev radius of the last of each
    quadrant's quota, cells in order of that radius. A column n, if there, overrides the number of neighbours.
    """
    n = F.col("n") if "n" in cells.columns else F.lit(config.search_node)
    ring = Window.partitionBy("graph_id", "quadrant").orderBy("cheb", *ORDER)
    ranked = cells.withColumn("quota", quota(n)).withColumn("ring", F.row_number().over(ring))
    graph = Window.partitionBy("graph_id")
    last = F.when(F.col("ring") == F.col("quota"), F.col("cheb"))
    met = F.count(last).over(graph) == F.least(n, F.lit(6))
    return ranked.withColumn("radius", F.when(met, F.greatest(F.lit(config.ext_range), F.max(last).over(graph)))).drop("ring")


def adaptive_radius(cells: DataFrame, config: GraphConfig) -> DataFrame:
    """Rows (graph_id, radius) of the graphs that succeed within the reach."""
    found = ranked_by_radius(cells, config).where(F.col("radius") <= config.reach)
    return found.groupBy("graph_id").agg(F.max("radius").alias("radius"))


def select_nodes(cells: DataFrame, config: GraphConfig) -> DataFrame:
    """The nearest cells of each quadrant up to its quota, taken in turns: idx = 6 (k - 1) + quadrant.

    Only cells within the final radius are seen; graphs that miss a quota within the reach have no rows.
    """
    near = Window.partitionBy("graph_id", "quadrant").orderBy(*ORDER)
    seen = ranked_by_radius(cells, config).where((F.col("radius") <= config.reach) & (F.col("cheb") <= F.col("radius")))
    kept = seen.withColumn("k", F.row_number().over(near)).where(F.col("k") <= F.col("quota"))
    return kept.withColumn("idx", (F.col("k") - 1) * 6 + F.col("quadrant")).drop("quota", "k")


def select_at(cells: DataFrame, config: GraphConfig) -> DataFrame:
    """As select_nodes, of cells extracted at ext_range and no further: there is one radius, so one sort does."""
    n = F.col("n") if "n" in cells.columns else F.lit(config.search_node)
    near = Window.partitionBy("graph_id", "quadrant").orderBy(*ORDER)
    ranked = cells.withColumn("quota", quota(n)).withColumn("k", F.row_number().over(near)).where(F.col("k") <= F.col("quota"))
    full = F.count_if(F.col("k") == F.col("quota")).over(Window.partitionBy("graph_id")) == F.least(n, F.lit(6))
    kept = ranked.withColumn("full", full).where("full").withColumn("radius", F.lit(config.ext_range))
    return kept.withColumn("idx", (F.col("k") - 1) * 6 + F.col("quadrant")).drop("quota", "k", "full")


def rings(first: int, last: int) -> list[int]:
    """Radii over the first to look at in turn, each twice the one before, up to the last."""
    found = []
    while first < last:
        first = min(last, max(2 * first, first + 1))
        found.append(first)
    return found


def nodes_of(centers: DataFrame, voxels: DataFrame, config: GraphConfig, kept: list[DataFrame] | None = None) -> DataFrame:
    """select_nodes of all centres, kept in the cluster's cache: at ext_range first, then ring by ring for those alone that stay short.

    A cube of the whole reach holds 20 to 100 times the cells of the first one, so only centres that need it see it.
    The tables in the cache are added to ``kept``, for the caller to unpersist.
    """
    kept = [] if kept is None else kept
    found = cached(select_at(measured(extract(centers, voxels, config.ext_range)), config))
    kept.append(found)
    for radius in rings(config.ext_range, config.reach):
        left = centers.join(found.select("graph_id").distinct(), "graph_id", "left_anti").select(*centers.columns)
        more = cached(select_nodes(measured(extract(left, voxels, radius)), config).where(F.col("radius") <= radius))
        kept.append(more)
        found = found.unionByName(more)
    return found


def inside_grid(nodes: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Without graphs whose final cube leaves the grid."""
    held = F.lit(True)
    for name, size in zip(("t", "h", "w"), shape, strict=True):
        held = held & (F.col(name) >= F.col("radius")) & (F.col(name) + F.col("radius") < size)
    return nodes.where(held)


def candidates(centers: DataFrame, voxels: DataFrame, config: CandidateConfig) -> DataFrame:
    """Scheme C's pool: graph_id, rank, dt, dh, dw, value, region, radius, centre columns; in the cluster's cache.

    The radius is the least from initial_radius on at which every region holds ``least`` valid cells; graphs that
    reach none by max_radius have no rows. Cells come nearest first, those beyond their region's loose cap after all
    others, up to the pool's size. The centre, were it valid, would give away its own value: it is left out unless
    the configuration includes it. Wide cubes are cut out only for centres that need them, ring by ring.
    """
    found = None
    for radius in (config.initial_radius, *rings(config.initial_radius, config.max_radius)):
        left = centers
        if found is not None:
            left = centers.join(found.select("graph_id").distinct(), "graph_id", "left_anti").select(*centers.columns)
        more = cached(candidates_within(left, voxels, config, radius))
        found = more if found is None else found.unionByName(more)
    return found


def candidates_within(centers: DataFrame, voxels: DataFrame, config: CandidateConfig, far: int) -> DataFrame:
    """The pools of the centres whose radius is at most ``far``."""
    d = [F.col(c) for c in ("dt", "dh", "dw")]
    cells = extract(centers, voxels, far, with_center=config.include_center).repartition("graph_id")
    cells = cells.withColumn("d2", squared(*d)).withColumn("cheb", chebyshev(*d)).withColumn("region", region(*d))
    ring = Window.partitionBy("graph_id", "region").orderBy("cheb", *ORDER)
    last = F.when(F.row_number().over(ring) == config.least, F.col("cheb"))
    graph = Window.partitionBy("graph_id")
    grown = cells.withColumn("last", last).withColumn("radius", F.when(F.count("last").over(graph) == 6, F.greatest(F.lit(config.initial_radius), F.max("last").over(graph))))
    seen = grown.where((F.col("radius") <= far) & (F.col("cheb") <= F.col("radius"))).drop("last")
    cap = F.element_at(F.array(*[F.lit(c) for c in config.caps]), F.col("region") + 1)
    over = F.row_number().over(Window.partitionBy("graph_id", "region").orderBy(*ORDER)) > cap
    pool = seen.withColumn("over", over).withColumn("rank", F.row_number().over(graph.orderBy("over", *ORDER)))
    return pool.where(F.col("rank") <= config.pool).drop("over", "cheb")
