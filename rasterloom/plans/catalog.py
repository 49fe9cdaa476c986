"""The registered raster queries: each is one operator, or a job of several, over the cube derived from order lines."""

from __future__ import annotations

import weakref
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CandidateConfig, GraphConfig, HeterogeneityConfig, QualityConfig
from ..functions import geometry as G
from ..operators import edges as E
from ..operators import attention, fill, graphs, heterogeneity, learning, positions, quality, raster, structure, tiles
from ..operators import neighborhood as N
from ..sources.derived import MIDDLE, SMALL, cube, raw_voxels
from . import builders as B
from . import tiled

#: The margins and reaches of the registered queries, sized for their small grids.
GRAPH = GraphConfig(ext_range=3, max_ext=3, edge_time=6, edge_height=6, edge_width=6, sample_per_class=50)
WIDE = replace(GRAPH, ext_range=2, max_ext=4)
EDGES = (6, 6, 6)
SCHEME_A, SCHEME_B = QualityConfig(n_base=30), HeterogeneityConfig(radius=3)
SCHEME_C = CandidateConfig(initial_radius=3, max_radius=6)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Query -> its columns and types, "r6" for a double rounded to six digits; the SQL side is cast alike.
OUT: dict[str, dict[str, str]] = {}


def as_type(name: str, kind: str) -> str:
    """The SQL of a result column, in both engines."""
    return f"round(cast({name} as double), {kind[1:]}) as {name}" if kind[0] == "r" and kind[1:].isdigit() else f"cast({name} as {kind}) as {name}"


def query(out: str):
    """Registers a query under its function's name; ``out`` lists its columns as 'name type, ...'."""

    def add(make):
        columns = dict(c.strip().split(" ", 1) for c in out.split(","))

        def run(spark, sf_dir: str) -> DataFrame:
            with N.releasing() as kept:
                found = make(spark, sf_dir).selectExpr(*[as_type(n, k) for n, k in columns.items()])
            weakref.finalize(found, lambda: [table.unpersist() for table in kept]).atexit = False  # once the caller drops the result
            return found

        OUT[make.__name__], QUERIES[make.__name__] = columns, run
        return make

    return add


def gaps(voxels: DataFrame, shape=SMALL) -> DataFrame:
    return B.numbered(positions.missing(voxels, shape, EDGES), shape)


def every_center(voxels: DataFrame, shape=SMALL) -> DataFrame:
    return B.numbered(voxels.where(positions.in_region(shape, EDGES)).select("t", "h", "w"), shape)


def cells_around(voxels: DataFrame, config: GraphConfig = GRAPH) -> DataFrame:
    return N.measured(N.extract(every_center(voxels), voxels, config.reach))


def nodes_of(voxels: DataFrame, config: GraphConfig = GRAPH) -> DataFrame:
    return N.inside_grid(N.select_nodes(cells_around(voxels, config), config), SMALL)


# ---- cleaning and summaries


@query("t int, h int, w int, raw int, quality int, value r9")
def clean_voxels(spark, sf):
    return cube(spark, sf)


@query("t int, h int, w int, value r9")
def clean_voxels_single(spark, sf):
    return raster.clean_single(raw_voxels(spark, sf, SMALL))


@query("t int, h int, w int, quality int, value r9")
def joined_quality(spark, sf):
    """Every cell of the grid with the flags of those that any line falls into; 255 stands for an unknown flag."""
    raw = raw_voxels(spark, sf, SMALL)
    flags = raw.select("t", "h", "w", F.when(F.col("quality") == 1, 255).otherwise(F.col("quality")).alias("quality"))
    return raster.clean(raster.join_quality(raster.densify(raw.select("t", "h", "w", "raw"), SMALL), flags))


@query("cells long, valid long, missing long, valid_ratio r9, least r9, most r9, mean r9, median r9, p999 r9")
def dataset_stats(spark, sf):
    return raster.summary(cube(spark, sf))


@query("class int, n long")
def class_histogram(spark, sf):
    return positions.classify(cube(spark, sf, MIDDLE)).where("value is not null").groupBy("class").agg(F.count("*").alias("n"))


@query("class int, n long")
def class_histogram_left_closed(spark, sf):
    return positions.classify(cube(spark, sf, MIDDLE), bounds="left_closed").where("value is not null").groupBy("class").agg(F.count("*").alias("n"))


@query("t int, day date, h int, w int, raw int, radiance r9")
def calendar_spine(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select("ts", "user_id", "event_id")
    frames = events.select(F.dayofyear("ts").alias("doy"), (F.col("user_id") % 3).cast("int").alias("h"), (F.col("event_id") % 2).cast("int").alias("w"), F.when(F.col("user_id") % 11 == 0, 65535).otherwise((F.col("event_id") % 1000).cast("int")).alias("raw"))
    return raster.stack_year(frames, 2024, (3, 2)).withColumn("day", G.day_of(F.lit(2024), F.col("t") + 1))


# ---- positions


@query("kind string, n long")
def effective_regions(spark, sf):
    v = cube(spark, sf, MIDDLE)
    early = positions.early_edges(MIDDLE, 10, 12)
    parts = [v.where(positions.in_region(MIDDLE, e)).agg(F.lit(k).alias("kind"), F.count("*").alias("n")) for k, e in (("margins", EDGES), ("buffers", early))]
    return parts[0].unionByName(parts[1])


@query("t int, h int, w int")
def missing_positions(spark, sf):
    return positions.missing(cube(spark, sf, MIDDLE), MIDDLE, EDGES)


@query("t int, h int, w int, value r9")
def valid_positions(spark, sf):
    return positions.present(cube(spark, sf), SMALL, EDGES)


@query("day long, n long")
def missing_by_day(spark, sf):
    return positions.missing_by_day(cube(spark, sf, MIDDLE), MIDDLE, EDGES)


@query("class int, sample_id long, t int, h int, w int")
def stratified_sample(spark, sf):
    return positions.training_centers(cube(spark, sf, MIDDLE), MIDDLE, replace(GRAPH, sample_per_class=400))


@query("class int, sample_id long, t int, h int, w int")
def downsample(spark, sf):
    rows = positions.classify(positions.present(cube(spark, sf), SMALL, EDGES), bounds="left_closed").select("class", "t", "h", "w")
    return positions.stratified_sample(rows, 15, seed=3, replace=False)


@query("o_orderkey long, part string")
def train_val_split(spark, sf):
    return positions.split(spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey"), ("o_orderkey",))


@query("t int, h int, w int")
def benchmark_sample(spark, sf):
    return positions.first_draws(positions.missing(cube(spark, sf, MIDDLE), MIDDLE, EDGES), 100, ("t", "h", "w"))


# ---- geometry


def _offsets(spark, sf, radius: int) -> DataFrame:
    """The offsets at which the gaps have valid cells, with the number of such cells."""
    v = cube(spark, sf)
    return N.extract(gaps(v), v, radius).groupBy("dt", "dh", "dw").agg(F.count("*").alias("n"))


@query("dt int, dh int, dw int, d2 int, cheb int, quadrant int, region int, n long")
def offset_dim(spark, sf):
    d = [F.col(c) for c in ("dt", "dh", "dw")]
    return _offsets(spark, sf, 6).select(*d, G.squared(*d).alias("d2"), G.chebyshev(*d).alias("cheb"), G.quadrant(*d).alias("quadrant"), G.region(*d).alias("region"), "n")


@query("quadrant int, region int, offsets long, n long, far int")
def direction_partition(spark, sf):
    d = [F.col(c) for c in ("dt", "dh", "dw")]
    found = _offsets(spark, sf, 6).select("n", G.squared(*d).alias("d2"), G.quadrant(*d).alias("quadrant"), G.region(*d).alias("region"))
    return found.groupBy("quadrant", "region").agg(F.count("*").alias("offsets"), F.sum("n").alias("n"), F.max("d2").alias("far"))


@query("graph_id long, idx int, step int, pt int, ph int, pw int")
def line_paths(spark, sf):
    """The cells on the line from each of the gaps' neighbours to the gap."""
    d = [F.col(c) for c in ("dt", "dh", "dw")]
    v = cube(spark, sf)
    found = N.inside_grid(N.select_nodes(N.measured(N.extract(gaps(v), v, GRAPH.reach)), GRAPH), SMALL)
    at = found.select("graph_id", "idx", F.explode(G.line_to_center(*d)).alias("p"))
    return at.select("graph_id", "idx", "p.step", F.col("p.dt").alias("pt"), F.col("p.dh").alias("ph"), F.col("p.dw").alias("pw"))


@query("name string, doy int, day date, days int, padded string, n long")
def frame_names(spark, sf):
    """The frames' file names of the days that have events, and what the names say."""
    days = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.date_format("ts", "yyyyDDD").alias("day")).agg(F.count("*").alias("n"))
    names = days.select(F.concat("day", F.lit("_50KM.tif")).alias("name"), "n")
    year, doy = F.regexp_extract("name", r"^(\d{4})(\d{3})_50KM\.tif$", 1).cast("int"), F.regexp_extract("name", r"^(\d{4})(\d{3})_50KM\.tif$", 2).cast("int")
    return names.select("name", doy.alias("doy"), G.day_of(year, doy).alias("day"), G.days_in(year).alias("days"), F.lpad(doy.cast("string"), 3, "0").alias("padded"), "n")


@query("key string, n long")
def quantised_keys(spark, sf):
    return cube(spark, sf).groupBy(G.quantised_key(F.col("t"), F.col("h"), F.col("w"), 5).alias("key")).agg(F.count("*").alias("n"))


# ---- tiles


@query("tile_h int, tile_w int, n long, first_h int, last_w int")
def tile_assign(spark, sf):
    tiled = tiles.assign(positions.missing(cube(spark, sf, MIDDLE), MIDDLE, EDGES), 10)
    return tiled.groupBy("tile_h", "tile_w").agg(F.count("*").alias("n"), F.min("h").alias("first_h"), F.max("w").alias("last_w"))


@query("tile_h int, tile_w int, cells long, core long, low_h int, high_h int, low_w int, high_w int")
def tile_halo(spark, sf):
    haloed = tiles.with_halo(cube(spark, sf), 6, 4, SMALL)
    return haloed.groupBy("tile_h", "tile_w").agg(F.count("*").alias("cells"), F.count_if("is_core").alias("core"), F.min("h").alias("low_h"), F.max("h").alias("high_h"), F.min("w").alias("low_w"), F.max("w").alias("high_w"))


@query("tiles long, centers long, graphs long, success r9")
def tile_build_report(spark, sf):
    v = cube(spark, sf)
    centers = tiles.assign(every_center(v), 2)
    made = nodes_of(v, WIDE).select("graph_id").distinct().withColumn("ok", F.lit(1))
    by = centers.join(made, "graph_id", "left").groupBy("tile_h", "tile_w").agg(F.count("*").alias("centers"), F.count("ok").alias("graphs"))
    return graphs.tile_report(by)


# ---- neighbourhoods and graphs


@query("graph_id long, dt int, dh int, dw int, value r9")
def cube_extract(spark, sf):
    v = cube(spark, sf)
    return N.extract(gaps(v), v, 3, with_center=True)


@query("graph_id long, cells long, near long")
def clamped_crop(spark, sf):
    v = cube(spark, sf)
    every = B.numbered(v.where("value is null").select("t", "h", "w"), SMALL)
    return N.extract(every, v, 5).groupBy("graph_id").agg(F.count("*").alias("cells"), F.count_if(F.abs("dh") <= 1).alias("near"))


@query("graph_id long, quadrant int, valid long, quota int, enough boolean")
def quadrant_counts(spark, sf):
    return N.quadrant_counts(cells_around(cube(spark, sf)), 32)


@query("graph_id long, radius int")
def adaptive_radius(spark, sf):
    return N.adaptive_radius(cells_around(cube(spark, sf), WIDE), WIDE)


@query("graph_id long, idx int, dt int, dh int, dw int, d2 int, quadrant int, radius int, value r9")
def select_nodes(spark, sf):
    return nodes_of(cube(spark, sf), WIDE)


@query("graph_id long, src int, dst int, et int, eh int, ew int")
def edges_occlusion(spark, sf):
    return E.occlusion(nodes_of(cube(spark, sf)))


@query("graph_id long, src int, dst int, et int, eh int, ew int")
def edges_aux(spark, sf):
    return E.auxiliary(nodes_of(cube(spark, sf)))


@query("graph_id long, ordinal int, src int, dst int, kind string, et r9, eh r9, ew r9")
def edges_all(spark, sf):
    v = cube(spark, sf)
    made = B.build(gaps(v), v, SMALL, GRAPH)
    return E.scaled(made.edges, GRAPH.edge_scale)


@query("graph_id long, n_nodes long, n_edges long")
def graph_summary(spark, sf):
    v = cube(spark, sf)
    return graphs.admissible(B.build(every_center(v), v, SMALL, WIDE).summary())


@query("graphs long, mean_nodes r6, mean_edges r6")
def mean_graph_size(spark, sf):
    v = cube(spark, sf)
    return graphs.mean_size(B.build(every_center(v), v, SMALL, WIDE).summary())


@query("graph_id long, ordinal int, value r9")
def gathered_values(spark, sf):
    """The value at each edge's source, in the edges' order."""
    v = cube(spark, sf)
    flat = graphs.arrays(B.build(gaps(v), v, SMALL, GRAPH).packed())
    flat = flat.withColumn("held", F.concat(F.array(F.lit(-1.0).cast("float")), F.col("value")))
    return graphs.gather(flat, "held", "src").select("graph_id", F.posexplode("gathered").alias("ordinal", "value"))


def _crowded(spark, sf):
    """The gaps of the cube and of its first corner eight times over, so that one place holds most centres."""
    v = cube(spark, sf, MIDDLE)
    some = B.numbered(positions.missing(v, MIDDLE, EDGES), MIDDLE)
    corner = some.where("h < 10 and w < 10 and t < 12").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(7))))
    return some.unionByName(corner.withColumn("graph_id", F.col("graph_id") + 1_000_000 * F.col("copy")).drop("copy")), v


@query("t0 int, h0 int, w0 int, side int, n long")
def adaptive_tiles(spark, sf):
    """The leaves of a tree over centres that crowd in one corner: 25 centres at most, but in the finest boxes."""
    return tiles.leaves(_crowded(spark, sf)[0], 25, 16, 2)


@query("t0 int, h0 int, w0 int, side int, share int, centers long, cells long, mean r6")
def adaptive_tile_halo(spark, sf):
    """Each leaf's share of centres, the valid cells within its halo and their mean: no share holds over 25 centres."""
    centers, v = _crowded(spark, sf)
    found = tiles.leaves(centers, 25, 16, 2)
    counts = tiles.in_leaves(centers, found, 25, 16, 2).groupBy(*tiles.LEAF).agg(F.count("*").alias("centers"))
    halo = tiles.around_leaves(v.where("value is not null"), found, 3, 25)
    return counts.join(halo.groupBy(*tiles.LEAF).agg(F.count("*").alias("cells"), F.avg(F.col("value").cast("double")).alias("mean")), list(tiles.LEAF))


@query("graph_id long, ordinal int, src int, dst int, kind string")
def tiled_edges(spark, sf):
    """The edges of every centre's graph, cut out of dense tiles."""
    v = cube(spark, sf)
    return tiled.edges(tiled.build(every_center(v), v, SMALL, WIDE, most=20, top=8, finest=2))


@query("day int, file string, graphs long, edges long")
def prediction_graphs_by_day(spark, sf):
    made = B.for_prediction(cube(spark, sf), SMALL, GRAPH)
    full = made.summary().join(made.centers.select("graph_id", "day"), "graph_id")
    by = full.groupBy("day").agg(F.count("*").alias("graphs"), F.sum("n_edges").alias("edges"))
    return by.withColumn("file", F.concat(F.lit("graph_forPred_"), F.lpad(F.col("day").cast("string"), 3, "0")))


@query("class int, graphs long, edges long, target r6")
def training_graphs_by_class(spark, sf):
    made = B.for_training(cube(spark, sf), SMALL, replace(GRAPH, sample_per_class=12))
    full = made.summary().join(made.centers.select("graph_id", "class", "value"), "graph_id")
    return full.groupBy("class").agg(F.count("*").alias("graphs"), F.sum("n_edges").alias("edges"), F.avg(F.col("value").cast("double")).alias("target"))


@query("graph_id long, idx int, feature r9, truth r9")
def packed_nodes(spark, sf):
    v = cube(spark, sf)
    return graphs.unpack_nodes(B.build(every_center(v), v, SMALL, GRAPH).packed())


@query("graph_id long, target r9")
def graph_targets(spark, sf):
    v = cube(spark, sf)
    return graphs.targets(B.build(every_center(v), v, SMALL, GRAPH).packed())


@query("scheme string, graph_id long, n_nodes long, het r6")
def harmonised_graphs(spark, sf):
    v = cube(spark, sf)
    made, w = B.weighted(gaps(v), v, SMALL, GRAPH, SCHEME_B)
    n = made.summary().select("graph_id", "n_nodes")
    return graphs.harmonise(plain=n, weighted=n.join(w.select("graph_id", "het"), "graph_id"))


# ---- scheme A


@query("h int, w int, total long")
def integral_image(spark, sf):
    return quality.integral(quality.pixels(cube(spark, sf)), F.col("n"))


@query("h int, w int, rho r6")
def density(spark, sf):
    return quality.density(quality.pixels(cube(spark, sf)), SCHEME_A)


@query("h int, w int, s r6")
def continuity(spark, sf):
    return quality.continuity(quality.pixels(cube(spark, sf)), SCHEME_A)


@query("h int, w int, tstab r6")
def stability(spark, sf):
    return quality.stability(quality.pixels(cube(spark, sf)))


@query("h int, w int, q r6")
def quality_map(spark, sf):
    return quality.quality_map(cube(spark, sf), SCHEME_A)


@query("graph_id long, n int")
def adaptive_node_count(spark, sf):
    v = cube(spark, sf)
    return quality.with_node_count(every_center(v), quality.quality_map(v, SCHEME_A), SCHEME_A)


@query("n int, graphs long, share r9")
def node_count_histogram(spark, sf):
    v = cube(spark, sf)
    return quality.node_histogram(quality.with_node_count(every_center(v), quality.quality_map(v, SCHEME_A), SCHEME_A))


@query("graph_id long, idx int, dt int, dh int, dw int")
def select_nodes_adaptive(spark, sf):
    v = cube(spark, sf)
    counted = quality.with_node_count(gaps(v), quality.quality_map(v, SCHEME_A), SCHEME_A)
    return N.select_nodes(N.measured(N.extract(counted, v, GRAPH.reach)), GRAPH)


# ---- scheme B


@query("graph_id long, pixels long, het r6")
def heterogeneity_index(spark, sf):
    v = cube(spark, sf)
    return heterogeneity.index(every_center(v), v, SCHEME_B)


@query("graph_id long, w_spatial r6, w_temporal r6")
def st_weights(spark, sf):
    v = cube(spark, sf)
    return heterogeneity.weights(heterogeneity.index(every_center(v), v, SCHEME_B), SCHEME_B)


@query("high long, low long, undefined long, graphs long")
def het_tallies(spark, sf):
    v = cube(spark, sf)
    return heterogeneity.tallies(heterogeneity.weights(heterogeneity.index(every_center(v), v, SCHEME_B), SCHEME_B), SCHEME_B)


REPORT = ", ".join(f"{c}_{k} r6" for c in ("het", "w") for k in ("mean", "std", "min", "max", "median"))


@query(f"graphs long, defined long, {REPORT}")
def het_report(spark, sf):
    v = cube(spark, sf)
    return heterogeneity.report(heterogeneity.weights(heterogeneity.index(every_center(v), v, SCHEME_B), SCHEME_B))


def _scheme_b(spark, sf, spatial: float):
    """Nodes and cells of the gaps with a given spatial weight, so that both kinds of dynamic edges are exercised."""
    v = cube(spark, sf)
    made = B.build(gaps(v), v, SMALL, GRAPH)
    w = made.nodes.select("graph_id").distinct().select("graph_id", F.lit(spatial).alias("w_spatial"), F.lit(1 - spatial).alias("w_temporal"))
    return made, w


@query("graph_id long, src int, dst int, et r6, eh r6, ew r6")
def dyn_edges_main(spark, sf):
    made, w = _scheme_b(spark, sf, 0.75)
    return E.dynamic_main(made.nodes, made.cells, w, SCHEME_B)


@query("graph_id long, src int, dst int, et r6, eh r6, ew r6")
def dyn_edges_temporal(spark, sf):
    made, w = _scheme_b(spark, sf, 0.25)
    return E.dynamic_temporal(made.nodes, w, SCHEME_B)


@query("graph_id long, src int, dst int, et r6, eh r6, ew r6")
def dyn_edges_neighbor(spark, sf):
    made, w = _scheme_b(spark, sf, 0.75)
    return E.dynamic_neighbor(made.nodes, w, E.dynamic_main(made.nodes, made.cells, w, SCHEME_B), SCHEME_B)


@query("graph_id long, ordinal int, src int, dst int, kind string, et r6, eh r6, ew r6")
def dynamic_edges(spark, sf):
    made, w = _scheme_b(spark, sf, 0.75)
    return E.dynamic_edges(made.nodes, made.cells, w, SCHEME_B)


@query("kind string, graphs long, edges long, mean r6, most long")
def dynamic_edge_report(spark, sf):
    made, w = _scheme_b(spark, sf, 0.75)
    return heterogeneity.edge_report(E.dynamic_edges(made.nodes, made.cells, w, SCHEME_B))


# ---- scheme C


@query("graph_id long, region int, valid long")
def region_counts(spark, sf):
    v = cube(spark, sf)
    cells = N.extract(gaps(v), v, 4).withColumn("region", G.region(F.col("dt"), F.col("dh"), F.col("dw")))
    return cells.groupBy("graph_id", "region").agg(F.count("*").alias("valid"))


@query("graph_id long, rank int, dt int, dh int, dw int, region int, radius int")
def candidate_pool(spark, sf):
    v = cube(spark, sf)
    return N.candidates(gaps(v), v, SCHEME_C)


@query("graph_id long, src int, dst int, kind string, et r9, eh r9, ew r9")
def knn_edges(spark, sf):
    v = cube(spark, sf)
    return B.from_candidates(gaps(v), v, SCHEME_C)[2]


@query("graph_id long, place int, held boolean, dt int, dh int, dw int, value r9")
def padded_candidates(spark, sf):
    v = cube(spark, sf)
    found = graphs.padded(N.candidates(gaps(v), v, SCHEME_C), SCHEME_C.pool)
    each = found.select("graph_id", F.posexplode(F.arrays_zip("candidates", "mask")).alias("place", "c"))
    return each.select("graph_id", "place", F.col("c.mask").alias("held"), "c.candidates.dt", "c.candidates.dh", "c.candidates.dw", "c.candidates.value")


# ---- learning


def _vectors(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    return rows.select(F.floor(F.col("vec_id") / 32).cast("long").alias("graph_id"), (F.col("vec_id") % 32).cast("int").alias("idx"), F.col("embedding").alias("vector"))


@query("graph_id long, i int, j int, place int, similarity r6")
def cosine_knn(spark, sf):
    return learning.cosine_neighbours(_vectors(spark, sf), 4)


def _scores(spark, sf):
    """A score and a value of each vector, of all its components: their sum, and that of their squares."""
    total = lambda power: F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") ** power)
    return _vectors(spark, sf).select("graph_id", "idx", F.round(total(1), 9).alias("score"), total(2).alias("x"))


@query("graph_id long, idx int, weight r6")
def softmax_scores(spark, sf):
    return learning.softmax(_scores(spark, sf), 0.5)


@query("graph_id long, idx int, place int")
def top_scores(spark, sf):
    return learning.top_scores(_scores(spark, sf), 5)


@query("graph_id long, entropy r6")
def selection_entropy(spark, sf):
    return learning.selection_entropy(learning.softmax(_scores(spark, sf)))


def _adjacency(spark, sf):
    near = learning.cosine_neighbours(_vectors(spark, sf), 4)
    return near.select("graph_id", "i", "j", F.greatest(F.lit(0.0), F.col("similarity")).alias("weight"))


@query("graph_id long, i int, j int, weight r6")
def row_normalize(spark, sf):
    return learning.row_normalised(_adjacency(spark, sf))


@query("graph_id long, sparsity r6, smoothness r6")
def graph_regularisers(spark, sf):
    return learning.regularisers(_adjacency(spark, sf), _scores(spark, sf))


@query("graph_id long, mean r6, most r6, total r6, attended r6")
def readout_pooling(spark, sf):
    return learning.pooled(learning.softmax(_scores(spark, sf)))


@query("part string, n long, mse r4, mae r6, r2 r6")
def regression_metrics(spark, sf):
    orders = positions.split(spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_totalprice"), ("o_orderkey",))
    rows = orders.withColumn("target", F.col("o_totalprice") / 1000).withColumn("predicted", F.col("target") + (F.col("o_orderkey") % 7 - 3))
    return learning.regression_metrics(rows, ("part",))


def _history(spark, sf):
    by = spark.read.parquet(f"{sf}/orders.parquet").groupBy((F.col("o_orderkey") % 40).cast("int").alias("epoch"))
    return by.agg((F.count("*") % 9 + 1).cast("double").alias("val_loss"))


@query("epoch int, val_loss r6")
def best_epoch(spark, sf):
    return learning.best_epoch(_history(spark, sf))


@query("epoch int, val_loss r6, stale int, stopped boolean")
def early_stop(spark, sf):
    return learning.early_stop(_history(spark, sf), 5)


# ---- models, over fixed parameters


def weights(n_in: int, n_out: int, seed: int) -> tuple[list[list[float]], list[float]]:
    """Fixed weights and shifts between -0.5 and 0.5, by a rule that SQL can repeat."""
    return [[((5 * i + 3 * j + seed) % 11 - 5) / 10 for j in range(n_out)] for i in range(n_in)], [((7 * j + seed) % 5 - 2) / 10 for j in range(n_out)]


def layer(n_in: int, seed: int) -> dict:
    found = {"left": weights(n_in, 4, seed), "right": weights(n_in, 4, seed + 1), "edge": weights(3, 4, seed + 2), "attention": [[0.5, -0.3], [0.2, 0.4]]}
    return found | {"scale": [1.0, 0.9, 1.1, 1.2], "shift": [0.0, 0.1, -0.1, 0.05]}


LAYERS = [layer(4, 1), layer(4, 4)]
HEAD = {"out1": weights(4, 2, 3), "out2": weights(2, 1, 5)}
SELECTOR = {"pos1": weights(3, 2, 2), "pos2": weights(2, 4, 3), "gate": weights(8, 4, 4), "score": weights(4, 1, 6)}


def _model_input(spark, sf):
    """Nodes and edges of the gaps' graphs as the models read them: value, -1 at the centre, and offsets over the edge scale."""
    v = cube(spark, sf)
    made = B.build(gaps(v), v, SMALL, GRAPH)
    full = E.with_center(made.nodes).join(made.nodes.select("graph_id", "idx", "value"), ["graph_id", "idx"], "left")
    scaled = [F.col(c).cast("double") / GRAPH.edge_scale for c in ("dt", "dh", "dw")]
    nodes = full.select("graph_id", "idx", F.array(F.coalesce(F.col("value").cast("double"), F.lit(-1.0)), *scaled).alias("x"))
    moved = F.array(*[F.col(c).cast("double") / GRAPH.edge_scale for c in ("et", "eh", "ew")])
    edges = made.edges.select("graph_id", "src", "dst", (-moved[0]).alias("a"), (-moved[1]).alias("b"), (-moved[2]).alias("c"))
    edges = edges.select("graph_id", "src", "dst", F.array("a", "b", "c").alias("moved"))
    own = nodes.where("idx = 0").select("graph_id", F.lit(0).alias("src"), F.lit(0).alias("dst"), F.array(*[F.lit(0.0)] * 3).alias("moved"))
    return nodes, edges.unionByName(own)


@query("graph_id long, idx int, place int, value r5")
def attention_layer(spark, sf):
    nodes, edges = _model_input(spark, sf)
    return attention.attention_layer(nodes, edges, LAYERS[0], 2).select("graph_id", "idx", F.posexplode("x").alias("place", "value"))


@query("graph_id long, estimate r5")
def attention_estimates(spark, sf):
    nodes, edges = _model_input(spark, sf)
    for params in LAYERS:
        nodes = attention.attention_layer(nodes, edges, params, 2)
    return attention.estimates(nodes, HEAD)


@query("graph_id long, idx int, score r6")
def gated_scores(spark, sf):
    v = cube(spark, sf)
    pool = N.candidates(gaps(v), v, SCHEME_C)
    parts = [F.col(c).cast("double") for c in ("dt", "dh", "dw", "value")]
    return attention.gated_scores(pool.select("graph_id", (F.col("rank") - 1).alias("idx"), F.array(*parts).alias("x")), SELECTOR)


#: The learned structure's fixed parameters: choice, edges, two layers of which the last has no normalisation, readout.
PLAIN = (lambda found: (found[0], [0.0] * 4))(weights(4, 4, 8))
SOURCES = {"source": [[0.5, -0.3], [0.2, 0.4]], "target": [[-0.2, 0.6], [0.3, 0.1]], "bias": [0.1, -0.1]}
STRUCTURE = {
    "select": SELECTOR,
    "edges": {"project1": weights(1, 4, 1), "project2": weights(4, 4, 2), "near": weights(3, 2, 3), "join1": weights(10, 4, 4), "join2": weights(4, 1, 5)},
    "project1": weights(1, 4, 6), "project2": weights(4, 4, 7), "pool1": weights(4, 2, 9), "pool2": weights(2, 1, 10), "out1": weights(4, 2, 11), "out2": weights(2, 1, 12),
    "layers": [{"transform": PLAIN, "scale": [1.0, 0.9, 1.1, 1.2], "shift": [0.0, 0.1, -0.1, 0.05]} | SOURCES, {"transform": PLAIN} | SOURCES],
}
TOP_K, KNN = 12, 4


def _pool_nodes(spark, sf):
    """The gaps' candidate pools as the structure model reads them: offsets over the edge scale, and value."""
    v = cube(spark, sf)
    offsets = [F.col(c).cast("double") / SCHEME_C.edge_scale for c in ("dt", "dh", "dw")]
    return N.candidates(gaps(v), v, SCHEME_C).select("graph_id", (F.col("rank") - 1).alias("idx"), F.array(*offsets, F.col("value").cast("double")).alias("x"))


@query("graph_id long, src int, dst int, weight r6")
def soft_edges(spark, sf):
    """Learned edges among the best-scored candidates of every gap."""
    kept = structure.chosen(attention.gated_scores(_pool_nodes(spark, sf), SELECTOR), TOP_K)
    return structure.soft_edges(kept, STRUCTURE["edges"], KNN)


@query("graph_id long, estimate r5")
def structure_estimates(spark, sf):
    """The whole forward pass: choice of nodes, soft edges, layers, readout, estimate."""
    return structure.forward(_pool_nodes(spark, sf), STRUCTURE, TOP_K, KNN, 2)[0]


@query("graph_id long, entropy r6, sparsity r6, smoothness r6, loss r6")
def structure_losses(spark, sf):
    """The forward pass's regularisers and their sum."""
    return structure.forward(_pool_nodes(spark, sf), STRUCTURE, TOP_K, KNN, 2)[1]


@query("graph_id long, how string, place int, value r6")
def readout_vectors(spark, sf):
    """Each way of readout over the first layer's nodes of the gaps' graphs."""
    nodes, edges = _model_input(spark, sf)
    found = structure.readouts(attention.attention_layer(nodes, edges, LAYERS[0], 2), STRUCTURE)
    each = F.array(*[F.struct(F.lit(how).alias("how"), F.col(how).alias("value")) for how in ("attention", "mean", "max", "sum")])
    return found.select("graph_id", "place", F.inline(each))


@query("vec_id long, place int, leaky r6, elu r6, gelu r6")
def activations(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("place", "v"))
    x = F.col("v").cast("double") * 4
    return rows.select("vec_id", "place", attention.leaky(x).alias("leaky"), attention.elu(x).alias("elu"), attention.gelu(x).alias("gelu"))


# ---- filling


@query("t int, h int, w int, was_gap boolean, filled r6")
def idw_fill(spark, sf):
    v = cube(spark, sf)
    made = B.for_prediction(v, SMALL, GRAPH)
    found = fill.inverse_distance(made.nodes).join(made.centers, "graph_id")
    return fill.write_back(v, found)


@query("t int, h int, w int, estimate r6")
def same_pixel_fill(spark, sf):
    v = cube(spark, sf, MIDDLE)
    return fill.same_pixel_mean(positions.missing(v, MIDDLE, EDGES), v, 3)


@query("day int, gaps long, neighbours long, mean r6")
def gap_neighbours_by_day(spark, sf):
    """The flagship: for each day, its gaps that make a graph, their neighbours and those neighbours' mean value."""
    made = B.for_prediction(cube(spark, sf), SMALL, GRAPH)
    return made.nodes.groupBy("day").agg(F.countDistinct("graph_id").alias("gaps"), F.count("*").alias("neighbours"), F.avg(F.col("value").cast("double")).alias("mean"))
