"""spark-submit entry: build training or prediction graphs, convert frames, train and fill.

    python -m rasterloom.cli predict --input cube.npy --quality flags.npy --output graphs
"""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import CandidateConfig, CleanConfig, GraphConfig, HeterogeneityConfig, QualityConfig
from .model import fit
from .model.features import Sizes, features, initial
from .operators import fill, graphs, learning, positions
from .operators import neighborhood as N
from .operators.raster import clean
from .plans import builders, tiled
from .sources import frames, npy, sinks


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="rasterloom", description="Graphs around the gaps of a daily raster cube, and their filling.")
    modes = top.add_subparsers(dest="mode", required=True)
    for name, what in (("train", "graphs of sampled centres by brightness class"), ("predict", "graphs of every gap by day"), ("fit", "train the model on sampled centres"), ("fill", "write predictions back into the cube")):
        one = modes.add_parser(name, help=what)
        one.add_argument("--input", required=True, help="a cube: .npy, or a folder of Parquet with t, h, w, raw")
        one.add_argument("--quality", help="quality flags of the same form")
        one.add_argument("--output", required=True)
        for flag, value in (("search-node", 32), ("ext-range", 6), ("max-ext", 20), ("sample-per-class", 20_000), ("edge-time", 50), ("edge-height", 50), ("edge-width", 50), ("seed", 0)):
            one.add_argument(f"--{flag}", type=int, default=value)
        one.add_argument("--edge-scale", type=float, default=8.0)
        one.add_argument("--path", choices=("relational", "tiled"), default="tiled", help="how plain graphs are built")
        for flag, value, what in (("tile-graphs", 4096, "most graphs of a tile"), ("tile-size", 64, "widest side of a tile, a power of two")):
            one.add_argument(f"--{flag}", type=int, default=value, help=what)
        one.add_argument("--scheme", choices=("plain", "a", "b", "c"), default="plain", help="a: node counts by quality, b: weights by heterogeneity, c: candidate pools")
        for flag, value in (("initial-radius", 4), ("max-radius", 20)):
            one.add_argument(f"--{flag}", type=int, default=value, help="of scheme c's pools")
        if name in ("fit", "fill"):
            one.add_argument("--model", required=True, help="folder of the parameter table")
            for flag, value in (("hidden-dim", 16), ("num-heads", 2), ("num-layers", 2), ("epochs", 20), ("patience", 5), ("batches", 1)):
                one.add_argument(f"--{flag}", type=int, default=value)
            one.add_argument("--lr", type=float, default=5e-3)
            one.add_argument("--split", type=float, default=0.8)
        if name == "fit":
            one.add_argument("--build-only", action="store_true", help="stop once the graphs are stored")
            one.add_argument("--rebuild", action="store_true", help="build graphs even where an earlier run has stored them")
    base = modes.add_parser("baseline", help="fit and compare stored training graphs of several schemes, split alike by position")
    base.add_argument("--graphs", nargs="+", required=True, help="name=folder of each store that train wrote")
    base.add_argument("--output", required=True)
    for flag, value in (("hidden-dim", 16), ("num-heads", 2), ("num-layers", 2), ("epochs", 20), ("patience", 5), ("batches", 1), ("seed", 0)):
        base.add_argument(f"--{flag}", type=int, default=value)
    for flag, value in (("lr", 5e-3), ("split", 0.8), ("edge-scale", 8.0)):
        base.add_argument(f"--{flag}", type=float, default=value)
    convert = modes.add_parser("convert", help="a year's folder of frames to a cube")
    convert.add_argument("--input", required=True)
    convert.add_argument("--output", required=True)
    convert.add_argument("--pattern", default="*.tif")
    for flag, value in (("year", 2020), ("height", 0), ("width", 0)):
        convert.add_argument(f"--{flag}", type=int, default=value)
    convert.add_argument("--scale", type=float, default=0.1)
    return top


def load(spark: SparkSession, args) -> tuple[DataFrame, tuple[int, int, int]]:
    """The cleaned cube and its shape."""
    if args.input.endswith(".npy"):
        raw = npy.read(spark, args.input, args.quality)
    else:
        raw = spark.read.parquet(args.input)
        if args.quality:
            raw = raw.join(spark.read.parquet(args.quality), ["t", "h", "w"], "left")
    voxels = clean(raw, CleanConfig())
    ends = voxels.agg(F.max("t"), F.max("h"), F.max("w")).first()
    return voxels, tuple(int(e) + 1 for e in ends)


def graph_config(args) -> GraphConfig:
    names = ("search_node", "ext_range", "max_ext", "sample_per_class", "edge_scale", "edge_time", "edge_height", "edge_width", "seed")
    return replace(GraphConfig(), **{n: getattr(args, n) for n in names})


def in_tiles(centers: DataFrame, voxels: DataFrame, shape, config: GraphConfig, args) -> DataFrame:
    return tiled.build(centers, voxels, shape, config, args.tile_graphs, args.tile_size)


def graphs_of(centers: DataFrame, voxels: DataFrame, shape, config: GraphConfig, args) -> DataFrame:
    """graph_id and, by scheme: the tile path's arrays or packed structs, packed structs (b: with het and weights), or padded candidates."""
    if args.scheme == "a":
        return builders.adaptive_nodes(centers, voxels, shape, config, QualityConfig()).packed(config.edge_scale)
    if args.scheme == "b":
        made, weights = builders.weighted(centers, voxels, shape, config, HeterogeneityConfig())
        return made.packed(config.edge_scale).join(weights.select("graph_id", "het", "w_spatial", "w_temporal"), "graph_id")
    if args.scheme == "c":
        pools = CandidateConfig(initial_radius=args.initial_radius, max_radius=args.max_radius)
        return graphs.padded(N.candidates(centers, voxels, pools), pools.pool)
    return in_tiles(centers, voxels, shape, config, args) if args.path == "tiled" else builders.build(centers, voxels, shape, config).packed(config.edge_scale)


def model_rows(centers: DataFrame, voxels: DataFrame, shape, config: GraphConfig, args) -> DataFrame:
    """Graphs in the form that the scheme's model reads."""
    if args.scheme == "plain":
        return in_tiles(centers, voxels, shape, config, args)
    made = graphs_of(centers, voxels, shape, config, args)
    return made if args.scheme == "c" else graphs.arrays(made)


def sizes_of(args) -> Sizes:
    return Sizes(hidden=args.hidden_dim, heads=args.num_heads, layers=args.num_layers, edge_scale=args.edge_scale)


def fitted(spark: SparkSession, made: DataFrame, kind: str, args, output: str, tag: str, rebuild: bool) -> tuple[dict, DataFrame]:
    """The head's parameters and history, from graphs with target and part; vectors and epochs of an earlier run are reused."""
    sizes, path = sizes_of(args), f"{output}/vectors_{tag}"
    if rebuild or not sinks.is_stored(spark, path):
        vectors = features(made, initial(sizes, kind, args.seed), sizes, kind)
        fit.store(vectors.join(made.select("graph_id", "target", "part"), "graph_id"), path, args.batches)
    checkpoints = f"{output}/epochs_{tag}"
    if rebuild:
        sinks.remove(spark, checkpoints)
    return fit.train(spark, path, checkpoints, args.hidden_dim, args.epochs, args.lr, args.patience, args.batches, args.seed)


#: What a store of training graphs is told by, and how it becomes the arrays (or pools) that features are made of.
FORMS = {
    "candidates": ("candidate", lambda rows: rows.select("graph_id", "candidates", "mask")),
    "nodes": ("fixed", graphs.arrays),
    "idx": ("fixed", lambda rows: rows.select("graph_id", "idx", "dt", "dh", "dw", "value", "src", "dst")),
}


def baseline(spark: SparkSession, args) -> None:
    """Fits a head for each store, with positions split alike over all of them, and writes histories and metrics by scheme and part."""
    stores = {name: spark.read.parquet(path) for name, path in (s.split("=", 1) for s in args.graphs)}
    place = [F.col(f"center.{c}").alias(c) for c in ("t", "h", "w")]
    every = None
    for rows in stores.values():
        some = rows.select(*place)
        every = some if every is None else every.union(some)
    parts = sinks.built_once(spark, f"{args.output}/parts", lambda: positions.split(every.distinct(), ("t", "h", "w"), args.split))
    scored = histories = None
    for name, rows in stores.items():
        kind, normal = next(FORMS[c] for c in FORMS if c in rows.columns)
        labels = rows.select("graph_id", "target", *place).join(parts, ["t", "h", "w"]).select("graph_id", "target", "part")
        made = normal(rows).join(labels, "graph_id")
        best, history = fitted(spark, made, kind, args, args.output, name, False)
        one = fit.predicted(spark.read.parquet(f"{args.output}/vectors_{name}"), best).select(F.lit(name).alias("scheme"), "part", "target", F.col("estimate").alias("predicted"))
        scored = one if scored is None else scored.unionByName(one)
        histories = history.withColumn("scheme", F.lit(name)) if histories is None else histories.unionByName(history.withColumn("scheme", F.lit(name)))
    learning.regression_metrics(scored, ("scheme", "part")).write.mode("overwrite").parquet(f"{args.output}/metrics")
    histories.write.mode("overwrite").parquet(f"{args.output}/history")


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("rasterloom").getOrCreate()
    with N.releasing() as kept:
        run(spark, args)
    for table in kept:
        table.unpersist()


def run(spark: SparkSession, args) -> None:
    """One mode of the command line, to its last written table."""
    if args.mode == "convert":
        sinks.write_cube(frames.year_cube(spark, args.input, args.year, (args.height, args.width), args.pattern, scale=args.scale), args.output)
        return
    if args.mode == "baseline":
        baseline(spark, args)
        return
    voxels, shape = load(spark, args)
    config = graph_config(args)
    edges = (config.edge_time, config.edge_height, config.edge_width)
    if args.mode in ("train", "fit"):
        how = {"replace": False, "bounds": "left_closed"} if args.scheme == "c" else {}
        centers = positions.training_centers(voxels, shape, config, **how).withColumn("graph_id", F.col("class").cast("long") * 1_000_000_000 + F.col("sample_id"))
        labelled = centers.join(voxels.select("t", "h", "w", F.col("value").cast("double").alias("target")), ["t", "h", "w"]).select("graph_id", "class", "target")
        if args.mode == "train":
            middle = centers.select("graph_id", F.struct("t", "h", "w").alias("center"))
            made = graphs_of(centers, voxels, shape, config, args).join(labelled, "graph_id").join(middle, "graph_id")
            sinks.write_training(made, args.output, config.search_node, config.sample_per_class)
            return
        build = lambda: positions.split(model_rows(centers, voxels, shape, config, args).join(labelled, "graph_id"), ("graph_id",), args.split)
        made = sinks.built_once(spark, f"{args.output}/graphs_{args.scheme}", build, args.rebuild)
        if args.build_only:
            return
        kind = "candidate" if args.scheme == "c" else "fixed"
        best, history = fitted(spark, made, kind, args, args.output, args.scheme, args.rebuild)
        fit.to_table(spark, best).write.mode("overwrite").parquet(args.model)
        history.write.mode("overwrite").parquet(f"{args.output}/history")
        return
    gaps = builders.numbered(positions.missing(voxels, shape, edges), shape)
    if args.mode == "predict":
        days = gaps.select("graph_id", (F.col("t") - edges[0]).alias("day"))
        sinks.write_prediction(graphs_of(gaps, voxels, shape, config, args).join(days, "graph_id"), args.output, config.search_node)
        return
    kind, sizes = "candidate" if args.scheme == "c" else "fixed", sizes_of(args)
    found = model_rows(gaps, voxels, shape, config, args).persist()
    vectors = features(found, initial(sizes, kind, args.seed), sizes, kind)
    scored = fit.predicted(vectors, fit.from_table(spark.read.parquet(args.model))).select("graph_id", "estimate").join(gaps, "graph_id")
    sinks.write_cube(fill.write_back(voxels, scored), args.output)
    found.unpersist()


if __name__ == "__main__":
    main()
