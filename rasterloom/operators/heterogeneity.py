"""Scheme B: how uneven a centre's surroundings are, and the weights of space against time that follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import HeterogeneityConfig
from ..functions.geometry import sigmoid
from .neighborhood import extract


def index(centers: DataFrame, voxels: DataFrame, config: HeterogeneityConfig = HeterogeneityConfig()) -> DataFrame:  # noqa: B008
    """graph_id, pixels, het: deviation over mean of the pixels' means in the cube around each centre.

    -1 where fewer than min_pixels pixels are valid or their mean is under min_mean. Centres without any valid cell
    around come back with -1 too.
    """
    cells = extract(centers, voxels, config.radius, with_center=True)
    means = cells.groupBy("graph_id", "dh", "dw").agg(F.avg(F.col("value").cast("double")).alias("m"))
    by = means.groupBy("graph_id").agg(F.count("*").alias("pixels"), F.avg("m").alias("mean"), F.stddev_pop("m").alias("deviation"))
    enough = (F.col("pixels") >= config.min_pixels) & (F.col("mean") >= config.min_mean)
    het = F.when(enough, F.col("deviation") / F.col("mean")).otherwise(F.lit(-1.0))
    return centers.join(by, "graph_id", "left").select(*centers.columns, F.coalesce("pixels", F.lit(0)).alias("pixels"), het.alias("het"))


def weights(indexed: DataFrame, config: HeterogeneityConfig = HeterogeneityConfig()) -> DataFrame:  # noqa: B008
    """Adds w_spatial and w_temporal, which sum to 1: a sigmoid of the index about its threshold; halves where it is -1."""
    space = F.when(F.col("het") < 0, F.lit(0.5)).otherwise(sigmoid((F.col("het") - config.threshold) * config.steepness))
    return indexed.withColumn("w_spatial", space).withColumn("w_temporal", 1 - F.col("w_spatial"))


def tallies(weighted: DataFrame, config: HeterogeneityConfig = HeterogeneityConfig()) -> DataFrame:  # noqa: B008
    """One row: graphs of high, low and undefined heterogeneity."""
    h = F.col("het")
    return weighted.agg(F.count_if(h > config.threshold).alias("high"), F.count_if((h >= 0) & (h <= config.threshold)).alias("low"), F.count_if(h < 0).alias("undefined"), F.count("*").alias("graphs"))


def report(weighted: DataFrame) -> DataFrame:
    """One row of statistics of the index, over graphs where it is defined, and of the spatial weight; -1 without any."""
    h = F.when(F.col("het") >= 0, F.col("het"))
    kinds = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max, "median": F.median}
    stats = [F.coalesce(f(h), F.lit(-1.0)).alias(f"het_{n}") for n, f in kinds.items()]
    stats += [F.coalesce(f("w_spatial"), F.lit(0.0)).alias(f"w_{n}") for n, f in kinds.items()]
    return weighted.agg(F.count("*").alias("graphs"), F.count(h).alias("defined"), *stats)


def edge_report(edges: DataFrame) -> DataFrame:
    """kind, graphs that have such edges, edges, their mean and most a graph."""
    by = edges.groupBy("graph_id", "kind").agg(F.count("*").alias("n")).groupBy("kind")
    return by.agg(F.count("*").alias("graphs"), F.sum("n").alias("edges"), F.avg("n").alias("mean"), F.max("n").alias("most"))
