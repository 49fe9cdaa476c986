"""Filling gaps: simple estimates from neighbours and days around, and writing predictions back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inverse_distance(nodes: DataFrame) -> DataFrame:
    """graph_id, estimate: the selected nodes' mean, weighted by 1 / squared distance."""
    w = 1.0 / F.col("d2")
    return nodes.groupBy("graph_id").agg((F.sum(w * F.col("value").cast("double")) / F.sum(w)).alias("estimate"))


def same_pixel_mean(gaps: DataFrame, voxels: DataFrame, days: int) -> DataFrame:
    """t, h, w, estimate: the mean of the same pixel up to ``days`` before and after; gaps without any are left out."""
    near = gaps.select("t", "h", "w", F.explode(F.sequence(F.col("t") - days, F.col("t") + days)).alias("near"))
    held = voxels.where(F.col("value").isNotNull()).select(F.col("t").alias("near"), "h", "w", "value")
    return near.join(held, ["near", "h", "w"]).groupBy("t", "h", "w").agg(F.avg(F.col("value").cast("double")).alias("estimate"))


def write_back(voxels: DataFrame, predictions: DataFrame) -> DataFrame:
    """The cube with filled: its value, or the prediction (t, h, w, estimate) where it is a gap; was_gap tells."""
    found = voxels.join(predictions.select("t", "h", "w", "estimate"), ["t", "h", "w"], "left")
    gap = F.col("value").isNull()
    return found.withColumn("was_gap", gap).withColumn("filled", F.coalesce(F.col("value").cast("double"), F.col("estimate"))).drop("estimate")
