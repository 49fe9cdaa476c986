"""Sums that training and evaluation need, in relational form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def softmax(scores: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Adds weight: the softmax of score within each graph_id."""
    graph = Window.partitionBy("graph_id")
    raised = scores.withColumn("_e", F.exp((F.col("score") - F.max("score").over(graph)) / temperature))
    return raised.withColumn("weight", F.col("_e") / F.sum("_e").over(graph)).drop("_e")


def top_scores(scores: DataFrame, k: int) -> DataFrame:
    """The k best of each graph, ties by idx, with place."""
    place = F.row_number().over(Window.partitionBy("graph_id").orderBy(F.col("score").desc(), "idx"))
    return scores.withColumn("place", place).where(F.col("place") <= k)


def selection_entropy(weighted: DataFrame) -> DataFrame:
    """graph_id, entropy of the weights over the log of their number; null for a single one."""
    w = F.col("weight")
    return weighted.groupBy("graph_id").agg((-F.sum(w * F.log(w + 1e-10)) / F.nullif(F.log(F.count("*").cast("double")), F.lit(0.0))).alias("entropy"))


def row_normalised(adjacency: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Edges (graph_id, i, j, weight) over the threshold, each row of the matrix scaled to sum 1."""
    kept = adjacency.where(F.col("weight") > threshold)
    return kept.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy("graph_id", "i")))


def regularisers(adjacency: DataFrame, nodes: DataFrame) -> DataFrame:
    """graph_id, sparsity (sum of absolute weights), smoothness (sum of weight times squared difference of x)."""
    a = nodes.select("graph_id", F.col("idx").alias("i"), F.col("x").alias("xi"))
    b = nodes.select("graph_id", F.col("idx").alias("j"), F.col("x").alias("xj"))
    both = adjacency.join(a, ["graph_id", "i"]).join(b, ["graph_id", "j"])
    return both.groupBy("graph_id").agg(F.sum(F.abs("weight")).alias("sparsity"), F.sum(F.col("weight") * (F.col("xi") - F.col("xj")) ** 2).alias("smoothness"))


def pooled(nodes: DataFrame) -> DataFrame:
    """graph_id with the mean, max, sum and weight-averaged x of its nodes."""
    return nodes.groupBy("graph_id").agg(
        F.avg("x").alias("mean"), F.max("x").alias("most"), F.sum("x").alias("total"), F.try_divide(F.sum(F.col("weight") * F.col("x")), F.sum("weight")).alias("attended")
    )


def regression_metrics(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """n, mse, mae, r2 of predicted against target; r2 is 1 - SSE / SST, 0 where all targets are equal."""
    error = F.col("target") - F.col("predicted")
    sse, sst = F.sum(error * error), F.var_pop("target") * F.count("target")
    fit = F.when(sst > 0, 1 - sse / sst).otherwise(F.lit(0.0))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"), fit.alias("r2"))


def best_epoch(history: DataFrame) -> DataFrame:
    """One row: the epoch of the least val_loss, the first on ties."""
    return history.agg(F.min(F.struct("val_loss", "epoch")).alias("b")).select(F.col("b.epoch").alias("epoch"), F.col("b.val_loss").alias("val_loss"))


def early_stop(history: DataFrame, patience: int) -> DataFrame:
    """epoch, val_loss, stale (epochs since the last improvement), stopped of a training history (one row an epoch)."""
    so_far = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    best = F.min("val_loss").over(so_far)
    better = history.withColumn("improved", best.isNull() | (F.col("val_loss") < best))
    last = F.max(F.when(F.col("improved"), F.col("epoch"))).over(Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0))
    return better.withColumn("stale", F.col("epoch") - last).withColumn("stopped", F.col("stale") >= patience).select("epoch", "val_loss", "stale", "stopped")


def cosine(a: str, b: str):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def cosine_neighbours(nodes: DataFrame, k: int) -> DataFrame:
    """graph_id, i, j, place, similarity: each node's k + 1 most similar nodes of its graph, itself included.

    Nodes are (graph_id, idx, vector); graphs are small, as the builders make them.
    """
    a = nodes.select("graph_id", F.col("idx").alias("i"), F.col("vector").alias("vi"))
    b = nodes.select("graph_id", F.col("idx").alias("j"), F.col("vector").alias("vj"))
    pairs = a.join(b, "graph_id").withColumn("similarity", F.round(cosine("vi", "vj"), 9))
    place = F.row_number().over(Window.partitionBy("graph_id", "i").orderBy(F.col("similarity").desc(), "j"))
    return pairs.withColumn("place", place).where(F.col("place") <= k + 1).select("graph_id", "i", "j", "place", "similarity")
