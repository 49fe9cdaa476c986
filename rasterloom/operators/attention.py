"""Attention over graphs in relational form: a layer is two joins of edges to nodes, a softmax over each target, and sums.

Weights are lists of numbers that become literals, so every dense transform is one column expression. Nodes are rows
(graph_id, idx, x: array of doubles); edges (graph_id, src, dst, moved: array of three doubles), dst listens to src.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def leaky(x: Column, slope: float = 0.2) -> Column:
    return F.when(x > 0, x).otherwise(slope * x)


def elu(x: Column) -> Column:
    return F.when(x > 0, x).otherwise(F.expm1(x))


def gelu(x: Column) -> Column:
    return 0.5 * x * (1 + F.tanh(0.7978845608028654 * (x + 0.044715 * x * x * x)))


def affine(x: Column, weights: list[list[float]], shift: list[float]) -> list[Column]:
    """x @ weights + shift, a column for each output; weights as (input, output)."""
    return [sum((x[i] * F.lit(float(row[j])) for i, row in enumerate(weights)), F.lit(float(b))) for j, b in enumerate(shift)]


def attention_layer(nodes: DataFrame, edges: DataFrame, params: dict, heads: int) -> DataFrame:
    """Nodes with x replaced by what they hear: rows (graph_id, idx, x); idx runs from 0 without gaps.

    A source's score for a target is, for each head, the head's vector times leaky(left of target + right of source +
    edge); shares are its softmax over the target's sources; the sources' right sides are summed by share. With a
    residual, a normalisation and an elu. Nodes without an edge to them hear nothing. params: left, right, edge
    and, if widths differ, skip as (weights, shift), attention as a list a head, scale and shift of the normalisation.
    Nodes and edges of a graph meet in one row and are dealt out once; each table is read once, so layers can follow one another.
    """
    width = len(params["left"][1])
    head = lambda j: j // (width // heads)
    x = F.col("x")
    skip = F.array(*affine(x, *params["skip"])) if "skip" in params else x
    sides = nodes.select("graph_id", "idx", F.struct(F.array(*affine(x, *params["left"])).alias("left"), F.array(*affine(x, *params["right"])).alias("right"), skip.alias("skip")).alias("x"))
    met = meeting(sides, edges)
    moved = F.when(F.col("moved").isNotNull(), F.array(*affine(F.col("moved"), *params["edge"])))
    met = met.withColumn("edge", moved)
    raised = [leaky(F.col("a.left")[j] + F.col("b.right")[j] + F.col("edge")[j]) * F.lit(float(params["attention"][head(j)][j % (width // heads)])) for j in range(width)]
    scores = [sum((r for j, r in enumerate(raised) if head(j) == h), F.lit(0.0)).alias(f"s{h}") for h in range(heads)]
    scored = met.select("graph_id", "dst", F.col("a.skip").alias("skip"), F.col("b.right").alias("right"), *scores)
    target = Window.partitionBy("graph_id", "dst")
    shared = scored.withColumns({f"e{h}": F.exp(F.col(f"s{h}") - F.max(f"s{h}").over(target)) for h in range(heads)})
    sums = [(F.sum(F.col(f"e{head(j)}") * F.col("right")[j]) / F.sum(f"e{head(j)}")).alias(f"m{j}") for j in range(width)]
    heard = shared.groupBy("graph_id", F.col("dst").alias("idx")).agg(F.first("skip").alias("skip"), *sums)
    summed = heard.select("graph_id", "idx", *[(F.coalesce(f"m{j}", F.lit(0.0)) + F.col("skip")[j]).alias(f"o{j}") for j in range(width)])
    out = [F.col(f"o{j}") for j in range(width)]
    mean = sum(out, F.lit(0.0)) / width
    parts = summed.withColumn("mean", mean)
    spread = F.sqrt(sum(((o - F.col("mean")) * (o - F.col("mean")) for o in out), F.lit(0.0)) / width + 1e-5)
    parts = parts.withColumn("spread", spread)
    normal = [elu((o - F.col("mean")) / F.col("spread") * F.lit(float(a)) + F.lit(float(b))) for o, a, b in zip(out, params["scale"], params["shift"], strict=True)]
    return parts.select("graph_id", "idx", F.array(*normal).alias("x"))


def meeting(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (graph_id, dst, moved, a, b): for each edge its target's and its source's x; a node that nothing leads to comes once without b."""
    listed = nodes.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("idx", "x"))).alias("all"))
    linked = edges.groupBy("graph_id").agg(F.collect_list(F.struct("src", "dst", "moved")).alias("edges"))
    both = listed.join(linked, "graph_id", "left").withColumn("edges", F.coalesce("edges", F.array()))
    bare = F.array_except(F.transform("all", lambda n: n["idx"]), F.transform("edges", lambda e: e["dst"]))
    ends = F.concat(F.col("edges"), F.transform(bare, lambda i: F.struct(F.lit(None).cast("int").alias("src"), i.alias("dst"), F.lit(None).cast("array<double>").alias("moved"))))
    one = both.select("graph_id", "all", F.explode(ends).alias("e"))
    at = lambda side: F.get("all", F.col(f"e.{side}"))["x"]
    return one.select("graph_id", "e.dst", "e.moved", at("dst").alias("a"), at("src").alias("b"))


def estimates(nodes: DataFrame, params: dict) -> DataFrame:
    """graph_id, estimate: each graph's node 0 through two dense transforms with a gelu between; params: out1, out2."""
    hidden = F.array(*[gelu(c) for c in affine(F.col("x"), *params["out1"])])
    return nodes.where("idx = 0").select("graph_id", affine(hidden, *params["out2"])[0].alias("estimate"))


def gated_scores(nodes: DataFrame, params: dict) -> DataFrame:
    """graph_id, idx, x, score of candidates (graph_id, idx, x: three offsets and a value).

    A code of the offsets, scaled by the graph's largest, is gated by itself and the features, then weighed; params:
    pos1, pos2, gate, score.
    """
    x = F.col("x")
    far = F.greatest(F.max(F.greatest(F.abs(x[0]), F.abs(x[1]), F.abs(x[2]))).over(Window.partitionBy("graph_id")), F.lit(1.0))
    coded = nodes.withColumn("near", F.transform(F.slice("x", 1, 3), lambda v: v / far))
    coded = coded.withColumn("inner", F.array(*[gelu(c) for c in affine(F.col("near"), *params["pos1"])]))
    coded = coded.withColumn("code", F.array(*affine(F.col("inner"), *params["pos2"])))
    gates = [1 / (1 + F.exp(-c)) for c in affine(F.concat("code", "x"), *params["gate"])]
    coded = coded.withColumn("gated", F.array(*[g * F.col("code")[j] for j, g in enumerate(gates)]))
    return coded.select("graph_id", "idx", "x", affine(F.col("gated"), *params["score"])[0].alias("score"))
