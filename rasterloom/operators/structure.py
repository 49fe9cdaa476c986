"""Learned graph structure in relational form: choice of nodes, soft edges, layers over them, readout and regularisers.

Nodes are rows (graph_id, idx, x) with idx from 0 without gaps. Everything is keyed by graph_id: dealt out once, a graph's
nodes are gathered in one row wherever two of them meet, so pairs, windows and sums need no exchange of their own. Graphs
have as many nodes as the model keeps; their number does not matter. Weights are literals of column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import attention, learning
from .attention import affine, gelu, leaky

#: Edges up to this weight are none; those up to the threshold do not carry attention; parts of the loss.
LEAST, THRESHOLD, SPARSITY, SMOOTHNESS = 1e-6, 0.05, 0.01, 0.005


def array_of(columns: list[Column]) -> Column:
    return F.array(*columns)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def dealt(nodes: DataFrame) -> DataFrame:
    """The nodes by graph, for all that follows."""
    return nodes.repartition("graph_id")


def chosen(scores: DataFrame, k: int) -> DataFrame:
    """Each graph's ``k`` best nodes (graph_id, idx, x, score), renumbered from 0 in that order; ties by idx."""
    best = learning.top_scores(scores.withColumn("score", F.round("score", 9)), k)
    return best.select("graph_id", (F.col("place") - 1).alias("idx"), "x")


def gathered(nodes: DataFrame) -> DataFrame:
    """One row a graph: all, its nodes in order."""
    return nodes.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("idx", "x"))).alias("all"))


def all_pairs(nodes: DataFrame) -> DataFrame:
    """Rows (graph_id, src, dst, a, b) of every two nodes of a graph, both ways, and each with itself."""
    one = gathered(nodes).withColumn("s", F.explode("all")).withColumn("t", F.explode("all"))
    return one.select("graph_id", F.col("s.idx").alias("src"), F.col("t.idx").alias("dst"), F.col("s.x").alias("a"), F.col("t.x").alias("b"))


def soft_edges(nodes: DataFrame, params: dict, knn: int) -> DataFrame:
    """Rows (graph_id, src, dst, weight), both ways: attention times raised cosine of the value's code, for each node's nearest.

    Nodes' x is dt, dh, dw, value. A node keeps itself and its ``knn`` most alike, ties to the lesser idx; every node has
    a loop of weight one more; the two ways of a pair are averaged under its lesser and greater end. params: project1,
    project2, near, join1, join2 as (weights, shift).
    """
    inner = array_of([gelu(c) for c in affine(F.array(F.col("x")[3]), *params["project1"])])
    coded = nodes.withColumn("inner", inner).withColumn("code", array_of(affine(F.col("inner"), *params["project2"])))
    length = F.greatest(F.sqrt(dot(F.col("code"), F.col("code"))), F.lit(1e-12))
    coded = coded.withColumn("length", length).select("graph_id", "idx", F.struct(F.slice("x", 1, 3).alias("at"), "code", "length").alias("x"))
    pairs = all_pairs(coded)
    alike = dot(F.col("a.code"), F.col("b.code")) / (F.col("a.length") * F.col("b.length"))
    pairs = pairs.withColumn("alike", alike).withColumn("moved", F.zip_with("a.at", "b.at", lambda p, q: p - q))
    place = F.row_number().over(Window.partitionBy("graph_id", "src").orderBy(F.round("alike", 9).desc(), "dst"))
    kept = pairs.withColumn("place", place).where((F.col("place") <= knn + 1) | (F.col("src") == F.col("dst")))
    kept = kept.withColumn("near", array_of([gelu(c) for c in affine(F.col("moved"), *params["near"])]))
    kept = kept.withColumn("hidden", array_of([gelu(c) for c in affine(F.concat("a.code", "b.code", "near"), *params["join1"])]))
    strength = 1 / (1 + F.exp(-affine(F.col("hidden"), *params["join2"])[0]))
    one_way = F.when(F.col("place") <= knn + 1, strength * (0.5 + 0.5 * F.col("alike"))).otherwise(F.lit(0.0))
    loop = F.when(F.col("src") == F.col("dst"), 1.0).otherwise(0.0)
    weighed = kept.select("graph_id", "src", "dst", (one_way + loop).alias("weight"))
    ends = weighed.groupBy("graph_id", F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high"))
    halves = ends.agg((F.sum("weight") / F.when(F.first("src") == F.first("dst"), 1).otherwise(2)).alias("weight")).where(F.col("weight") > LEAST)
    ways = F.when(F.col("low") == F.col("high"), F.array(F.struct(F.col("low").alias("src"), F.col("high").alias("dst")))).otherwise(
        F.array(F.struct(F.col("low").alias("src"), F.col("high").alias("dst")), F.struct(F.col("high").alias("src"), F.col("low").alias("dst")))
    )
    return halves.withColumn("way", F.explode(ways)).select("graph_id", "way.src", "way.dst", "weight")


def layer(nodes: DataFrame, edges: DataFrame, params: dict, heads: int) -> DataFrame:
    """A layer of attention over the edges: rows (graph_id, idx, x).

    A node's score for a neighbour is leaky(own part + neighbour's part + bias) for each head; its softmax over the
    neighbours weighs their vectors. With a residual and, where params hold scale and shift, a normalisation. params:
    transform as (weights, no shift), source and target as a list a head, bias a head.
    """
    width = len(params["transform"][1])
    share = width // heads
    sides = nodes.withColumn("h", array_of(affine(F.col("x"), *params["transform"])))
    part = lambda side, head: sum((F.col("h")[head * share + j] * F.lit(float(v)) for j, v in enumerate(params[side][head])), F.lit(0.0))
    own, far = array_of([part("source", h) for h in range(heads)]), array_of([part("target", h) for h in range(heads)])
    sides = sides.select("graph_id", "idx", F.struct("x", "h", own.alias("own"), far.alias("far")).alias("x"))
    met = edges.join(gathered(sides), "graph_id").select("graph_id", "src", F.element_at("all", F.col("src") + 1)["x"].alias("a"), F.element_at("all", F.col("dst") + 1)["x"].alias("b"))
    scored = met.select("graph_id", "src", F.col("a.x").alias("x"), F.col("b.h").alias("h"), *[leaky(F.col("a.own")[h] + F.col("b.far")[h] + F.lit(float(params["bias"][h]))).alias(f"s{h}") for h in range(heads)])
    node = Window.partitionBy("graph_id", "src")
    raised = scored.withColumns({f"e{h}": F.exp(F.col(f"s{h}") - F.max(f"s{h}").over(node)) for h in range(heads)})
    sums = [(F.sum(F.col(f"e{j // share}") * F.col("h")[j]) / F.sum(f"e{j // share}")).alias(f"m{j}") for j in range(width)]
    heard = raised.groupBy("graph_id", F.col("src").alias("idx")).agg(F.first("x").alias("x"), *sums)
    full = heard.select("graph_id", "idx", *[(F.col(f"m{j}") + F.col("x")[j]).alias(f"o{j}") for j in range(width)])
    out = [F.col(f"o{j}") for j in range(width)]
    if "scale" in params:
        mean = sum(out, F.lit(0.0)) / width
        spread = F.sqrt(sum(((o - mean) * (o - mean) for o in out), F.lit(0.0)) / width + 1e-5)
        out = [(o - mean) / spread * F.lit(float(a)) + F.lit(float(b)) for o, a, b in zip(out, params["scale"], params["shift"], strict=True)]
    return full.select("graph_id", "idx", array_of(out).alias("x"))


def readouts(nodes: DataFrame, params: dict) -> DataFrame:
    """Rows (graph_id, place, attention, mean, max, sum): each graph's nodes in one vector, in four ways. params: pool1, pool2."""
    hidden = array_of([F.tanh(c) for c in affine(F.col("x"), *params["pool1"])])
    scored = nodes.withColumn("hidden", hidden).withColumn("score", affine(F.col("hidden"), *params["pool2"])[0])
    spread = learning.softmax(scored).select("graph_id", "weight", F.posexplode("x").alias("place", "v"))
    v = F.col("v")
    ways = (F.sum(F.col("weight") * v).alias("attention"), F.avg(v).alias("mean"), F.max(v).alias("max"), F.sum(v).alias("sum"))
    return spread.groupBy("graph_id", "place").agg(*ways)


def pooled(nodes: DataFrame, params: dict, how: str = "attention") -> DataFrame:
    """Rows (graph_id, x): each graph's nodes in one vector, by attention, mean, max or sum."""
    held = readouts(nodes, params).groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("place", how))).alias("held"))
    return held.select("graph_id", F.transform("held", lambda p: p[how]).alias("x"))


def estimates(vectors: DataFrame, params: dict) -> DataFrame:
    """graph_id, estimate: two dense transforms with a rectifier between; params: out1, out2."""
    hidden = array_of([F.greatest(c, F.lit(0.0)) for c in affine(F.col("x"), *params["out1"])])
    return vectors.withColumn("hidden", hidden).select("graph_id", affine(F.col("hidden"), *params["out2"])[0].alias("estimate"))


def losses(scores: DataFrame, nodes: DataFrame, edges: DataFrame, temperature: float = 1.0) -> DataFrame:
    """graph_id, entropy, sparsity, smoothness and their weighed sum: of the choice's softmax, the edges and the kept values."""
    entropy = learning.selection_entropy(learning.softmax(scores, temperature))
    met = edges.join(gathered(nodes), "graph_id")
    step = F.element_at("all", F.col("src") + 1)["x"][3] - F.element_at("all", F.col("dst") + 1)["x"][3]
    sums = met.groupBy("graph_id").agg(F.sum(F.abs("weight")).alias("sparsity"), F.sum(F.col("weight") * step * step).alias("smoothness"))
    both = entropy.join(sums, "graph_id")
    return both.withColumn("loss", F.coalesce("entropy", F.lit(0.0)) + SPARSITY * F.col("sparsity") + SMOOTHNESS * F.col("smoothness"))


def parts(pool: DataFrame, params: dict, top_k: int, knn: int, heads: int, readout: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(scores, kept nodes, edges, vectors) of candidate pools."""
    scores = attention.gated_scores(dealt(pool), params["select"])
    kept = chosen(scores, top_k)
    edges = soft_edges(kept, params["edges"], knn)
    inner = array_of([gelu(c) for c in affine(F.array(F.col("x")[3]), *params["project1"])])
    x = kept.withColumn("inner", inner).select("graph_id", "idx", array_of(affine(F.col("inner"), *params["project2"])).alias("x"))
    links = edges.where(F.col("weight") > THRESHOLD)
    for one in params["layers"]:
        x = layer(x, links, one, heads)
    return scores, kept, edges, pooled(x, params, readout)


def embedded(pool: DataFrame, params: dict, top_k: int, knn: int, heads: int, readout: str = "attention") -> DataFrame:
    """Rows (graph_id, x): each pool in one vector."""
    return parts(pool, params, top_k, knn, heads, readout)[3]


def forward(pool: DataFrame, params: dict, top_k: int, knn: int, heads: int, readout: str = "attention") -> tuple[DataFrame, DataFrame]:
    """(estimates, losses) of candidate pools (graph_id, idx, x: dt, dh, dw, value): choice, edges, layers, readout.

    Attention runs over edges above the threshold. params: select, edges, project1, project2, layers, and the readout's.
    """
    scores, kept, edges, vectors = parts(pool, params, top_k, knn, heads, readout)
    return estimates(vectors, params), losses(scores, kept, edges)
