"""Graphs as nodes and edges, packed and unpacked, harmonised, filtered and padded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summarise(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, n_nodes with the centre, n_edges."""
    n = nodes.groupBy("graph_id").agg((F.count("*") + 1).alias("n_nodes"))
    return n.join(edges.groupBy("graph_id").agg(F.count("*").alias("n_edges")), "graph_id", "left").select("graph_id", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def mean_size(summaries: DataFrame) -> DataFrame:
    """One row over graphs' summaries: how many there are and their mean numbers of nodes and edges."""
    return summaries.agg(F.count("*").alias("graphs"), F.avg("n_nodes").alias("mean_nodes"), F.avg("n_edges").alias("mean_edges"))


def admissible(graphs: DataFrame) -> DataFrame:
    """Graphs of more than one node and at least one edge."""
    return graphs.where((F.col("n_nodes") > 1) & (F.col("n_edges") > 0))


def pack(centers: DataFrame, nodes: DataFrame, edges: DataFrame, edge_scale: float = 8.0) -> DataFrame:
    """One row a graph: graph_id, position, nodes (in idx order, the centre first with feature -1), edges (in ordinal order).

    ``centers`` has graph_id, t, h, w and value, the target; it is null where the centre is a gap.
    """
    node = F.struct("idx", "dt", "dh", "dw", F.col("value").alias("feature"), F.col("value").alias("truth"))
    listed = nodes.groupBy("graph_id").agg(F.sort_array(F.collect_list(node)).alias("nodes"))
    attribute = lambda c: (F.col(c) / F.lit(edge_scale)).cast("float").alias(c)
    edge = F.struct("ordinal", "src", "dst", "kind", attribute("et"), attribute("eh"), attribute("ew"))
    linked = edges.groupBy("graph_id").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    zero = F.lit(0)
    own = F.struct(zero.alias("idx"), zero.alias("dt"), zero.alias("dh"), zero.alias("dw"), F.lit(-1.0).cast("float").alias("feature"), F.col("value").alias("truth"))
    full = centers.join(listed, "graph_id").join(linked, "graph_id")
    return full.select("graph_id", F.struct("t", "h", "w").alias("position"), F.concat(F.array(own), F.col("nodes")).alias("nodes"), F.transform("edges", lambda e: e.dropFields("ordinal")).alias("edges"))


def arrays(packed: DataFrame) -> DataFrame:
    """Packed graphs in the tile path's columns: arrays of the neighbours, without the centre, and of the edges' ends."""
    rest = F.slice("nodes", F.lit(2), F.size("nodes"))
    node = lambda field, name: F.transform(rest, lambda n: n[field]).alias(name)
    ends = [F.transform("edges", lambda e: e["src"]).alias("src"), F.transform("edges", lambda e: e["dst"]).alias("dst")]
    return packed.select("graph_id", *[node(c, c) for c in ("idx", "dt", "dh", "dw")], node("feature", "value"), *ends)


def unpack_nodes(packed: DataFrame) -> DataFrame:
    return packed.select("graph_id", F.inline("nodes"))


def unpack_edges(packed: DataFrame) -> DataFrame:
    return packed.select("graph_id", F.posexplode("edges").alias("ordinal", "e")).select("graph_id", (F.col("ordinal") + 1).alias("ordinal"), "e.*")


def targets(packed: DataFrame) -> DataFrame:
    """graph_id, target: the truth of node 0."""
    return packed.select("graph_id", F.element_at("nodes", 1)["truth"].alias("target"))


def harmonise(**kinds: DataFrame) -> DataFrame:
    """Graph tables of several builders in one, with scheme; columns that a builder lacks are null."""
    out = None
    for name, df in kinds.items():
        one = df.withColumn("scheme", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def padded(pool: DataFrame, size: int) -> DataFrame:
    """One row a graph: its candidates in order, filled up with zeros to ``size``, and the mask of real ones."""
    row = F.struct("rank", "dt", "dh", "dw", "value")
    listed = pool.groupBy("graph_id").agg(F.sort_array(F.collect_list(row)).alias("held"))
    zero = F.lit(0)
    blank = F.struct(zero.alias("rank"), zero.alias("dt"), zero.alias("dh"), zero.alias("dw"), zero.cast("float").alias("value"))
    full = F.slice(F.concat("held", F.array_repeat(blank, size)), 1, size)
    return listed.select("graph_id", full.alias("candidates"), F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: i <= F.size("held")).alias("mask"))


def gather(graphs: DataFrame, values: str, picks: str) -> DataFrame:
    """Adds gathered: the elements of one array column at the places (from 0) in another."""
    return graphs.withColumn("gathered", F.transform(picks, lambda i: F.element_at(values, i + 1)))


def tile_report(results: DataFrame) -> DataFrame:
    """One row over build results (tile, centres, graphs): totals and the success rate."""
    return results.agg(F.count("*").alias("tiles"), F.sum("centers").alias("centers"), F.sum("graphs").alias("graphs"), F.try_divide(F.sum("graphs"), F.sum("centers")).alias("success"))
