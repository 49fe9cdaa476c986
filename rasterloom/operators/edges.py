"""Edges of neighbourhood graphs. All joins are on graph_id and share the exchange that built the nodes.

Nodes are rows (graph_id, idx, dt, dh, dw, d2, ...) with idx 0 at the centre.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CandidateConfig, HeterogeneityConfig
from ..functions.geometry import line_to_center


def with_center(nodes: DataFrame) -> DataFrame:
    """Adds node 0 of every graph."""
    zero = F.lit(0)
    center = nodes.select("graph_id").distinct().select("graph_id", zero.alias("idx"), zero.alias("dt"), zero.alias("dh"), zero.alias("dw"), zero.alias("d2"))
    return nodes.select("graph_id", "idx", "dt", "dh", "dw", "d2").unionByName(center)


def _side(nodes: DataFrame, side: str) -> DataFrame:
    return nodes.select("graph_id", *[F.col(c).alias(f"{side}_{c}") for c in ("idx", "dt", "dh", "dw", "d2")])


def _ends(pairs: DataFrame, kind: str) -> DataFrame:
    """src, dst, kind and the offset difference et, eh, ew from rows with src_* and dst_* columns."""
    return pairs.select(
        "graph_id", F.col("src_idx").alias("src"), F.col("dst_idx").alias("dst"), F.lit(kind).alias("kind"),
        *[(F.col(f"src_{c}") - F.col(f"dst_{c}")).alias(f"e{c[1]}") for c in ("dt", "dh", "dw")],
    )


def _paths(nodes: DataFrame) -> DataFrame:
    """Each node's cells on the way to the centre: src_*, step, pt, ph, pw."""
    src = _side(nodes.where("idx > 0"), "src")
    line = F.explode(line_to_center(F.col("src_dt"), F.col("src_dh"), F.col("src_dw")))
    return src.withColumn("p", line).select(*src.columns, F.col("p.step").alias("step"), F.col("p.dt").alias("pt"), F.col("p.dh").alias("ph"), F.col("p.dw").alias("pw"))


def linked(nodes: DataFrame) -> DataFrame:
    """All edges, unnumbered: each graph's nodes meet one another inside one row, without a join.

    A graph has few nodes, so they are gathered in an array. Each neighbour looks its line to the centre up among
    them for its A edge; then source and target are exploded, and each pair is A, B, C (a loop) or nothing.
    """
    d = ("dt", "dh", "dw")
    code = lambda n: (n["dt"] * 4096 + n["dh"]) * 4096 + n["dw"]
    gathered = nodes.groupBy("graph_id").agg(F.collect_list(F.struct("idx", *d, "d2")).alias("nodes"))
    places = F.map_from_entries(F.transform("nodes", lambda n: F.struct(code(n), n["idx"])))
    center = F.struct(*[F.lit(0).alias(c) for c in ("idx", *d, "d2")])
    sources = gathered.withColumn("places", places).select("graph_id", "places", F.concat(F.array(center), "nodes").alias("all"), F.explode("nodes").alias("s"))
    line = line_to_center(*[F.col(f"s.{c}") for c in d])
    met = F.filter(F.transform(line, lambda p: F.try_element_at("places", code(p))), lambda i: i < F.col("s.idx"))
    pairs = sources.select("graph_id", "s", F.coalesce(F.get(met, F.lit(0)), F.lit(0)).alias("hit"), F.explode("all").alias("t"))
    same = {c: F.col(f"s.{c}") == F.col(f"t.{c}") for c in d}
    shares = F.when(same["dt"], ~(same["dh"] & same["dw"])).otherwise(same["dh"] | same["dw"])
    earlier = (F.col("t.idx") < F.col("s.idx")) & (F.col("s.d2") > F.col("t.d2"))
    kind = F.when(F.col("t.idx") == F.col("hit"), "A").when(F.col("t.idx") == F.col("s.idx"), "C").when(earlier & shares, "B")
    found = pairs.withColumn("kind", kind).where(F.col("kind").isNotNull())
    moved = [(F.col(f"s.{c}") - F.col(f"t.{c}")).alias(f"e{c[1]}") for c in d]
    return found.select("graph_id", F.col("s.idx").alias("src"), F.col("t.idx").alias("dst"), "kind", *moved)


def occlusion(nodes: DataFrame) -> DataFrame:
    """One edge a neighbour: to the first node of smaller index on its line to the centre, else to the centre."""
    return linked(nodes).where("kind = 'A'")


def auxiliary(nodes: DataFrame) -> DataFrame:
    """Edges to earlier nodes strictly nearer the centre at the same time and elsewhere, or at another time on the same
    row or column; none that is an A edge already."""
    return linked(nodes).where("kind = 'B'")


def loops(nodes: DataFrame) -> DataFrame:
    """A loop on every neighbour; the centre has none."""
    return linked(nodes).where("kind = 'C'")


def all_edges(nodes: DataFrame) -> DataFrame:
    """The three kinds with their ordinal: by source, then A, B at one time, other B, C, each by target."""
    turn = F.when(F.col("kind") == "A", 0).when(F.col("kind") == "C", 3).when(F.col("et") == 0, 1).otherwise(2)
    return linked(nodes).withColumn("ordinal", F.row_number().over(Window.partitionBy("graph_id").orderBy("src", turn, "dst")))


def scaled(edges: DataFrame, scale: float) -> DataFrame:
    return edges.withColumns({c: (F.col(c) / F.lit(scale)).cast("float") for c in ("et", "eh", "ew")})


def dynamic_main(nodes: DataFrame, cells: DataFrame, weights: DataFrame, config: HeterogeneityConfig) -> DataFrame:
    """Scheme B: from a node along the line from the centre; the first cells must all be valid until a node is met.

    The line runs from the centre outwards and breaks at its first invalid cell; with weights of graph_id, w_spatial
    and w_temporal. ``cells`` are the valid cells around the centres. Without a hit the edge goes to the centre.
    """
    out = F.size(line_to_center(F.col("src_dt"), F.col("src_dh"), F.col("src_dw")))
    path = _paths(nodes).withColumn("n", out).withColumn("turn", F.col("n") + 1 - F.col("step"))
    path = path.where(F.col("turn") <= F.floor(F.col("n") * F.lit(config.spatial_boost)))
    held = cells.select("graph_id", F.col("dt").alias("pt"), F.col("dh").alias("ph"), F.col("dw").alias("pw"), F.lit(1).alias("held"))
    seen = path.join(held, ["graph_id", "pt", "ph", "pw"], "left")
    ahead = Window.partitionBy("graph_id", "src_idx").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    open_ = seen.withColumn("open", F.min(F.coalesce("held", F.lit(0))).over(ahead)).where("open = 1")
    dst = _side(nodes.where("idx > 0"), "dst")
    on_line = (F.col("pt") == F.col("dst_dt")) & (F.col("ph") == F.col("dst_dh")) & (F.col("pw") == F.col("dst_dw"))
    met = open_.join(dst, "graph_id").where(on_line & (F.col("dst_idx") != F.col("src_idx")))
    first = met.groupBy("graph_id", "src_idx").agg(F.min_by(F.struct("dst_idx", "dst_dt", "dst_dh", "dst_dw"), "turn").alias("hit"))
    found = _side(nodes.where("idx > 0"), "src").join(first, ["graph_id", "src_idx"], "left")
    hit = [F.coalesce(F.col(f"hit.dst_{c}"), F.lit(0)).alias(f"dst_{c}") for c in ("idx", "dt", "dh", "dw")]
    ends = _ends(found.select("graph_id", *[f"src_{c}" for c in ("idx", "dt", "dh", "dw")], *hit), "main").join(weights, "graph_id")
    space, time = F.col("w_spatial"), F.col("w_temporal")
    return ends.select("graph_id", "src", "dst", "kind", ((space + time) * F.col("et")).alias("et"), (space * F.col("eh")).alias("eh"), (space * F.col("ew")).alias("ew"))


def dynamic_temporal(nodes: DataFrame, weights: DataFrame, config: HeterogeneityConfig) -> DataFrame:
    """Where time outweighs space: edges to the same pixel up to ``temporal_extend`` days before and after."""
    full = with_center(nodes)
    pairs = _side(full.where("idx > 0"), "src").join(_side(full, "dst"), "graph_id").join(weights.where("w_temporal > 0.5"), "graph_id")
    days = F.col("dst_dt") - F.col("src_dt")
    near = (F.col("src_dh") == F.col("dst_dh")) & (F.col("src_dw") == F.col("dst_dw")) & F.abs(days).between(1, config.temporal_extend)
    zero = F.lit(0.0)
    return pairs.where(near).select(
        "graph_id", F.col("src_idx").alias("src"), F.col("dst_idx").alias("dst"), F.lit("time").alias("kind"), (F.col("w_temporal") * days).alias("et"), zero.alias("eh"), zero.alias("ew")
    )


def dynamic_neighbor(nodes: DataFrame, weights: DataFrame, known: DataFrame, config: HeterogeneityConfig) -> DataFrame:
    """Where space outweighs time: edges to the six adjacent cells' nodes, but those that ``known`` has."""
    full = with_center(nodes)
    pairs = _side(full.where("idx > 0"), "src").join(_side(full, "dst"), "graph_id").join(weights.where((F.col("w_spatial") > 0.5) & F.lit(config.spatial_boost > 1)), "graph_id")
    step = sum((F.abs(F.col(f"dst_{c}") - F.col(f"src_{c}")) for c in ("dt", "dh", "dw")), F.lit(0))
    found = pairs.where(step == 1).join(known.select("graph_id", F.col("src").alias("src_idx"), F.col("dst").alias("dst_idx")), ["graph_id", "src_idx", "dst_idx"], "left_anti")
    moved = [(F.col("w_spatial") * (F.col(f"dst_{c}") - F.col(f"src_{c}"))).alias(f"e{c[1]}") for c in ("dt", "dh", "dw")]
    return found.select("graph_id", F.col("src_idx").alias("src"), F.col("dst_idx").alias("dst"), F.lit("near").alias("kind"), *moved)


def dynamic_edges(nodes: DataFrame, cells: DataFrame, weights: DataFrame, config: HeterogeneityConfig) -> DataFrame:
    """All three kinds; at most four edges a node of the graph, in order of source, kind and step."""
    main, time = dynamic_main(nodes, cells, weights, config), dynamic_temporal(nodes, weights, config)
    first = main.unionByName(time)
    every = first.unionByName(dynamic_neighbor(nodes, weights, first, config))
    turn = F.when(F.col("kind") == "main", 0).when(F.col("kind") == "time", 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("graph_id").orderBy("src", turn, F.abs(F.col("et")), F.col("et").desc(), "dst"))
    size = nodes.groupBy("graph_id").agg((4 * (F.count("*") + 1)).alias("most"))
    return every.withColumn("ordinal", place).join(size, "graph_id").where(F.col("ordinal") <= F.col("most")).drop("most")


def nearest(nodes: DataFrame, config: CandidateConfig) -> DataFrame:
    """Scheme C's first edges: from node 0 to all, from others to their nearest by offset, and a loop on every node.

    Nodes are rows (graph_id, idx, dt, dh, dw) with idx from 0. Ties of distance go to the smaller index.
    """
    flat = nodes.withColumn("d2", F.lit(0))
    pairs = _side(flat, "src").join(_side(flat, "dst"), "graph_id").where("src_idx <> dst_idx")
    gap = sum(((F.col(f"src_{c}") - F.col(f"dst_{c}")) ** 2 for c in ("dt", "dh", "dw")), F.lit(0)).cast("int")
    place = F.row_number().over(Window.partitionBy("graph_id", "src_idx").orderBy(gap, "dst_idx"))
    kept = pairs.withColumn("place", place).where((F.col("src_idx") == 0) | (F.col("place") <= config.knn))
    zero = F.lit(0)
    own = flat.select("graph_id", F.col("idx").alias("src"), F.col("idx").alias("dst"), F.lit("loop").alias("kind"), zero.alias("et"), zero.alias("eh"), zero.alias("ew"))
    return _ends(kept, "knn").unionByName(own)
