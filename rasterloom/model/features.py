"""What the models make of a graph: one vector, by attention layers whose parameters are drawn once from a seed.

The layers are joins and windows (operators.attention, operators.structure), so a graph's vector is computed once,
stored, and read by every step of the fitting, which never sees graphs again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import attention, structure


@dataclass(frozen=True)
class Sizes:
    """Widths and depths. ``top_k`` and ``knn`` are of candidate pools; readout is attention, mean, max or sum."""

    hidden: int = 16
    heads: int = 2
    layers: int = 2
    selector: int = 16
    top_k: int = 36
    knn: int = 8
    readout: str = "attention"
    edge_scale: float = 8.0


def dense(rng, n_in: int, n_out: int) -> tuple[list[list[float]], list[float]]:
    bound = np.sqrt(6 / (n_in + n_out))
    return rng.uniform(-bound, bound, (n_in, n_out)).tolist(), [0.0] * n_out


def initial(sizes: Sizes, kind: str, seed: int = 0) -> dict:
    """Seeded parameters of the layers over 'fixed' graphs or 'candidate' pools."""
    rng, n, share = np.random.default_rng(seed), sizes.hidden, sizes.hidden // sizes.heads
    part = lambda: rng.normal(0, 0.3, (sizes.heads, share)).tolist()
    if kind == "fixed":
        found = []
        for n_in in (4, *[n] * (sizes.layers - 1)):
            one = {"left": dense(rng, n_in, n), "right": dense(rng, n_in, n), "edge": dense(rng, 3, n), "attention": part(), "scale": [1.0] * n, "shift": [0.0] * n}
            found.append(one | ({} if n_in == n else {"skip": dense(rng, n_in, n)}))
        return {"layers": found}
    s = sizes.selector
    select = {"pos1": dense(rng, 3, s // 2), "pos2": dense(rng, s // 2, s), "gate": dense(rng, s + 4, s), "score": dense(rng, s, 1)}
    edges = {"project1": dense(rng, 1, s), "project2": dense(rng, s, s), "near": dense(rng, 3, s // 2), "join1": dense(rng, 2 * s + s // 2, s), "join2": dense(rng, s, 1)}
    layers = [{"transform": dense(rng, n, n), "source": part(), "target": part(), "bias": [0.0] * sizes.heads} for _ in range(sizes.layers)]
    for one in layers[:-1]:  # the last layer has no normalisation
        one |= {"scale": [1.0] * n, "shift": [0.0] * n}
    readout = {"pool1": dense(rng, n, n // 2), "pool2": dense(rng, n // 2, 1)}
    return {"select": select, "edges": edges, "project1": dense(rng, 1, n), "project2": dense(rng, n, n), "layers": layers} | readout


def means(value: Column, d2: Column) -> Column:
    """The mean and the distance-weighted mean of a graph's values, from arrays of both; zeros without any."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    near = F.transform(d2, lambda d: 1.0 / d.cast("double"))
    held = F.transform(value, lambda v: v.cast("double"))
    weighed = total(F.zip_with(held, near, lambda v, w: v * w))
    return F.array(F.coalesce(F.try_divide(total(held), F.size(held)), F.lit(0.0)), F.coalesce(F.try_divide(weighed, total(near)), F.lit(0.0)))


def squares(dt: Column, dh: Column, dw: Column) -> Column:
    return F.transform(F.arrays_zip(dt.alias("a"), dh.alias("b"), dw.alias("c")), lambda d: d["a"] * d["a"] + d["b"] * d["b"] + d["c"] * d["c"])


def of_fixed(graphs: DataFrame, params: dict, sizes: Sizes) -> DataFrame:
    """graph_id, x of graphs (graph_id, arrays idx, dt, dh, dw, value, src, dst): node 0 after the layers, and the neighbours' means."""
    scaled = lambda c: F.concat(F.array(F.lit(0.0)), F.transform(c, lambda d: d / F.lit(sizes.edge_scale)))
    held = graphs.select("graph_id", *[scaled(c).alias(c) for c in ("dt", "dh", "dw")], F.concat(F.array(F.lit(-1.0)), F.transform("value", lambda v: v.cast("double"))).alias("value"), "src", "dst")
    zipped = held.select("graph_id", F.posexplode(F.arrays_zip("value", "dt", "dh", "dw")).alias("idx", "n"))
    nodes = zipped.select("graph_id", "idx", F.array("n.value", "n.dt", "n.dh", "n.dw").alias("x"))
    loop = F.array(F.struct(F.lit(0).alias("src"), F.lit(0).alias("dst")))  # the centre hears itself too
    ends = held.select("graph_id", "dt", "dh", "dw", F.inline(F.concat(F.arrays_zip("src", "dst"), loop)))
    moved = F.array(*[F.element_at(c, F.col("dst") + 1) - F.element_at(c, F.col("src") + 1) for c in ("dt", "dh", "dw")])
    edges = ends.select("graph_id", "src", "dst", moved.alias("moved"))
    for one in params["layers"]:
        nodes = attention.attention_layer(nodes, edges, one, sizes.heads)
    d2 = squares(F.col("dt"), F.col("dh"), F.col("dw"))
    own = graphs.select("graph_id", means(F.col("value"), d2).alias("means"))
    return nodes.where("idx = 0").join(own, "graph_id").select("graph_id", F.concat("x", "means").alias("x"))


def of_pools(pools: DataFrame, params: dict, sizes: Sizes) -> DataFrame:
    """graph_id, x of padded pools (graph_id, candidates, mask): the readout of the learned structure, and the candidates' means."""
    real = pools.select("graph_id", F.transform(F.filter(F.arrays_zip("candidates", "mask"), lambda c: c["mask"]), lambda c: c["candidates"]).alias("held"))
    rows = real.select("graph_id", F.posexplode("held").alias("idx", "c"))
    offsets = [F.col(f"c.{c}").cast("double") / sizes.edge_scale for c in ("dt", "dh", "dw")]
    nodes = rows.select("graph_id", "idx", F.array(*offsets, F.col("c.value").cast("double")).alias("x"))
    vectors = structure.embedded(nodes, params, sizes.top_k, sizes.knn, sizes.heads, sizes.readout)
    own = real.select("graph_id", means(F.col("held.value"), squares(F.col("held.dt"), F.col("held.dh"), F.col("held.dw"))).alias("means"))
    return vectors.join(own, "graph_id").select("graph_id", F.concat("x", "means").alias("x"))


def features(graphs: DataFrame, params: dict, sizes: Sizes, kind: str = "fixed") -> DataFrame:
    return of_fixed(graphs, params, sizes) if kind == "fixed" else of_pools(graphs, params, sizes)
