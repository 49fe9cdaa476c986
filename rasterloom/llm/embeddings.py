"""Embedding near-duplicates by an exact metric range join.

On unit vectors a cosine of at least t is a distance of at most sqrt(2 - 2t). Pivots split the vectors into cells by
the nearest pivot. A vector of cell p and one of cell q lie on either side of the plane between p and q, so their
distance is at least the sum of their distances from it; pairs whose sum is larger are left out, in whole stretches of
rows sorted by it. Each vector is stored once, in a pack of whole cells of bounded size, and Spark's Cartesian product
brings the packs together: nothing is copied into other cells, so disk stays in proportion to the input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import Union, components, remove, stored, table, written


def usable(col: str = "embedding"):
    """Vectors with components, all finite, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.col(col).isNotNull() & (F.size(col) > 0) & F.forall(col, finite) & F.exists(col, lambda x: x != 0)


def units(column: pa.Array) -> np.ndarray:
    """The vectors as rows of length one, in double precision; all of one dimension."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def single_units(x: np.ndarray) -> np.ndarray:
    """The rows at length one in single precision, for bounds alone."""
    x = (x / np.abs(x).max(axis=1, keepdims=True)).astype(np.float32)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Pack:
    """The vectors of a stored pack, sorted by cell, with their products with pivots."""

    def __init__(self, pack: int, cells: bytes, keys: bytes, reps: bytes, copies: bytes, values: bytes, kind: np.dtype) -> None:
        self.pack, self.reps, self.copies = pack, np.frombuffer(reps, np.int64), np.frombuffer(copies, np.int64)
        self.keys = np.frombuffer(keys, "V16")
        self.raw = np.frombuffer(values, kind).reshape(len(self.reps), -1)
        self.unit = single_units(self.raw)
        self.cells, starts = np.unique(np.frombuffer(cells, np.int32), return_index=True)
        self.spans = [*zip(starts.tolist(), [*starts[1:].tolist(), len(self.reps)], strict=True)]

    def exact(self, rows: np.ndarray) -> np.ndarray:
        x = self.raw[rows].astype(np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        return x / np.linalg.norm(x, axis=1, keepdims=True)


def merged(labels: np.ndarray, rows: np.ndarray, cols: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The labels after the links between rows and columns joined their groups; a group's label is its smallest."""
    low_r, low_c, top = labels[rows], labels[cols], len(labels)
    if low_r.min() == max(low_r.max(), low_c.max()) and low_c.min() == low_r.min():
        return labels
    while True:
        new_r = np.minimum(low_r, np.where(near, low_c, top).min(axis=1))
        new_c = np.minimum(low_c, np.where(near, new_r[:, None], top).min(axis=0))
        if (new_r == low_r).all() and (new_c == low_c).all():
            break
        low_r, low_c = new_r, new_c
    moves = np.unique(np.stack((labels[np.concatenate((rows, cols))], np.concatenate((low_r, low_c)))), axis=1)
    groups = Union()
    for a, b in moves.T.tolist():
        groups.join(a, b)
    step = np.arange(len(labels))
    for a in groups.up:
        step[a] = groups.root(a)
    return step[labels]


def joined(a: Pack, b: Pack, pivots: np.ndarray, least: float, reach: float) -> pa.RecordBatch:
    """Rows (key, links, rep, low) of the vectors that link here: their links, by copies, and the smallest id reached.

    Products in single precision, with room for their error, leave out what can't link; double precision decides.
    """
    same, n = a.pack == b.pack, len(a.reps)
    off = 0 if same else n
    labels, links = np.arange(n if same else n + len(b.reps)), np.zeros(n if same else n + len(b.reps), np.int64)
    error = (a.raw.shape[1] + 8) * 2.0**-21
    near_a, near_b = a.unit @ pivots[b.cells].T, b.unit @ pivots[a.cells].T
    own_a = [a.unit[s:e] @ pivots[c] for c, (s, e) in zip(a.cells, a.spans, strict=True)]
    own_b = [b.unit[s:e] @ pivots[c] for c, (s, e) in zip(b.cells, b.spans, strict=True)]
    for i, (p, (a0, a1)) in enumerate(zip(a.cells.tolist(), a.spans, strict=True)):
        for j, (q, (b0, b1)) in enumerate(zip(b.cells.tolist(), b.spans, strict=True)):
            if same and q < p:
                continue
            if p == q:
                xs, ys, from_x, from_y, limit = np.arange(a0, a1), np.arange(b0, b1), np.zeros(a1 - a0), np.zeros(b1 - b0), 1.0
            else:  # how far beyond the plane between p and q, times the pivots' distance
                from_x, from_y = own_a[i] - near_a[a0:a1, j], own_b[j] - near_b[b0:b1, i]
                limit = reach * np.linalg.norm(pivots[p] - pivots[q]) + 4 * error
                xs, ys = np.flatnonzero(from_x <= limit - from_y.min()), np.flatnonzero(from_y <= limit - from_x.min())
                xs, ys = xs[np.argsort(from_x[xs])], ys[np.argsort(from_y[ys])]
                from_x, from_y, xs, ys = from_x[xs], from_y[ys], xs + a0, ys + b0
            others = b.unit[ys]
            for at in range(0, len(xs), 256):
                rows, cols = xs[at : at + 256], ys[: np.searchsorted(from_y, limit - from_x[at], "right")]
                near = a.unit[rows] @ others[: len(cols)].T >= least - error
                if not near.any():
                    continue
                rows, cols = rows[near.any(axis=1)], cols[near.any(axis=0)]
                near = a.exact(rows) @ b.exact(cols).T >= least
                if same and p == q:
                    near &= rows[:, None] < cols[None, :]
                rows, cols, near = rows[near.any(axis=1)], cols[near.any(axis=0)], near[np.ix_(near.any(axis=1), near.any(axis=0))]
                if near.size:
                    links[rows] += (near @ b.copies[cols].astype(np.float64)).astype(np.int64)
                    links[off + cols] += (a.copies[rows].astype(np.float64) @ near).astype(np.int64)
                    labels = merged(labels, rows, off + cols, near)
    reps, keys = (a.reps, a.keys) if same else (np.concatenate((a.reps, b.reps)), np.concatenate((a.keys, b.keys)))
    low = np.full(len(reps), np.iinfo(np.int64).max)
    np.minimum.at(low, labels, reps)
    some = np.flatnonzero(links)
    columns = [pa.array([k.tobytes() for k in keys[some]], pa.binary()), *map(pa.array, (links[some], reps[some], low[labels[some]]))]
    return pa.RecordBatch.from_arrays(columns, names=["key", "links", "rep", "low"])


def near_vectors(vectors: DataFrame, least: float = 0.9, cell: int = 2048, block: int = 4096, fewest: int = 8) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept) of every vector.

    Equal vectors link with one another and are compared once. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, nor do vectors of different dimensions. Repeated ids count as vectors of
    their own, in one component; where vec_id is null, component_id and kept are null too if nothing links. Other columns aren't read.
    There is a pivot for each ``cell`` vectors, but at least ``fewest`` (or as many as there are vectors) and at most 1024.
    """
    spark, reach = ship(vectors.sparkSession), math.sqrt(2 - 2 * least)
    digest = F.substring(F.unhex(F.sha2(F.col("embedding").cast("string"), 256)), 1, 16)  # stands for the vector where rows come back to it
    rows = vectors.select("vec_id", "embedding", usable().alias("fit"))
    fit = rows.where("fit").withColumn("key", digest)
    distinct = fit.groupBy("key", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    distinct = written(distinct.where("rep is not null").withColumn("dim", F.size("embedding")), "vectors")
    out = []
    for r in distinct.groupBy("dim").count().orderBy("dim").collect():  # one row a dimension
        part = distinct.where(F.col("dim") == r["dim"])
        n_pivots = max(fewest, min(1024, r["count"] // cell))
        chosen = part.orderBy(F.xxhash64("rep"), "rep", "key").limit(n_pivots).collect()  # at most 1024 vectors
        pivots = units(pa.array([p["embedding"] for p in chosen], pa.list_(pa.float64())))
        most = max(1, min(block, 64 * block // r["dim"]))
        out.append(pack_links(part, spark.sparkContext.broadcast(pivots), least, reach, most))
    if not out:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    labels = components(found.where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b")))
    totals = found.groupBy("key").agg(F.sum("links").alias("links"))
    known = distinct.select("key", "rep", "copies").join(totals, "key", "left").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    known = written(known, "known")
    linked = fit.select("vec_id", "key").join(known, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    alone = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def pack_links(part: DataFrame, pivots, least: float, reach: float, most: int) -> DataFrame:
    """Rows (key, links, rep, low) of each pair of packs, as of ``joined``; a pack holds about ``most`` vectors."""
    spark = part.sparkSession
    home = lambda column: (units(column) @ pivots.value.T).argmax(axis=1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes = np.zeros(len(pivots.value), np.int64)
        for batch in batches:
            if batch.num_rows:
                homes += np.bincount(home(batch.column(0)), minlength=len(homes))
        yield pa.RecordBatch.from_pydict({"cell": np.arange(len(homes), dtype=np.int32), "homes": homes})

    sizes = part.select("embedding").mapInArrow(count, "cell int, homes long").groupBy("cell").agg(F.sum("homes").alias("homes"))
    held = {r["cell"]: r["homes"] for r in sizes.collect()}  # a row a pivot
    first, parts = np.zeros(len(held), np.int64), np.ones(len(held), np.int64)  # each cell's first pack and number of packs
    packs = filled = 0
    for c in range(len(held)):
        if filled and filled + held[c] > most:
            packs, filled = packs + 1, 0
        first[c], parts[c], filled = packs, max(1, -(-held[c] // most)), filled + held[c]
        if parts[c] > 1:
            packs, filled = packs + int(parts[c]), 0
    packs += filled > 0

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = home(batch.column(0))
                salt = np.array([int.from_bytes(k[:4], "big") for k in batch.column(1).to_pylist()], np.int64)
                own = first[cells] + salt % parts[cells]
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(cells.astype(np.int32)), *batch.columns], names=["pack", "cell", *batch.schema.names])

    def fill(group: pa.Table) -> pa.Table:
        group = group.sort_by("cell")
        x = group["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        ints = [group[c].to_numpy().tobytes() for c in ("cell", "rep", "copies")]
        row = (np.int32(group["pack"][0].as_py()), ints[0], b"".join(group["key"].to_pylist()), *ints[1:], x.tobytes())
        return pa.table({n: pa.array([v]) for n, v in zip(names, row, strict=True)})

    names, kind = ["pack", "cells", "keys", "reps", "copies", "values"], part.schema["embedding"].dataType
    dealt = part.select("embedding", "key", "rep", "copies").mapInArrow(deal, f"pack int, cell int, embedding {kind.simpleString()}, key binary, rep long, copies long")
    dealt = dealt.repartition(max(min(packs, 32), packs // 16), "pack")
    filled, path = stored(dealt.groupBy("pack").applyInArrow(fill, "pack int, " + ", ".join(f"{n} binary" for n in names[1:])), "packs")
    number = np.dtype(kind.elementType.simpleString().replace("float", "float32").replace("double", "float64"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, planes = None, pivots.value.astype(np.float32)
        for batch in batches:
            for n in range(batch.num_rows):
                one, two = ([c[n].as_py() for c in batch.columns[s : s + 6]] for s in (0, 6))
                if a is None or a.pack != one[0]:
                    a = Pack(*one, number)
                yield joined(a, a if one[0] == two[0] else Pack(*two, number), planes, least, reach)

    others = filled.select(*[F.col(n).alias(f"{n}_2") for n in names])
    pairs = filled.hint("shuffle_replicate_nl").join(others, F.col("pack") <= F.col("pack_2"))
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "4")  # a row is two packs
    try:
        found = written(pairs.mapInArrow(meet, "key binary, links long, rep long, low long"), "links")
    finally:
        spark.conf.set(limit, before)
    remove(spark, path)
    return found


def op8(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
