"""The tile path: the same graphs from dense blocks of the cube, one tile at a time.

Where very many centres lie close together, their cubes overlap almost wholly. Centres are then dealt out by the leaves
of a tree that splits space and time where they crowd, cells with a halo, and each leaf's graphs are cut from one dense
array with the offsets' order computed once. The relational path stays the definition; results are equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..config import GraphConfig
from ..operators import tiles
from ..shipping import ship

SCHEMA = (
    "graph_id long, t int, h int, w int, radius int, idx array<int>, dt array<int>, dh array<int>, dw array<int>, value array<float>, "
    "src array<int>, dst array<int>, kind array<string>"
)


@cache
def cube_offsets(radius: int) -> dict[str, np.ndarray]:
    """The cube's offsets but the centre, in the order of distance, with their quadrants and radii."""
    axis = np.arange(-radius, radius + 1)
    dt, dh, dw = (a.ravel() for a in np.meshgrid(axis, axis, axis, indexing="ij"))
    d2 = dt**2 + dh**2 + dw**2
    order = np.lexsort((dw, dh, dt, d2))[1:]
    d = np.stack([dt, dh, dw], axis=1)[order]
    return {"d": d, "d2": d2[order], "cheb": np.abs(d).max(axis=1), "quadrant": quadrants(d)}


def quadrants(d: np.ndarray) -> np.ndarray:
    """The quadrant of every offset; see functions.geometry.quadrant for the rule."""
    (dt, dh, dw), (a, b, c) = d.T, np.abs(d).T
    wins = lambda own, other, tie: (own > other) | ((own == other) & tie)
    t, h, w = dt > 0, dh > 0, dw > 0
    first = (a >= b) & (a >= c)
    tests = [
        (dt < 0) & first, t & first,
        (dh < 0) & wins(b, a, t) & wins(b, c, w), h & wins(b, a, ~t) & wins(b, c, ~w),
        (dw < 0) & wins(c, a, ~t) & wins(c, b, ~h), w & wins(c, a, t) & wins(c, b, h),
    ]
    return np.select(tests, range(1, 7), 0)


def nth_true(mask: np.ndarray, n: int) -> np.ndarray:
    """For each row the place of its n-th true entry, -1 without one."""
    counts = np.cumsum(mask, axis=1, dtype=np.int32)
    at = (counts >= n).argmax(axis=1) if mask.shape[1] else np.zeros(len(mask), int)
    return np.where(counts[:, -1] >= n, at, -1) if mask.shape[1] else np.full(len(mask), -1)


def pick(valid: np.ndarray, off: dict[str, np.ndarray], limits: dict[int, int], ext: int) -> tuple[np.ndarray, np.ndarray]:
    """(graph, node) places of the chosen offsets in idx order, and each graph's radius; radius -1 where a quota fails."""
    n = sum(limits.values())
    radius = np.full(len(valid), ext)
    by_quadrant = {q: np.flatnonzero(off["quadrant"] == q) for q in limits if limits[q]}
    for q, at in by_quadrant.items():
        ring = at[np.argsort(off["cheb"][at], kind="stable")]
        last = nth_true(valid[:, ring], limits[q])
        radius = np.where((radius < 0) | (last < 0), -1, np.maximum(radius, off["cheb"][ring][last]))
    chosen = np.zeros((len(valid), n), np.int64)
    for q, at in by_quadrant.items():
        seen = valid[:, at] & (off["cheb"][at][None, :] <= radius[:, None])
        order = np.argsort(~seen, axis=1, kind="stable")[:, : limits[q]]
        for k in range(limits[q]):
            chosen[:, 6 * k + q - 1] = at[order[:, k]] if order.shape[1] > k else 0
    return chosen, radius


def line_cells(d: np.ndarray) -> np.ndarray:
    """(step, node, axis): the cells on each offset's line to the centre; zeros once it has arrived."""
    n = np.abs(d).max(axis=-1, keepdims=True)
    steps = np.arange(1, max(2, int(n.max())))[:, None, None, None]
    moved = (2 * np.abs(d) * steps + n) // (2 * n)
    return np.where(steps < n, d - np.sign(d) * moved, 0)


def connect(d: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(graph, src, dst, kind) of all edges in ordinal order; d is (graph, node, axis) without centres. Kinds 0 to 3 are A, B in time, B in space, C."""
    n_graphs, n = d.shape[:2]
    side = 2 * reach + 1
    flat = lambda x: ((x[..., 0] + reach) * side + x[..., 1] + reach) * side + x[..., 2] + reach
    graph = np.arange(n_graphs)[:, None]
    place = np.zeros((n_graphs, side**3), np.uint8)
    place[graph, flat(d)] = np.arange(1, n + 1)[None, :]
    hit = np.zeros((n_graphs, n), np.int64)
    own = np.arange(1, n + 1)[None, :]
    for cells in line_cells(d):
        met = place[graph, flat(cells)].astype(np.int64)
        hit = np.where((hit == 0) & (met > 0) & (met < own), met, hit)
    full = np.concatenate([np.zeros((n_graphs, 1, 3), d.dtype), d], axis=1)
    d2 = (full**2).sum(axis=-1)
    same = full[:, 1:, None, :] == full[:, None, :, :]
    t, h, w = same[..., 0], same[..., 1], same[..., 2]
    earlier = (np.arange(n + 1)[None, :] < np.arange(1, n + 1)[:, None]) & (d2[:, 1:, None] > d2[:, None, :])
    kind = np.full(same.shape[:3], -1)
    kind[earlier & t & ~(h & w)] = 1
    kind[earlier & ~t & (h | w)] = 2
    kind[graph, own - 1, hit] = 0
    kind[:, np.arange(n), np.arange(1, n + 1)] = 3
    g, s, e = np.nonzero(kind >= 0)
    k = kind[g, s, e]
    order = np.lexsort((e, k, s, g))
    return g[order], s[order] + 1, e[order], k[order]


def build(centers: DataFrame, voxels: DataFrame, shape: tuple[int, int, int], config: GraphConfig, most: int = 4096, top: int = 64, finest: int = 4, batch: int = 256) -> DataFrame:
    """One row a graph, as in SCHEMA, of the centres (graph_id, t, h, w).

    Tiles are the leaves of a tree over the centres: none holds more than ``most`` of them, however they crowd, and its
    block has at most ``top`` plus twice the reach cells on a side, whatever the cube.
    """
    ship(centers.sparkSession)
    reach, limits = config.reach, config.limits
    found = tiles.leaves(centers, most, top, finest)
    halo = tiles.around_leaves(voxels.where(F.col("value").isNotNull()), found, reach, most)
    dealt = tiles.in_leaves(centers.select("graph_id", *tiles.AXES), found, most, top, finest)
    steps = sorted({min(reach, config.ext_range + k) for k in (0, 3, 8, config.max_ext)})

    def cut(key, mine: pa.Table, cells: pa.Table) -> Iterator[pa.RecordBatch]:
        corner, side = np.array([k.as_py() for k in key[:3]]) - reach, key[3].as_py()
        block = np.full([side + 2 * reach] * 3, np.nan, np.float32)
        if cells.num_rows:
            at = np.stack([cells[c].to_numpy() for c in tiles.AXES], axis=1) - corner
            block[tuple(at.T)] = cells["value"].to_numpy()
        where = np.stack([mine[c].to_numpy() for c in tiles.AXES], axis=1) if mine.num_rows else np.zeros((0, 3), np.int64)
        ids = mine["graph_id"].to_numpy() if mine.num_rows else np.zeros(0, np.int64)
        left = np.flatnonzero((where >= config.ext_range).all(axis=1) & (where + config.ext_range < np.array(shape)).all(axis=1))
        for radius in steps:  # only graphs that fail within one radius see the next
            off, again = cube_offsets(radius), []
            group = max(1, min(batch, 40_000_000 // len(off["d"])))
            for a in range(0, len(left), group):
                rows = left[a : a + group]
                values = block[tuple(((where[rows] - corner)[:, None, :] + off["d"][None]).transpose(2, 0, 1))]
                valid = ~np.isnan(values)
                chosen, r = pick(valid, off, limits, config.ext_range)
                fits = (r >= 0) & (where[rows] - r[:, None] >= 0).all(axis=1) & (where[rows] + r[:, None] < np.array(shape)).all(axis=1)
                again.append(rows[r < 0])
                yield from emit(ids[rows][fits], where[rows][fits], r[fits], chosen[fits], values[fits], off, reach)
            left = np.concatenate(again) if again else left[:0]

    def run(key, mine: pa.Table, cells: pa.Table) -> pa.Table:
        made = list(cut(key, mine, cells))
        return pa.Table.from_batches(made) if made else emit_empty()

    return dealt.groupBy(*tiles.LEAF).cogroup(halo.groupBy(*tiles.LEAF)).applyInArrow(run, SCHEMA)


FINISHED = "batch int, centers long, graphs long"


def finished(spark: SparkSession, path: str) -> DataFrame:
    """Rows (batch, centers, graphs) of the batches that ``build_into`` has finished there."""
    try:
        return spark.read.schema(FINISHED).parquet(f"{path}/finished")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], FINISHED)
        raise


def build_into(path: str, centers: DataFrame, voxels: DataFrame, shape: tuple[int, int, int], config: GraphConfig, batches: int = 8, now: int | None = None, top: int = 64, **how) -> DataFrame:
    """The graphs of ``build``, written under ``path`` in batches of whole boxes; a run goes on where one before it ended.

    A batch's folder is overwritten whole and then listed as finished, with its numbers of centres and graphs, which are
    counted while it is written. ``now`` bounds the batches of this call alone. The same tables and batches must be given.
    """
    spark = centers.sparkSession
    done = {r.batch for r in finished(spark, path).select("batch").collect()}  # one row a batch
    box = F.xxhash64(*[F.floor(F.col(c) / top) for c in tiles.AXES])
    for batch in [b for b in range(batches) if b not in done][:now]:
        asked, built = Observation(), Observation()
        mine = centers.where(F.pmod(box, F.lit(batches)) == batch)
        made = build(mine, voxels, shape, config, top=top, **how)
        made.observe(built, F.count("*").alias("graphs")).withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/graphs")
        mine.observe(asked, F.count("*").alias("centers")).write.format("noop").mode("overwrite").save()
        row = [(batch, asked.get["centers"], built.get["graphs"])]
        spark.createDataFrame(row, FINISHED).coalesce(1).write.mode("append").parquet(f"{path}/finished")
    return spark.read.parquet(f"{path}/graphs")


def lists(counts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values, kind))


def emit(ids, where, radius, chosen, values, off, reach) -> Iterator[pa.RecordBatch]:
    if not len(ids):
        return
    d = off["d"][chosen]
    g, src, dst, kind = connect(d, reach)
    n = np.full(len(ids), chosen.shape[1])
    e = np.bincount(g, minlength=len(ids))
    int32 = pa.int32()
    names = np.array(["A", "B", "B", "C"], object)
    columns = [
        pa.array(ids, pa.int64()), *(pa.array(where[:, i], int32) for i in range(3)), pa.array(radius, int32),
        lists(n, np.tile(np.arange(1, chosen.shape[1] + 1), len(ids)), int32), *(lists(n, d[..., i].ravel(), int32) for i in range(3)),
        lists(n, np.take_along_axis(values, chosen, axis=1).ravel(), pa.float32()),
        lists(e, src, int32), lists(e, dst, int32), lists(e, names[kind], pa.string()),
    ]
    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])


def emit_empty() -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32()), "array<float>": pa.list_(pa.float32()), "array<string>": pa.list_(pa.string())}
    fields = [pa.field(*(lambda n, k: (n, kinds[k]))(*c.split())) for c in SCHEMA.split(", ")]
    return pa.schema(fields).empty_table()


def nodes(built: DataFrame) -> DataFrame:
    """graph_id, radius, idx, dt, dh, dw, value of the tile path's graphs."""
    return built.select("graph_id", "radius", F.inline(F.arrays_zip("idx", "dt", "dh", "dw", "value")))


def edges(built: DataFrame) -> DataFrame:
    """graph_id, ordinal, src, dst, kind."""
    return built.select("graph_id", F.posexplode(F.arrays_zip("src", "dst", "kind")).alias("n", "e")).select("graph_id", (F.col("n") + 1).alias("ordinal"), "e.*")
