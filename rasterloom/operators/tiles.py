"""Tiles of the grid and their halos: of one size, or the leaves of a tree that follows the centres."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assign(positions: DataFrame, size: int) -> DataFrame:
    """Adds tile_h and tile_w, the core tile of each position."""
    return positions.withColumn("tile_h", F.floor(F.col("h") / size).cast("int")).withColumn("tile_w", F.floor(F.col("w") / size).cast("int"))


def with_halo(voxels: DataFrame, size: int, overlap: int, shape: tuple[int, int, int]) -> DataFrame:
    """Each cell once for every tile whose core lies within ``overlap`` of it: adds tile_h, tile_w and is_core."""

    def touched(name: str, n: int):
        last = (n - 1) // size
        low = F.greatest(F.lit(0), F.floor((F.col(name) - overlap) / size)).cast("int")
        high = F.least(F.lit(last), F.floor((F.col(name) + overlap) / size)).cast("int")
        return F.explode(F.sequence(low, high))

    out = voxels.withColumn("tile_h", touched("h", shape[1])).withColumn("tile_w", touched("w", shape[2]))
    core = (F.floor(F.col("h") / size) == F.col("tile_h")) & (F.floor(F.col("w") / size) == F.col("tile_w"))
    return out.withColumn("is_core", core)


AXES = ("t", "h", "w")
#: A tile of the tree: its corner, its side, and, where one place alone has too many centres, the share of them.
LEAF = ("t0", "h0", "w0", "side", "share")


def sides(top: int, finest: int) -> list[int]:
    """Sides of the tree's boxes from the widest to the finest, halves of one another."""
    found = [top]
    while found[-1] > finest:
        found.append(found[-1] // 2)
    return found


def _corners(rows: DataFrame, side) -> DataFrame:
    return rows.withColumns({f"{c}0": (F.floor(F.col(c) / side) * side).cast("int") for c in AXES})


def leaves(centers: DataFrame, most: int, top: int = 64, finest: int = 4) -> DataFrame:
    """Rows (t0, h0, w0, side, n): boxes of the centres (t, h, w), split in eight until each holds ``most`` at most.

    Boxes of side ``top`` that hold more are halved on every axis down to ``finest``; boxes without centres do not
    exist. The counts of all levels come from one aggregate, so a crowded box is never gathered.
    """
    levels = sides(top, finest)
    every = centers.select(*AXES, F.explode(F.array(*[F.lit(s) for s in levels])).alias("side"))
    counts = _corners(every, F.col("side")).groupBy("side", "t0", "h0", "w0").agg(F.count("*").alias("n"))
    crowded = counts.where((F.col("n") > most) & (F.col("side") > levels[-1])).select("side", "t0", "h0", "w0")
    inner = crowded.withColumn("side", (F.col("side") / 2).cast("int"))
    for c in AXES:
        inner = inner.withColumn(f"{c}0", F.explode(F.array(F.col(f"{c}0"), F.col(f"{c}0") + F.col("side"))))
    key = ["side", "t0", "h0", "w0"]
    reached = counts.where(F.col("side") == levels[0]).unionByName(counts.where(F.col("side") < levels[0]).join(inner, key))
    return reached.join(crowded, key, "left_anti").select("t0", "h0", "w0", "side", "n")


def in_leaves(centers: DataFrame, found: DataFrame, most: int, top: int = 64, finest: int = 4) -> DataFrame:
    """The centres with their leaf; the finest leaves that still hold too many are shared out by graph_id."""
    every = centers.withColumn("side", F.explode(F.array(*[F.lit(s) for s in sides(top, finest)])))
    held = _corners(every, F.col("side")).join(found, ["side", "t0", "h0", "w0"])
    place = F.row_number().over(Window.partitionBy("t0", "h0", "w0", "side").orderBy("graph_id"))
    crowded = held.where(F.col("n") > most).withColumn("share", F.floor((place - 1) / most).cast("int"))
    return held.where(F.col("n") <= most).withColumn("share", F.lit(0)).unionByName(crowded).drop("n")


def around_leaves(voxels: DataFrame, found: DataFrame, reach: int, most: int, block: int = 16) -> DataFrame:
    """The cells (t, h, w, value) within ``reach`` of each leaf's box, once for each leaf and share.

    Cells are keyed by blocks and a leaf asks for the blocks that its box touches, so this is an equi-join whatever
    the leaves' sides.
    """
    asked = found.withColumn("share", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / most).cast("int"))))
    for c in AXES:
        low, high = F.floor((F.col(f"{c}0") - reach) / block), F.floor((F.col(f"{c}0") + F.col("side") - 1 + reach) / block)
        asked = asked.withColumn(f"b{c}", F.explode(F.sequence(low, high)))
    keyed = voxels.select(*AXES, "value", *[F.floor(F.col(c) / block).alias(f"b{c}") for c in AXES])
    near = F.lit(True)
    for c in AXES:
        near = near & F.col(c).between(F.col(f"{c}0") - reach, F.col(f"{c}0") + F.col("side") - 1 + reach)
    return asked.join(keyed, [f"b{c}" for c in AXES]).where(near).select(*LEAF, *AXES, "value")
