"""Centres: regions, gaps, classes, sampling and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import NATURAL_BREAKS, GraphConfig
from ..functions.geometry import brightness_class


def in_region(shape: tuple[int, int, int], edges: tuple[int, int, int]) -> Column:
    """Cells at least ``edges`` away from the grid's sides."""
    held = F.lit(True)
    for name, size, edge in zip(("t", "h", "w"), shape, edges, strict=True):
        held = held & (F.col(name) >= edge) & (F.col(name) < size - edge)
    return held


def early_edges(shape: tuple[int, int, int], temporal_buffer: int = 10, buffer: int = 50) -> tuple[int, int, int]:
    """Margins of the first generation: buffers cut to half of the axes, space by the shorter one."""
    space = min(buffer, min(shape[1:]) // 2)
    return min(temporal_buffer, shape[0] // 2), space, space


def missing(voxels: DataFrame, shape: tuple[int, int, int], edges: tuple[int, int, int]) -> DataFrame:
    """Gaps in the region, of a dense cube."""
    return voxels.where(in_region(shape, edges) & F.col("value").isNull()).select("t", "h", "w")


def present(voxels: DataFrame, shape: tuple[int, int, int], edges: tuple[int, int, int]) -> DataFrame:
    return voxels.where(in_region(shape, edges) & F.col("value").isNotNull()).select("t", "h", "w", "value")


def missing_by_day(voxels: DataFrame, shape: tuple[int, int, int], edges: tuple[int, int, int]) -> DataFrame:
    """Rows (day, n): gaps of each day of the region, counted from its first, days without gaps included."""
    gaps = missing(voxels, shape, edges).groupBy((F.col("t") - edges[0]).cast("long").alias("day")).agg(F.count("*").alias("n"))
    days = voxels.sparkSession.range(max(0, shape[0] - 2 * edges[0])).withColumnRenamed("id", "day")
    return days.join(gaps, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def classify(voxels: DataFrame, breaks: tuple[float, ...] = NATURAL_BREAKS, bounds: str = "open") -> DataFrame:
    return voxels.withColumn("class", brightness_class(F.col("value"), breaks, bounds))


def draw(seed: int, *columns: str) -> Column:
    """A row's place in a reproducible shuffle: 60 bits of an md5 over seed and columns, the same in every engine."""
    text = F.concat_ws(",", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def shuffled(rows: DataFrame, by: str, seed: int, keys: tuple[str, ...], parts: int = 4096) -> DataFrame:
    """Adds ordinal (from 1, in draw order) and population within each ``by``.

    Draws are split into ranges that are ranked apart and offset by the sums of those before, so that a class that
    holds most rows is not sorted in one task.
    """
    cell = F.floor(F.col("draw") / ((1 << 60) // parts)).cast("int")  # parts divides 2 to the 60
    drawn = rows.withColumn("draw", draw(seed, *keys)).withColumn("cell", cell)
    counts = drawn.groupBy(by, "cell").agg(F.count("*").alias("n"))  # parts rows a class
    before = Window.partitionBy(by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(by, "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"), F.sum("n").over(Window.partitionBy(by)).alias("population"))
    own = F.row_number().over(Window.partitionBy(by, "cell").orderBy("draw", *keys))
    ranked = drawn.withColumn("own", own).join(counts, [by, "cell"])
    return ranked.withColumn("ordinal", F.col("own") + F.col("ahead")).drop("own", "ahead", "cell", "draw")


def stratified_sample(rows: DataFrame, size: int, seed: int = 0, by: str = "class", keys: tuple[str, ...] = ("t", "h", "w"), replace: bool = True) -> DataFrame:
    """``size`` rows a class, with sample_id from 1: without repeats where it has as many, else with replacement.

    A class with fewer rows fills slot s with the row of ordinal hash(seed, class, s) mod population, plus one; with
    replace false it gives all its rows once.
    """
    ranked = shuffled(rows, by, seed, keys)
    enough = ranked.where((F.col("population") >= size) | F.lit(not replace)).where(F.col("ordinal") <= size)
    taken = enough.withColumn("sample_id", F.col("ordinal"))
    if replace:
        few = ranked.where(F.col("population") < size)
        slots = few.select(by, "population").distinct().withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(size))))
        slots = slots.withColumn("ordinal", draw(seed, by, "slot") % F.col("population") + 1).drop("population")
        taken = taken.unionByName(slots.join(few, [by, "ordinal"]).withColumn("sample_id", F.col("slot").cast("long")).drop("slot"))
    return taken.drop("ordinal", "population")


def split(rows: DataFrame, keys: tuple[str, ...], share: float = 0.8, seed: int = 42) -> DataFrame:
    """Adds part: 'train' for exactly floor(share n) rows in draw order, 'val' for the rest."""
    ranked = shuffled(rows.withColumn("_all", F.lit(0)), "_all", seed, keys)
    return ranked.withColumn("part", F.when(F.col("ordinal") <= F.floor(F.col("population") * share), "train").otherwise("val")).drop("_all", "ordinal", "population")


def first_draws(rows: DataFrame, n: int, keys: tuple[str, ...], seed: int = 0) -> DataFrame:
    """The first n rows of the shuffle: a bounded benchmark sample."""
    return rows.orderBy(draw(seed, *keys), *keys).limit(n)


def training_centers(voxels: DataFrame, shape: tuple[int, int, int], config: GraphConfig, replace: bool = True, bounds: str = "open") -> DataFrame:
    """Sampled centres of every class in the region: class, sample_id, t, h, w. Without ``replace`` small classes come once."""
    edges = (config.edge_time, config.edge_height, config.edge_width)
    rows = classify(present(voxels, shape, edges), config.breaks, bounds).where("class > 0")
    return stratified_sample(rows.select("class", "t", "h", "w"), config.sample_per_class, config.seed, replace=replace)
