"""Cubes as rows (t, h, w, ...): stacking of frames, cleaning, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import CleanConfig
from ..functions.geometry import days_in


def spine(spark: SparkSession, shape: tuple[int, int, int]) -> DataFrame:
    """Every cell of a grid: t, h, w."""
    n_t, n_h, n_w = shape
    cell = spark.range(n_t * n_h * n_w)
    return cell.select(
        F.floor(F.col("id") / (n_h * n_w)).cast("int").alias("t"), (F.floor(F.col("id") / n_w) % n_h).cast("int").alias("h"), (F.col("id") % n_w).cast("int").alias("w")
    )


def densify(voxels: DataFrame, shape: tuple[int, int, int], days: tuple[int, int] | None = None) -> DataFrame:
    """All cells of the grid, or of its days from first to last; those without a row get nulls. Rows off the grid go."""
    first, last = days or (0, shape[0] - 1)
    cells = spine(voxels.sparkSession, (last - first + 1, *shape[1:])).withColumn("t", F.col("t") + first)
    return cells.join(voxels, ["t", "h", "w"], "left")


def clean(voxels: DataFrame, config: CleanConfig = CleanConfig()) -> DataFrame:  # noqa: B008
    """Adds value: null for nodata and for quality over the limit; a null quality keeps the cell.

    The divisions are made in double precision, one after the other, and the result stored in single.
    """
    raw = F.col("raw") if config.nodata is None else F.nullif(F.col("raw"), F.lit(config.nodata))
    kept = F.when(F.col("quality") > config.max_quality, None).otherwise(raw) if "quality" in voxels.columns else raw
    scaled = kept.cast("double") / F.lit(config.radiance_divisor) / F.lit(config.feature_scale)
    return voxels.withColumn("value", scaled.cast("float"))


def clean_single(voxels: DataFrame, config: CleanConfig = CleanConfig(nodata=None)) -> DataFrame:  # noqa: B008
    """The variant of the candidate builder: single precision throughout, and no nodata rule."""
    kept = F.when(F.col("quality") > config.max_quality, None).otherwise(F.col("raw")) if "quality" in voxels.columns else F.col("raw")
    one = (kept.cast("float") / F.lit(config.radiance_divisor).cast("float")).cast("float")
    return voxels.withColumn("value", (one / F.lit(config.feature_scale).cast("float")).cast("float"))


def join_quality(values: DataFrame, flags: DataFrame, nodata: int = 255) -> DataFrame:
    """The quality raster joined to the values; its own nodata becomes null."""
    return values.join(flags.withColumn("quality", F.nullif("quality", F.lit(nodata))), ["t", "h", "w"], "left")


def stack_year(frames: DataFrame, year: int, shape: tuple[int, int], nodata: int = 65535, scale: float = 0.1) -> DataFrame:
    """A year's cube from rows (doy, h, w, raw): each day has all cells, those without data null.

    t is the day of the year less one. Of several rows of a cell the largest count stays.
    """
    spark = frames.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(1), days_in(F.lit(year)))).alias("doy"))
    cells = spark.range(shape[0] * shape[1]).select(F.floor(F.col("id") / shape[1]).cast("int").alias("h"), (F.col("id") % shape[1]).cast("int").alias("w"))
    one = frames.groupBy("doy", "h", "w").agg(F.max("raw").alias("raw"))
    full = cells.crossJoin(F.broadcast(days)).join(one, ["doy", "h", "w"], "left")  # at most 366 days
    value = F.when(F.col("raw") != nodata, F.col("raw") * F.lit(scale))
    return full.select((F.col("doy") - 1).alias("t"), "h", "w", "raw", value.alias("radiance"))


def valid(value: Column | None = None) -> Column:
    return (F.col("value") if value is None else value).isNotNull()


#: Cells of the value range that quantiles are narrowed to.
CELLS = 1 << 16


def quantiles(values: DataFrame, points: tuple[float, ...]) -> DataFrame:
    """One row q0, q1, ...: the exact quantiles of v at the points, between neighbouring values in proportion; null without values.

    Counts of equal cells of the range tell the cell of each wanted rank; only the values in those cells are counted one
    by one. No task and no buffer holds all values.
    """
    v, held = F.col("v"), values.where(F.col("v").isNotNull()).select("v")
    ends = held.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    cell = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((v - F.col("lo")) / (F.col("hi") - F.col("lo")) * CELLS), F.lit(CELLS - 1))).otherwise(F.lit(0))
    celled = held.crossJoin(F.broadcast(ends)).select("v", cell.cast("int").alias("cell"))  # one row
    upto = F.sum("m").over(Window.orderBy("cell"))  # CELLS rows at most
    ranged = celled.groupBy("cell").agg(F.count("*").alias("m")).select("cell", (upto - F.col("m")).alias("before"), upto.alias("upto"))
    place = [(i, F.lit(float(p)) * (F.col("n") - 1)) for i, p in enumerate(points)]
    wanted = [F.struct(F.lit(i).alias("point"), end(at).cast("long").alias("rank"), (at - F.floor(at)).alias("share")) for i, at in place for end in (F.floor, F.ceil)]
    asked = ends.where("n > 0").select(F.inline(F.array(*wanted))).distinct()
    hits = F.broadcast(ranged.join(F.broadcast(asked), (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("upto"))))  # two rows a point
    inside = celled.join(F.broadcast(hits.select("cell").distinct()), "cell").groupBy("cell", "v").agg(F.count("*").alias("k"))
    inside = inside.withColumn("through", F.sum("k").over(Window.partitionBy("cell").orderBy("v")))
    met = inside.join(hits, "cell").where((F.col("rank") - F.col("before") < F.col("through")) & (F.col("rank") - F.col("before") >= F.col("through") - F.col("k")))
    each = met.groupBy("point").agg((F.min("v") + (F.max("v") - F.min("v")) * F.max("share")).alias("q"))
    return each.agg(*[F.max(F.when(F.col("point") == i, F.col("q"))).alias(f"q{i}") for i in range(len(points))])


def summary(voxels: DataFrame) -> DataFrame:
    """One row: cells, valid, missing, ratio, least, most, mean, median and 99.9 % point of the values."""
    v = F.col("value").cast("double")
    sums = voxels.agg(
        F.count("*").alias("cells"), F.count("value").alias("valid"), F.count_if(F.col("value").isNull()).alias("missing"),
        (F.count("value") / F.count("*")).alias("valid_ratio"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v).alias("mean"),
    )
    points = quantiles(voxels.select(v.alias("v")), (0.5, 0.999))
    return sums.crossJoin(F.broadcast(points)).withColumnsRenamed({"q0": "median", "q1": "p999"})  # one row each
