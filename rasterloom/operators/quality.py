"""Scheme A: density, continuity and stability of each pixel, the quality score, and node counts that follow it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import QualityConfig


def pixels(voxels: DataFrame) -> DataFrame:
    """One row a pixel of a dense cube: h, w, n (valid days), mean, deviation (of the population)."""
    v = F.col("value").cast("double")
    return voxels.groupBy("h", "w").agg(F.count("value").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("deviation"))


def boxed(plane: DataFrame, columns: dict[str, Column], radius: int) -> DataFrame:
    """Adds the box sums of the columns, clipped at the grid's sides; the plane must be dense."""
    across = Window.partitionBy("h").orderBy("w").rangeBetween(-radius, radius)
    down = Window.partitionBy("w").orderBy("h").rangeBetween(-radius, radius)
    rows = plane.withColumns({f"_{n}": F.sum(c).over(across) for n, c in columns.items()})
    return rows.withColumns({n: F.sum(f"_{n}").over(down) for n in columns}).drop(*[f"_{n}" for n in columns])


def integral(plane: DataFrame, column: Column) -> DataFrame:
    """The summed-area table: h, w, total of all cells up to and with (h, w)."""
    across = Window.partitionBy("h").orderBy("w").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("w").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    return plane.withColumn("_row", F.sum(column).over(across)).select("h", "w", F.sum("_row").over(down).alias("total"))


def density(plane: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:  # noqa: B008
    """h, w, rho: the share of pixels in the box that are valid on any day."""
    found = boxed(plane, {"valid": (F.col("n") > 0).cast("int"), "area": F.lit(1)}, config.window)
    return found.select("h", "w", (F.col("valid") / F.col("area")).alias("rho"))


def neighbours(plane: DataFrame, radius: int) -> DataFrame:
    """Rows (h, w, mean): for each pixel the means of the valid pixels in its box, by sending each to the cells around."""
    axis = F.sequence(F.lit(-radius), F.lit(radius))
    sent = plane.where("n > 0").select("h", "w", "mean").withColumn("dh", F.explode(axis)).withColumn("dw", F.explode(axis))
    return sent.select((F.col("h") + F.col("dh")).alias("h"), (F.col("w") + F.col("dw")).alias("w"), "mean")


def continuity(plane: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:  # noqa: B008
    """h, w, s: exp(-10 variance) of the pixels' means in the box; 1 for a single one, 0 for none.

    The variance is Spark's one-pass stable one, not a difference of sums of squares.
    """
    found = neighbours(plane, config.window).groupBy("h", "w").agg(F.count("*").alias("k"), F.var_pop("mean").alias("variance"))
    s = F.when(F.col("k") == 1, F.lit(1.0)).when(F.col("k") > 1, F.exp(-10 * F.col("variance"))).otherwise(F.lit(0.0))
    return plane.select("h", "w").join(found, ["h", "w"], "left").select("h", "w", s.alias("s"))


def stability(plane: DataFrame) -> DataFrame:
    """h, w, tstab: 1 / (1 + deviation / mean over all days); a mean within 1e-8 of zero counts as a ratio of 1."""
    ratio = F.when(F.abs("mean") > 1e-8, F.col("deviation") / F.abs("mean")).otherwise(F.lit(1.0))
    return plane.select("h", "w", F.when(F.col("n") == 0, F.lit(0.0)).when(F.col("n") == 1, F.lit(1.0)).otherwise(1 / (1 + ratio)).alias("tstab"))


def quality_map(voxels: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:  # noqa: B008
    """h, w, rho, s, tstab, q of every pixel of a dense cube; 0 to the power 0 is 1."""
    plane = pixels(voxels)
    found = density(plane, config).join(continuity(plane, config), ["h", "w"]).join(stability(plane), ["h", "w"])
    part = lambda c, e: F.when(F.lit(e) == 0, F.lit(1.0)).otherwise(F.pow(c, F.lit(e)))
    return found.withColumn("q", part("rho", config.alpha) * part("s", config.beta) * part("tstab", config.gamma))


def node_count(q: Column, config: QualityConfig) -> Column:
    """An even number of neighbours between the bounds, from a base scaled by quality; the base itself without quality."""
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), q))
    n = F.bround(config.n_base * (config.offset + config.slope * held)).cast("int")
    n = F.greatest(F.lit(config.n_min), F.least(F.lit(config.n_max), n))
    n = n + n % 2
    return F.when(q.isNull(), F.lit(config.n_base)).when(n > config.n_max, n - 2).otherwise(n)


def with_node_count(centers: DataFrame, qualities: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:  # noqa: B008
    """Centres with n, looked up at their pixel; off the map the base. Spark broadcasts the map where it is small."""
    found = centers.join(qualities.select("h", "w", "q"), ["h", "w"], "left")
    return found.withColumn("n", node_count(F.col("q"), config)).select(*centers.columns, "n")


def node_histogram(counted: DataFrame) -> DataFrame:
    """n, graphs and their share."""
    by = counted.groupBy("n").agg(F.count("*").alias("graphs"))
    return by.withColumn("share", F.col("graphs") / F.sum("graphs").over(Window.partitionBy()))
