"""A synthetic cube: exponential brightness under a bell over space and a yearly wave, with gaps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.raster import spine


def cube(spark: SparkSession, shape: tuple[int, int, int], seed: int = 42, missing: float = 0.3) -> DataFrame:
    """t, h, w, raw (counts of a tenth), quality: the same for a seed however the rows are dealt out."""
    _, n_h, n_w = shape
    bits = lambda salt: F.conv(F.substring(F.md5(F.concat_ws(",", F.lit(f"{seed}{salt}"), "t", "h", "w").cast("binary")), 1, 13), 16, 10).cast("double")
    uniform = lambda salt: (bits(salt) + 0.5) / float(1 << 52)
    bell = F.exp(-(((F.col("h") - n_h / 2) / (n_h / 4)) ** 2 + ((F.col("w") - n_w / 2) / (n_w / 4)) ** 2) / 2)
    wave = 1 + 0.3 * F.cos(2 * math.pi * F.col("t") / 365)
    level = -F.log(uniform("a")) * 2 * bell * wave
    raw = F.when(uniform("b") < missing, 65535).otherwise(F.least(F.lit(65534), F.floor(level * 100))).cast("int")
    return spine(spark, shape).select("t", "h", "w", raw.alias("raw"), F.lit(0).alias("quality"))
