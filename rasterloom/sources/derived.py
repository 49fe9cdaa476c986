"""A voxel cube derived from order lines by whole-number arithmetic, for tests, queries and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.raster import clean, densify

SMALL, MIDDLE = (24, 16, 16), (40, 32, 32)


def raw_voxels(spark: SparkSession, sf_dir: str, shape: tuple[int, int, int]) -> DataFrame:
    """t, h, w, raw, quality, n of the cells that any order line falls into."""
    n_t, n_h, n_w = shape
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_shipdate", "l_partkey", "l_orderkey", "l_quantity")
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))
    at = lines.select(
        F.floor(days * n_t / 2500).cast("int").alias("t"), (F.col("l_partkey") % n_h).cast("int").alias("h"), (F.col("l_orderkey") % n_w).cast("int").alias("w"), "l_quantity"
    )
    least = F.min("l_quantity")
    by = at.groupBy("t", "h", "w").agg(F.floor(least * least / 12).cast("int").alias("raw0"), F.count("*").alias("n"))
    t, h, w = (F.col(c).cast("long") for c in ("t", "h", "w"))
    raw = F.when((t * 7919 + h * 104729 + w * 1299709) % 97 == 0, 65535).otherwise(F.col("raw0"))
    flag = F.when((t * 31 + h * 17 + w * 13 + (t * h * w) % 7) % 10 < 2, 2).when((t + h + w) % 5 == 0, 1).otherwise(0)
    return by.select("t", "h", "w", raw.alias("raw"), flag.alias("quality"), "n")


def cube(spark: SparkSession, sf_dir: str, shape: tuple[int, int, int] = SMALL) -> DataFrame:
    """The dense, cleaned cube."""
    return clean(densify(raw_voxels(spark, sf_dir, shape), shape))
