"""Writing graphs and cubes, reading them back, and reusing what an earlier run built."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def write_training(packed: DataFrame, path: str, nodes: int, per_class: int) -> str:
    """Graphs with class, a folder for each class; returns the place written, named by its parameters."""
    place = f"{path}/graph_{per_class}_{nodes}_forTrain"
    packed.write.mode("overwrite").partitionBy("class").parquet(place)
    return place


def write_prediction(packed: DataFrame, path: str, nodes: int) -> str:
    """Graphs with day, a folder for each day that has any, its number padded to three digits."""
    place = f"{path}/graph_{nodes}_forPred"
    packed.withColumn("day", F.lpad(F.col("day").cast("string"), 3, "0")).write.mode("overwrite").partitionBy("day").parquet(place)
    return place


def write_cube(voxels: DataFrame, path: str, days: int = 32, side: int = 256) -> None:
    """A cube by blocks of days, within them in order of place, so that readers prune by time and by row ranges.

    A task writes ``side`` times ``side`` pixels of a block, so a file's size does not follow the grid's.
    """
    blocked = voxels.withColumn("block", F.floor(F.col("t") / days).cast("int"))
    blocked.repartition("block", F.floor(F.col("h") / side), F.floor(F.col("w") / side)).sortWithinPartitions("block", "h", "w", "t").write.mode("overwrite").partitionBy("block").parquet(path)


def read_cube(spark: SparkSession, path: str, days: tuple[int, int] | None = None, block: int = 32) -> DataFrame:
    """A stored cube, of the days from first to last if given: only their blocks are listed and read."""
    held = spark.read.parquet(path)
    if days:
        held = held.where(F.col("block").between(days[0] // block, days[1] // block) & F.col("t").between(*days))
    return held.drop("block")


def is_stored(spark: SparkSession, path: str) -> bool:
    """Whether a job has finished writing a table there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def built_once(spark: SparkSession, path: str, build: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
    """The table at path, built and written first unless it is there already."""
    if not rebuild:
        try:
            return spark.read.parquet(path)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def merge(spark: SparkSession, *paths: str) -> DataFrame:
    """Result tables of several runs or tiles as one, columns by name."""
    out = spark.read.parquet(paths[0])
    for path in paths[1:]:
        out = out.unionByName(spark.read.parquet(path), allowMissingColumns=True)
    return out
