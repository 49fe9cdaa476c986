"""New daily frames as a stream: each batch is cleaned and stored, and its gaps' graphs are built with the days around.

The batch-only predecessor has no such mode; here a day that arrives reruns only what can change, the centres whose
cubes reach it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import CleanConfig, GraphConfig
from ..operators.positions import in_region
from ..operators.raster import clean, densify
from ..plans import builders
from ..sources import sinks

VOXELS = "t int, h int, w int, raw int, quality int"
#: Days of a folder of the store.
BLOCK = 32


def frames(spark: SparkSession, folder: str, files: int = 8) -> DataFrame:
    """The stream of voxel files that land in a folder."""
    return spark.readStream.schema(VOXELS).option("maxFilesPerTrigger", files).parquet(folder)


def affected_days(batch: DataFrame, reach: int) -> DataFrame:
    """t of every day whose centres see a day of the batch."""
    return batch.select("t").distinct().select(F.explode(F.sequence(F.col("t") - reach, F.col("t") + reach)).alias("t")).distinct()


def start(stream: DataFrame, store: str, out: str, checkpoint: str, shape: tuple[int, int, int], config: GraphConfig, cleaning: CleanConfig = CleanConfig()) -> StreamingQuery:  # noqa: B008
    """Runs until stopped; each batch overwrites only its own folder of ``store`` and of ``out``, so a batch that is
    run again after a failure leaves the same files."""

    def step(batch: DataFrame, number: int) -> None:
        spark, mine = batch.sparkSession, f"{store}/batch={number}"
        block = F.floor(F.col("t") / BLOCK).cast("int")
        clean(batch, cleaning).withColumn("block", block).write.mode("overwrite").partitionBy("block").parquet(mine)
        days = affected_days(spark.read.parquet(mine), config.reach)
        ends = days.agg(F.min("t"), F.max("t")).first()
        if ends[0] is None:
            return
        low, high = max(0, ends[0] - config.reach), min(shape[0] - 1, ends[1] + config.reach)
        near = F.col("block").between(low // BLOCK, high // BLOCK) & F.col("t").between(low, high)
        held = spark.read.parquet(store).where((F.col("batch") <= number) & near)  # the folders of other blocks are not read
        latest = held.groupBy("t", "h", "w").agg(F.max_by("value", "batch").alias("value"))  # a day sent again replaces itself
        voxels = densify(latest, shape, (low, high))
        edges = (config.edge_time, config.edge_height, config.edge_width)
        seen = held.select("t").distinct()
        gaps = voxels.where(in_region(shape, edges) & F.col("value").isNull()).join(days.intersect(seen), "t").select("t", "h", "w")
        graphs = builders.build(builders.numbered(gaps, shape), voxels, shape, config)
        graphs.packed(config.edge_scale).write.mode("overwrite").parquet(f"{out}/batch={number}")
        graphs.release()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_graphs(spark: SparkSession, out: str) -> DataFrame:
    """Of each centre the graph that its last batch built."""
    every = sinks.merge(spark, out)
    newest = every.groupBy("graph_id").agg(F.max("batch").alias("batch"))
    return every.join(newest, ["graph_id", "batch"])
