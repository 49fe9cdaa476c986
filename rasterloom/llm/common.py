"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shipping import ship

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any of its file systems works."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only on one machine (a local master), where none is named, a temporary folder is set; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="rasterloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, tag: str, **options: str) -> tuple[DataFrame, str]:
    """``written``, with options of the writer, and the path of the table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends and lost executors cost nothing."""
    return stored(df, tag)[0]


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete stored tables that nothing reads any more."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def whole_text(col: str = "text") -> Column:
    """A null text counts as the empty one."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def remainder(col: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor; a null id counts as the empty text."""
    text = F.coalesce(F.col(col).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(divisor))


def map_rows(df: DataFrame, make: Callable[[], Callable[..., tuple]], schema: StructType, many: int = 256) -> DataFrame:
    """Arrow batches through a plain function of a row's values; ``make`` runs once a task.

    ``many`` rows at a time are plain objects and are sent on, so long values do not pile up.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(df.sparkSession)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for at in range(0, batch.num_rows, many):
                rows = zip(*(c.to_pylist() for c in batch.slice(at, many).columns), strict=True)
                columns = zip(*[each(*row) for row in rows], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def flat_rows(df: DataFrame, make: Callable[[], Callable[..., list[tuple]]], schema: StructType, many: int = 20_000) -> DataFrame:
    """As map_rows, with any number of result rows for a row, sent on in batches of about ``many``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(df.sparkSession)
    arrow = to_arrow_schema(schema)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, out = make(), []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    out += each(*row)
                    if len(out) >= many:
                        yield batch_of(out)
                        out = []
        if out:
            yield batch_of(out)

    return df.mapInArrow(run, schema)


class Union:
    """Union-find over hashable keys; the root of a set is its smallest member."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges (a long, b long): rows (id, component), component the smallest id.

    Rounds of contraction: in an order of the nodes that each round draws anew by hash, each node moves to its first
    neighbour or stays, and edges follow, until none is left. The order keeps rounds logarithmic, for chains of rising
    ids too. Every round's tables are written, so both sides of its joins are plain scans whose hot keys Spark can split,
    and deleted when the next round's are there. Nodes without an edge are absent.
    """
    spark, turn, labels, old = edges.sparkSession, 0, None, []
    edges, path = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    while not edges.isEmpty():
        ranked = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("rank"), F.col(c).alias("to"))  # noqa: B023, E731
        pairs = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moves = pairs.groupBy("a").agg(F.min(ranked("b")).alias("near")).select("a", F.least("near", ranked("a"))["to"].alias("to"))
        moves, moves_path = stored(moves, "moves")
        if labels is None:
            labels, labels_path = moves.select(F.col("a").alias("id"), F.col("to").alias("component")), moves_path
        else:
            moved = labels.join(moves.withColumnRenamed("a", "component"), "component", "left")
            labels, labels_path = stored(moved.select("id", F.coalesce("to", "component").alias("component")), "labels")
        first = edges.join(moves.withColumnRenamed("to", "ta"), "a")
        second = first.join(moves.select(F.col("a").alias("b"), F.col("to").alias("tb")), "b")
        next_edges = second.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        old += [path, moves_path, labels_path]
        edges, path = stored(next_edges, "edges")
        remove(spark, *[p for p in old if p != labels_path])
        old, turn = [labels_path], turn + 1
    low = labels.groupBy("component").agg(F.min("id").alias("low"))
    found = written(labels.join(low, "component").select("id", F.col("low").alias("component")), "components")
    remove(spark, path, *old)
    return found
