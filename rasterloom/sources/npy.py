"""Cubes (T, H, W) as .npy files on a file system that all executors mount: one file, or a folder of blocks with a manifest.

Reading prunes by bounds on t, h and w, which Spark hands to the source; writing puts each block into a file of its own
and names the files in a manifest once all tasks are done, so a reader sees a whole cube or none.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from ..shipping import ship

AXES, MANIFEST = ("t", "h", "w"), "manifest.json"


@dataclass
class Block(InputPartition):
    """A part of a file: its path, the cube's corner where the file begins, and the bounds to read, of the whole cube."""

    path: str
    corner: tuple[int, int, int]
    low: tuple[int, int, int]
    high: tuple[int, int, int]


class CubeReader(DataSourceReader):
    """One partition for each few days of a file; a task maps only what it reads."""

    def __init__(self, options) -> None:
        self.path = options["path"].removeprefix("file://").removeprefix("file:")
        self.days = int(options.get("days", 16))
        self.low, self.high = [0, 0, 0], [1 << 62] * 3

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes bounds on t, h and w as slices; all filters are still applied by Spark."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in AXES and isinstance(getattr(f, "value", None), int):
                i = AXES.index(name)
                if isinstance(f, (GreaterThanOrEqual, GreaterThan, EqualTo)):
                    self.low[i] = max(self.low[i], f.value + isinstance(f, GreaterThan))
                if isinstance(f, (LessThanOrEqual, LessThan, EqualTo)):
                    self.high[i] = min(self.high[i], f.value + 1 - isinstance(f, LessThan))
            yield f

    def files(self) -> list[tuple[str, tuple, tuple]]:
        if not os.path.isdir(self.path):
            return [(self.path, (0, 0, 0), np.load(self.path, mmap_mode="r").shape)]
        with open(os.path.join(self.path, MANIFEST)) as held:
            return [(os.path.join(self.path, b["file"]), tuple(b["corner"]), tuple(b["size"])) for b in json.load(held)["blocks"]]

    def partitions(self) -> list[InputPartition]:
        found = []
        for path, corner, size in self.files():
            low = [max(a, b) for a, b in zip(corner, self.low, strict=True)]
            high = [min(c + n, b) for c, n, b in zip(corner, size, self.high, strict=True)]
            if all(a < b for a, b in zip(low, high, strict=True)):
                found += [Block(path, corner, (t, *low[1:]), (min(high[0], t + self.days), *high[1:])) for t in range(low[0], high[0], self.days)]
        return found or [Block("", (0, 0, 0), (0, 0, 0), (0, 0, 0))]

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        held = np.load(partition.path, mmap_mode="r")
        (_, h0, w0), (_, h1, w1) = partition.low, partition.high
        for t in range(partition.low[0], partition.high[0]):
            plane = np.asarray(held[t - partition.corner[0], h0 - partition.corner[1] : h1 - partition.corner[1], w0 - partition.corner[2] : w1 - partition.corner[2]], dtype=np.float64)
            h, w = np.indices(plane.shape, dtype=np.int32)
            raw = pa.array(plane.ravel(), mask=np.isnan(plane.ravel()))  # not-a-number is missing: null, never NaN
            yield pa.RecordBatch.from_arrays([pa.array(np.full(plane.size, t, np.int32)), pa.array(h.ravel() + np.int32(h0)), pa.array(w.ravel() + np.int32(w0)), raw], names=["t", "h", "w", "raw"])


@dataclass
class Written(WriterCommitMessage):
    blocks: list[dict]


class CubeWriter(DataSourceArrowWriter):
    """Blocks of days by side by side cells, each from one task; rows come in order of their block."""

    def __init__(self, options, overwrite: bool) -> None:
        self.path = options["path"].removeprefix("file://").removeprefix("file:")
        self.shape = [int(n) for n in options["shape"].split(",")]
        self.steps = [int(options.get("days", 16)), *[int(options.get("side", 512))] * 2]
        self.overwrite = overwrite
        self.run = uuid.uuid4().hex
        if os.path.exists(os.path.join(self.path, MANIFEST)) and not overwrite:
            raise FileExistsError(f"{self.path} holds a cube already")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.path, exist_ok=True)
        blocks, block, key = [], None, None

        def close() -> None:
            if block is not None:
                corner = [k * s for k, s in zip(key, self.steps, strict=True)]
                name = f"{self.run}-{'-'.join(map(str, key))}-{uuid.uuid4().hex}.npy"
                np.save(os.path.join(self.path, name), block)
                blocks.append({"file": name, "corner": corner, "size": list(block.shape)})

        for batch in batches:
            at = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1).astype(np.int64)
            if len(at) and ((at < 0).any() or (at >= np.array(self.shape)).any()):
                raise ValueError("a cell lies off the grid")
            raw = batch.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
            keys = at // np.array(self.steps)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(at)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if tuple(keys[a]) != key:
                    close()
                    key = tuple(int(k) for k in keys[a])
                    block = np.full([min(s, n - k * s) for k, s, n in zip(key, self.steps, self.shape, strict=True)], np.nan)
                block[tuple((at[a:b] - np.array(key) * self.steps).T)] = raw[a:b]
        close()
        return Written(blocks)

    def commit(self, messages: list[Written | None]) -> None:
        """Names the blocks in the manifest by one rename, then drops those of the cube before."""
        os.makedirs(self.path, exist_ok=True)
        blocks = [b for m in messages if m is not None for b in m.blocks]
        draft = os.path.join(self.path, f".{self.run}.json")
        with open(draft, "w") as held:
            json.dump({"shape": self.shape, "blocks": sorted(blocks, key=lambda b: b["corner"])}, held)
        os.replace(draft, os.path.join(self.path, MANIFEST))
        self._drop({b["file"] for b in blocks})

    def abort(self, messages: list[Written | None]) -> None:
        """Drops what this run has written; a cube that was there before stays as it was."""
        for name in os.listdir(self.path) if os.path.isdir(self.path) else []:
            if name.startswith(self.run):
                os.remove(os.path.join(self.path, name))

    def _drop(self, kept: set[str]) -> None:
        for name in os.listdir(self.path):
            if name.endswith(".npy") and name not in kept:
                os.remove(os.path.join(self.path, name))


class CubeSource(DataSource):
    """spark.read.format('npycube').load(path) -> t, h, w, raw; df.write.format('npycube').option('shape', 't,h,w').save(path)."""

    @classmethod
    def name(cls) -> str:
        return "npycube"

    def schema(self) -> str:
        return "t int, h int, w int, raw double"

    def reader(self, schema) -> CubeReader:
        return CubeReader(self.options)

    def writer(self, schema, overwrite: bool) -> CubeWriter:
        return CubeWriter(self.options, overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Makes the source known to a session and lets Spark hand filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    ship(spark).dataSource.register(CubeSource)
    return spark


def read(spark: SparkSession, data: str, quality: str | None = None, days: int = 16) -> DataFrame:
    """t, h, w, raw and, where a second file gives it, quality of a cube; bounds on t, h and w read only their slices."""
    register(spark)
    cube = spark.read.format("npycube").option("days", days).load(data)
    if quality is None:
        return cube
    flags = spark.read.format("npycube").option("days", days).load(quality).withColumnRenamed("raw", "quality")
    return cube.join(flags, ["t", "h", "w"], "left")


def write(voxels: DataFrame, path: str, shape: tuple[int, int, int], column: str = "value", days: int = 16, side: int = 512) -> None:
    """A cube (t, h, w, column) as blocks of files with a manifest, in place of one that is there; missing cells become NaN.

    Each block is one task's, and a task holds one block at a time. A run that fails leaves what was there before.
    """
    register(voxels.sparkSession)
    block = [F.floor(F.col(c) / n).alias(f"_{c}") for c, n in zip(AXES, (days, side, side), strict=True)]
    rows = voxels.select(*[F.col(c).cast("int").alias(c) for c in AXES], F.col(column).cast("double").alias("raw"), *block)
    keys = [f"_{c}" for c in AXES]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys).drop(*keys)
    how = {"shape": ",".join(map(str, shape)), "days": days, "side": side}
    dealt.write.format("npycube").options(**how).mode("overwrite").save(path)
