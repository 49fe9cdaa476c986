"""Fitting of the head over graphs' vectors: two dense transforms with a gelu between, by Adam over mini-batches.

The gradient of this head has a closed form, so a step is one aggregate: each row gives its share of every derivative
as a vector, and Spark adds the vectors up as a tree. Vectors are stored by batch, so a step reads its batch alone.
Parameters, moments and history are written after every epoch, and a run that finds them goes on from there.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.attention import affine, gelu

STATE = "name string, shape array<int>, values array<double>"
HISTORY = "epoch int, train_loss double, val_loss double"
#: Adam's decays, the bound of the gradient's norm and the share of the parameters added to it.
FIRST, SECOND, CLIP, DECAY = 0.9, 0.999, 1.0, 1e-5


@dataclass
class State:
    """Parameters by name, Adam's moments and steps, the history, and the best parameters so far."""

    params: dict[str, np.ndarray]
    first: dict[str, np.ndarray] = field(default_factory=dict)
    second: dict[str, np.ndarray] = field(default_factory=dict)
    steps: int = 0
    history: list[tuple[int, float, float]] = field(default_factory=list)
    best: dict[str, np.ndarray] = field(default_factory=dict)


def start(width: int, hidden: int, center: np.ndarray, spread: np.ndarray, seed: int = 0) -> State:
    """Seeded weights; inputs are centred and scaled by the training rows' means and deviations."""
    rng, bound = np.random.default_rng(seed), np.sqrt(6 / (width + hidden))
    params = {"w1": rng.uniform(-bound, bound, (width, hidden)), "b1": np.zeros(hidden), "w2": rng.uniform(-bound, bound, hidden), "b2": np.zeros(1)}
    return State(params | {"center": center, "spread": spread})


#: Names of what is fitted, in the order of the gradient's vector; the rest only describe the inputs.
FITTED = ("w1", "b1", "w2", "b2")


def standard(x: Column, params: dict) -> Column:
    center, spread = (F.array(*[F.lit(float(v)) for v in params[c]]) for c in ("center", "spread"))
    return F.zip_with(F.zip_with(x, center, lambda a, b: a - b), spread, lambda a, b: a / b)


def hidden_of(x: Column, params: dict) -> list[Column]:
    return affine(x, params["w1"].tolist(), params["b1"].tolist())


def gelu_slope(z: Column) -> Column:
    inner = 0.7978845608028654 * (z + 0.044715 * z * z * z)
    t = F.tanh(inner)
    return 0.5 * (1 + t) + 0.5 * z * (1 - t * t) * 0.7978845608028654 * (1 + 3 * 0.044715 * z * z)


def predicted(vectors: DataFrame, params: dict) -> DataFrame:
    """Adds estimate to rows with x."""
    held = vectors.withColumn("_x", standard(F.col("x"), params)).withColumn("_a", F.array(*[gelu(z) for z in hidden_of(F.col("_x"), params)]))
    out = sum((F.col("_a")[j] * F.lit(float(w)) for j, w in enumerate(params["w2"])), F.lit(float(params["b2"][0])))
    return held.withColumn("estimate", out).drop("_x", "_a")


def summed(vectors: DataFrame, *metrics: str):
    """One row of the metrics of v over all rows, each task's share first; None without rows."""
    by = vectors.withColumn("all", F.lit(0)).groupBy("all").agg(Summarizer.metrics(*metrics).summary(F.col("v")).alias("s"))
    return by.select("s.*").first()


def gradient(rows: DataFrame, params: dict) -> tuple[dict[str, np.ndarray], float, int]:
    """The mean gradient of half the squared error, the mean squared error and the number of rows (x, target); one row comes to the driver."""
    held = rows.withColumn("x", standard(F.col("x"), params)).withColumn("z", F.array(*hidden_of(F.col("x"), params)))
    held = held.withColumn("a", F.transform("z", gelu)).withColumn("slope", F.transform("z", gelu_slope))
    w2 = F.array(*[F.lit(float(w)) for w in params["w2"]])
    dot = F.aggregate(F.zip_with("a", w2, lambda p, q: p * q), F.lit(float(params["b2"][0])), lambda s, v: s + v)
    held = held.withColumn("error", dot - F.col("target"))
    held = held.withColumn("back", F.zip_with("slope", w2, lambda s, w: F.col("error") * s * w))
    outer = F.flatten(F.transform("x", lambda v: F.transform("back", lambda d: v * d)))
    error = F.array(F.col("error"))
    whole = F.concat(outer, F.col("back"), F.transform("a", lambda v: v * F.col("error")), error, F.array(F.col("error") * F.col("error")))
    found = summed(held.select(array_to_vector(whole).alias("v")), "sum", "count")
    if found is None:
        return {k: np.zeros_like(params[k]) for k in FITTED}, 0.0, 0
    n = int(found["count"])
    values = found["sum"].toArray() / n
    cuts = np.cumsum([params[k].size for k in FITTED])
    parts = np.split(values[: cuts[-1]], cuts[:-1])
    return {k: p.reshape(params[k].shape) for k, p in zip(FITTED, parts, strict=True)}, float(values[-1]), n


def step(state: State, grads: dict[str, np.ndarray], rate: float) -> None:
    """One step of Adam with the gradient's norm bounded."""
    state.steps += 1
    norm = np.sqrt(sum((g**2).sum() for g in grads.values()))
    for k in FITTED:
        g = grads[k] * min(1.0, CLIP / max(norm, 1e-12)) + DECAY * state.params[k]
        state.first[k] = FIRST * state.first.get(k, 0.0) + (1 - FIRST) * g
        state.second[k] = SECOND * state.second.get(k, 0.0) + (1 - SECOND) * g * g
        moved = state.first[k] / (1 - FIRST**state.steps) / (np.sqrt(state.second[k] / (1 - SECOND**state.steps)) + 1e-8)
        state.params[k] = state.params[k] - rate * moved


def save(spark: SparkSession, state: State, folder: str) -> None:
    """The whole state of an epoch as one table, under the epoch's number."""
    named = {f"{kind}.{k}": v for kind, held in (("params", state.params), ("first", state.first), ("second", state.second), ("best", state.best)) for k, v in held.items()}
    named |= {"steps": np.array([state.steps]), "history": np.array(state.history)}
    rows = [(k, list(v.shape), [float(x) for x in v.ravel()]) for k, v in sorted(named.items())]
    spark.createDataFrame(rows, STATE).coalesce(1).write.mode("overwrite").parquet(f"{folder}/epoch={state.history[-1][0]}")


def load(spark: SparkSession, folder: str) -> State | None:
    """The last epoch's state that was written whole; None where there is none."""
    try:
        table = spark.read.schema(f"{STATE}, epoch int").parquet(folder)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    # a file appears when its write has finished, and an epoch is one file
    last = table.agg(F.max("epoch")).first()[0]
    if last is None:
        return None
    held = {r["name"]: np.array(r["values"]).reshape(r["shape"]) for r in table.where(F.col("epoch") == last).collect()}
    of = lambda kind: {k.split(".", 1)[1]: v for k, v in held.items() if k.startswith(f"{kind}.")}
    history = [(int(e), float(a), float(b)) for e, a, b in held["history"]]
    return State(of("params"), of("first"), of("second"), int(held["steps"][0]), history, of("best"))


def store(vectors: DataFrame, path: str, batches: int) -> None:
    """Rows (graph_id, x, target, part) as files by part and batch; a batch is a fixed share of the rows by hash."""
    held = vectors.where(F.col("target").isNotNull()).withColumn("batch", F.when(F.col("part") == "train", F.pmod(F.xxhash64("graph_id"), F.lit(batches))).otherwise(F.lit(0)).cast("int"))
    held.write.mode("overwrite").partitionBy("part", "batch").parquet(path)


def train(spark: SparkSession, path: str, checkpoints: str, hidden: int = 16, epochs: int = 20, rate: float = 5e-3, patience: int = 5, batches: int = 1, seed: int = 0, now: int | None = None) -> tuple[dict, DataFrame]:
    """(best parameters, history) of the rows that ``store`` wrote, going on from ``checkpoints`` where they are.

    An epoch takes a step for each batch, in an order drawn from seed and epoch; the rate falls along a cosine; training
    ends after ``patience`` epochs without a better validation loss. ``now`` bounds the epochs of this call alone.
    """
    rows = spark.read.parquet(path)
    state = load(spark, checkpoints)
    if state is None:
        held = summed(rows.where("part = 'train'").select(array_to_vector("x").alias("v")), "mean", "std")
        if held is None:
            raise ValueError(f"{path} holds no training row with a target")
        center, spread = held["mean"].toArray(), held["std"].toArray()
        state = start(len(center), hidden, center, np.where(spread > 1e-9, spread, 1.0), seed)
    done = 0
    for epoch in range(len(state.history), epochs):
        best = min(state.history, key=lambda h: (h[2], h[0]), default=None)
        if (best and epoch - 1 - best[0] >= patience) or done == now:
            break
        loss = seen = 0.0
        for n, batch in enumerate(np.random.default_rng((seed, epoch)).permutation(batches).tolist()):
            share = rows.where((F.col("part") == "train") & (F.col("batch") == batch))  # one folder
            grads, mean, count = gradient(share.select("x", "target"), state.params)
            if count:
                step(state, grads, rate * 0.5 * (1 + np.cos(np.pi * (epoch + n / batches) / epochs)))
            loss, seen = loss + mean * count, seen + count
        scored = predicted(rows.where("part = 'val'"), state.params)
        val = scored.agg(F.avg((F.col("estimate") - F.col("target")) ** 2)).first()[0]
        val = float("inf") if val is None else float(val)
        if best is None or val < best[2]:
            state.best = dict(state.params)
        state.history.append((epoch, loss / max(1.0, seen), val))
        save(spark, state, checkpoints)
        done += 1
    return state.best or state.params, spark.createDataFrame(state.history, HISTORY)


def to_table(spark: SparkSession, params: dict[str, np.ndarray]) -> DataFrame:
    """A model: one row a parameter."""
    return spark.createDataFrame([(k, list(v.shape), [float(x) for x in v.ravel()]) for k, v in sorted(params.items())], STATE)


def from_table(table: DataFrame) -> dict[str, np.ndarray]:
    return {r["name"]: np.array(r["values"]).reshape(r["shape"]) for r in table.collect()}
