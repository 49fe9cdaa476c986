"""Best-fit packing through the configuration linear program over the length histogram.

A configuration is a multiset of piece lengths that fits a sequence. The program asks for the fewest configurations
that cover every length's count; multiplicative weights solve it, pricing configurations by a knapsack dynamic
program, and its solution is rounded and completed by knapsack patterns on what is left. All of this works on the
histogram, at most ``room`` numbers however large the corpus; pieces then find their places by their rank among the
pieces of equal length.
"""

from __future__ import annotations

import base64
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..shipping import ship
from .common import flat_rows, table, whole_text, written

#: The tokens of a sequence and the id that ends a document.
ROOM, END = 1024, 2
#: Letters that both tokenizer libraries class alike; other texts go to the slower one.
PLAIN_BELOW, SPECIAL = 0x250, "<|endoftext|>"


class Encoder:
    """Token ids of a byte-level BPE vocabulary, as the tokenizers library gives them.

    Texts of Latin letters and ASCII, without special tokens' strings, take tiktoken's quicker encoder over the same
    vocabulary, which gives the same ids; all others take the tokenizers library itself.
    """

    def __init__(self, name: str = "byte_bpe_50k") -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.quick = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.full = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))

    def ids(self, text: str) -> np.ndarray:
        if SPECIAL not in text and (text.isascii() or ord(max(text)) < PLAIN_BELOW):
            return self.quick.encode_to_numpy(text)
        return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


PIECE = [("piece", IntegerType()), ("start", LongType()), ("length", LongType()), ("ids_crc32", LongType())]


def pieces(docs: DataFrame, name: str = "byte_bpe_50k", room: int = ROOM, end: int = END) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): a document's ids and the end id, cut only where over ``room``.

    All but the first piece of a cut document are full. Null and empty texts are the end id alone. Repeated rows are
    separate documents; an empty table has no pieces.
    """
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *(StructField(n, t) for n, t in PIECE)])

    def make():
        encoder = Encoder(name)

        def each(key, text):
            ids = np.append(encoder.ids(text), np.uint32(end)).astype("<u4")
            first = (len(ids) - 1) % room + 1
            cuts = [0, *range(first, len(ids) + 1, room)]
            return [(key, n, a, b - a, zlib.crc32(ids[a:b].tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]

        return each

    return flat_rows(docs.select("doc_id", whole_text()), make, schema)


def best_pattern(lengths: np.ndarray, prices: np.ndarray, counts: np.ndarray, room: int) -> dict[int, int]:
    """The configuration of the highest price, as length -> copies, by the unbounded knapsack dynamic program.

    Copies beyond a length's count are struck out; their space goes to the longest other lengths that fit.
    """
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    upto = np.searchsorted(lengths, np.arange(room + 1), "right").tolist()
    for c in range(1, room + 1):
        best[c], pick[c] = best[c - 1], -1
        if n := upto[c]:
            worth = best[c - lengths[:n]] + prices[:n]
            k = int(worth.argmax())
            if worth[k] > best[c] + 1e-12:
                best[c], pick[c] = worth[k], k
    chosen: dict[int, int] = {}
    c = room
    while c > 0:
        k = int(pick[c])
        if k < 0:
            c -= 1
            continue
        chosen[k] = chosen.get(k, 0) + 1
        c -= int(lengths[k])
    chosen = {k: min(n, int(counts[k])) for k, n in chosen.items()}
    free = room - sum(int(lengths[k]) * n for k, n in chosen.items())
    while True:  # at most one round for each copy placed
        fits = np.flatnonzero(lengths <= free)
        fits = [k for k in fits[::-1] if counts[k] > chosen.get(int(k), 0)]
        if not fits:
            break
        k = int(fits[0])
        n = min(free // int(lengths[k]), int(counts[k]) - chosen.get(k, 0))
        chosen[k] = chosen.get(k, 0) + n
        free -= int(lengths[k]) * n
    return {int(lengths[k]): n for k, n in chosen.items() if n}


@dataclass
class Plan:
    """Patterns with their number of sequences; ``rounds`` of the program and the sequences that it ``solved``, rounded."""

    patterns: list[tuple[dict[int, int], int]] = field(default_factory=list)
    room: int = ROOM
    rounds: int = 0
    solved: int = 0

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.patterns)

    def places(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """length -> (first ranks, first sequences, offsets), one entry a slot of a pattern."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        used: dict[int, int] = {}
        base = 0
        for pattern, n in self.patterns:
            at = 0
            for length, copies in sorted(pattern.items(), reverse=True):
                for _ in range(copies):
                    found.setdefault(length, []).append((used.get(length, 0), base, at))
                    used[length] = used.get(length, 0) + n
                    at += length
            base += n
        return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in found.items()}


def solve(histogram: dict[int, int], room: int = ROOM, share: float = 0.5, eta: float = 2.0, lean: float = 1.3) -> Plan:
    """Patterns whose copies hold every piece of the histogram exactly once.

    Fractional part: each round prices lengths by length ** lean times exp(-eta x the part of them covered so far), so that
    short pieces are left for the gaps of later patterns, takes the best configuration, and raises its amount until its scarcest length gains ``share`` of its count. Lengths
    covered wholly leave; rounds end when all have, after at most their number over ``share``. Rounding: whole copies
    first, then, by the fraction left, one more of each pattern whose pieces are all still there. What remains is
    completed by knapsack patterns in whole steps, priced by length to the power 1.02, so that long pieces go first.
    """
    plan = Plan(room=room)
    left = {k: n for k, n in histogram.items() if n > 0}
    if whole := left.pop(room, 0):
        plan.patterns.append(({room: 1}, whole))
    lengths = np.array(sorted(left), dtype=np.int64)
    counts = np.array([left[int(k)] for k in lengths], dtype=np.int64)
    place = {int(k): i for i, k in enumerate(lengths)}
    covered, amounts = np.zeros(len(lengths)), {}
    while len(live := np.flatnonzero(covered < 1 - 1e-9)):
        need = counts[live] * (1 - covered[live])
        pattern = best_pattern(lengths[live], lengths[live] ** lean * np.exp(-eta * covered[live]), np.ceil(need), room)
        key = tuple(sorted(pattern.items()))
        at, copies = np.array([place[k] for k, _ in key]), np.array([n for _, n in key])
        step = (np.minimum(share, 1 - covered[at]) * counts[at] / copies).min()
        covered[at] += copies * step / counts[at]
        amounts[key] = amounts.get(key, 0.0) + step
        plan.rounds += 1
    rest = counts.copy()

    def take(pattern: dict[int, int], n: int) -> None:
        plan.patterns.append((pattern, n))
        for k, copies in pattern.items():
            rest[place[k]] -= n * copies

    for key, amount in amounts.items():
        if n := int(amount + 1e-9):
            take(dict(key), n)
    for key, _ in sorted(amounts.items(), key=lambda x: (-(x[1] % 1.0), x[0])):
        if all(rest[place[k]] >= copies for k, copies in key):
            take(dict(key), 1)
    plan.solved = plan.sequences
    while rest.any():
        live = np.flatnonzero(rest)
        pattern = best_pattern(lengths[live], lengths[live].astype(float) ** 1.02, rest[live], room)
        take(pattern, min(int(rest[place[k]]) // copies for k, copies in pattern.items()))
    return plan


def pack(cut: DataFrame, room: int = ROOM, group: int = 512) -> DataFrame:
    """The stored pieces with sequence_id and offset.

    Ranks of equal lengths are counted in groups of about ``group`` rows by hash, whose sizes are summed up first:
    a length that very many pieces share is never ranked in one task.
    """
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most room rows
    plan = solve(counts, room)
    size = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, -(-n // group))]) if counts else F.create_map(F.lit(0).cast("long"), F.lit(1))
    keyed = cut.withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.element_at(size, F.col("length"))))
    cells = keyed.groupBy("length", "cell").agg(F.count("*").alias("n"))
    above = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = written(cells.select("length", "cell", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("above")), "cells")
    own = F.row_number().over(Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "ids_crc32", "start"))
    ranked = keyed.withColumn("own", own - 1).join(cells, ["length", "cell"]).withColumn("rank", F.col("own") + F.col("above"))
    spots = ship(cut.sparkSession).sparkContext.broadcast(plan.places())  # a row for each slot of each pattern: bounded by room and rounds

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        out = np.zeros((len(length), 2), np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        for k in np.unique(lengths):
            at = np.flatnonzero(lengths == k)
            firsts, sequences, offsets = spots.value[int(k)]
            slot = np.searchsorted(firsts, ranks[at], "right") - 1
            out[at, 0], out[at, 1] = sequences[slot] + ranks[at] - firsts[slot], offsets[slot]
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    found = ranked.withColumn("spot", place("length", "rank"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "spot.sequence_id", "spot.offset")


def packed(docs: DataFrame) -> DataFrame:
    """The pieces of the documents with their sequence and offset."""
    return pack(written(pieces(docs), "pieces"))


def op2(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
