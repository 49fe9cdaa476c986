"""Passages that repeat across documents, found by collinear chaining.

Winnowed k-mers of words are the seeds: any shared run of ``k + window - 1`` words shares one. A seed found in several
documents is joined to its first document, so a passage of many documents costs one anchor a document, not one a pair.
Anchors of two documents are chained in order, with linear gap costs, through a Fenwick tree of prefix maxima; chains
are aligned word by word across their gaps and beyond their ends.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from ..shipping import ship
from .common import WORD, flat_rows, map_rows, remove, stored, table, whole_text, written


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(27))


def kmers(words: list[bytes], k: int) -> np.ndarray:
    """The hashes of all runs of k words."""
    n = len(words) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    single = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    rolled = np.zeros(n, np.uint64)
    for i in range(k):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + single[i : i + n]
    return mixed(rolled)


def winnow(text: str, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the smallest k-mer of every window; all of a text of fewer k-mers than a window count as one."""
    hashes = kmers(text.encode("utf-8", "surrogatepass").split(), k)
    n = len(hashes)
    if n < 1:
        return hashes, np.empty(0, np.int32)
    window, best, size = min(window, n), np.arange(n), 1
    while size < window:  # the first smallest of runs of up to twice as many k-mers
        step = min(size, window - size)
        left, right = best[:-step], best[step:]
        best, size = np.where(hashes[left] <= hashes[right], left, right), size + step
    places = best[np.r_[True, best[1:] != best[:-1]]]  # they never fall from window to window
    return hashes[places], places.astype(np.int32)


def with_repeats_marked(hashes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The places, as -1 - place where the hash has come before."""
    firsts = np.unique(hashes, return_index=True)[1]
    marked = -1 - places
    marked[firsts] = places[firsts]
    return marked


def seeds(docs: DataFrame, k: int, window: int) -> DataFrame:
    """Rows (hash, doc_id, pos): pos is -1 - place where the text has the same k-mer earlier on."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [winnow(t, k, window) for t in part.column(1).to_pylist()]
                sizes = [len(p) for _, p in found]
                columns = [np.concatenate([h for h, _ in found]).view(np.int64), np.repeat(part.column(0).to_numpy(), sizes), np.concatenate([with_repeats_marked(h, p) for h, p in found])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["hash", "doc_id", "pos"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), whole_text()).mapInArrow(run, "hash long, doc_id long, pos int")


def chains(anchors: list[tuple[int, int]], k: int, gap: float) -> list[list[tuple[int, int]]]:
    """Disjoint chains of anchors (pos, other_pos), both rising, best first.

    An anchor scores its k words; a step costs ``gap`` for each word that it moves in either text beyond k. The best
    predecessor is a prefix maximum over the other text's places, kept in a Fenwick tree while pos rises.
    """
    anchors = sorted(set(anchors))
    straight = all(x < z and y < w for (x, y), (z, w) in zip(anchors, anchors[1:], strict=False))  # the one before is the best, as its value is the highest
    ranks = {} if straight else {p: i + 1 for i, p in enumerate(sorted({b for _, b in anchors}))}
    size = len(ranks)
    tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (size + 1)
    score, back = [0.0] * len(anchors), [-1] * len(anchors)
    waiting: list[int] = []
    for n, (a, b) in enumerate(anchors):
        while not straight and waiting and anchors[waiting[0]][0] < a:  # anchors of one pos can't follow one another
            m = waiting.pop(0)
            value = (score[m] + gap * sum(anchors[m]), m)
            i = ranks[anchors[m][1]]
            while i <= size:
                if tree[i] < value:
                    tree[i] = value
                i += i & -i
        best, i = (float("-inf"), -1), 0 if straight else ranks[b] - 1
        if straight and n:
            best = (score[n - 1] + gap * sum(anchors[n - 1]), n - 1)
        while i > 0:
            if tree[i] > best:
                best = tree[i]
            i -= i & -i
        gain = best[0] - gap * (a + b - 2 * k)
        score[n] = k
        if best[1] >= 0 and gain > 0:
            step = min(a - anchors[best[1]][0], b - anchors[best[1]][1], k)  # overlapping anchors count their new words
            score[n], back[n] = gain + step, best[1]
        if not straight:
            waiting.append(n)
    found, used = [], [False] * len(anchors)
    for n in sorted(range(len(anchors)), key=lambda i: (-score[i], i)):
        chain = []
        while n >= 0 and not used[n]:
            used[n] = True
            chain.append(anchors[n])
            n = back[n]
        if chain:
            found.append(chain[::-1])
    return found


def same_words(a: list[str], b: list[str]) -> int:
    """The most words that two stretches share in order. A row of the dynamic program is one integer: bit j is 0 where word j adds one."""
    if a == b:
        return len(a)
    places: dict[str, int] = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    full = row = (1 << len(b)) - 1
    for x in a:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def stretch(a: list[str], b: list[str], drop: int = 4) -> tuple[int, int]:
    """How far, and over how many equal words, two stretches match from their starts on: gains 1, losses 2, until ``drop`` below the best."""
    score = best = reach = same = hits = 0
    for n, (x, y) in enumerate(zip(a, b, strict=False), 1):
        score += 1 if x == y else -2
        hits += x == y
        if score > best:
            best, reach, same = score, n, hits
        elif score < best - drop:
            break
    return reach, same


def align(
    chain: list[tuple[int, int]], own: list[str], other: list[str], at: int, other_at: int, k: int, least: int, identity: float, pad: int
) -> list[tuple[int, int, int, int, int, bool, bool]]:
    """Start and end in both texts and the equal words of a chain's passages, given the words around it from places at and other_at on.

    The last two say whether the words given ran out before the match did, on the left and on the right.

    A gap whose words match too little ends a passage, so long passages on either side of other text are both found. Its
    loss must be above what two parts of ``least`` words make up for: shorter parts never pass once such a gap is between.
    """
    spare = 2 * least * (1 - identity) / identity
    parts: list[list[list[int]]] = []  # blocks of starts, ends, equal words before and equal words with it
    for x, y in ((p - at, q - other_at) for p, q in chain):
        if parts:
            last = parts[-1][-1]
            a, b = last[2:4]
            if x < a or y < b:  # overlaps the words matched so far
                fresh = min(x + k - a, y + k - b)
                if x - a == y - b and fresh > 0:
                    last[2:] = [a + fresh, b + fresh, last[4], last[5] + fresh]
                continue
            gap, allowed = max(x - a, y - b), max(spare, (1 - identity) * max(x - a, y - b))
            if gap - min(x - a, y - b) <= allowed and gap - (same := same_words(own[a:x], other[b:y])) <= allowed:
                parts[-1].append([x, y, x + k, y + k, last[5] + same, last[5] + same + k])
                continue
        parts.append([[x, y, x + k, y + k, 0, k]])
    found, waiting = [], [(part, True) for part in reversed(parts)]
    while waiting:
        part, whole = waiting.pop()
        (a0, b0, *_, before, _), (_, _, a, b, _, same) = part[0], part[-1]
        same -= before
        left, left_same = stretch(own[:a0][::-1], other[:b0][::-1])
        right, right_same = stretch(own[a:], other[b:])
        goes_on = goes(own[:a0][::-1], other[:b0][::-1], left, pad), goes(own[a:], other[b:], right, pad)
        a0, b0, a, b, same = a0 - left, b0 - left, a + right, b + right, same + left_same + right_same
        found.append((a0 + at, a + at, b0 + other_at, b + other_at, same, *goes_on))
        if whole and same < identity * max(a - a0, b - b0):
            waiting += [(some, False) for some in similar(part, least, identity)]
    return found


def similar(part: list[list[int]], least: int, identity: float) -> list[list[list[int]]]:
    """The longest stretch of a part's blocks that is similar enough over ``least`` words, and those on its either side."""
    found, waiting = [], [part]
    while waiting:
        some = waiting.pop()
        x, y, a, b, before, same = np.array(some).T
        best, span = 0, None
        for i in range(len(some)):
            if max(a[-1] - x[i], b[-1] - y[i]) <= best:
                break
            long, short = np.maximum(a[i:] - x[i], b[i:] - y[i]), np.minimum(a[i:] - x[i], b[i:] - y[i])
            fit = np.flatnonzero((short + 30 >= least) & (same[i:] - before[i] >= identity * long))  # ends may match for some words more
            if len(fit) and long[fit[-1]] > best:
                best, span = long[fit[-1]], (i, i + int(fit[-1]) + 1)
        if span:
            found.append(some[span[0] : span[1]])
            waiting += [rest for rest in (some[: span[0]], some[span[1] :]) if rest]
    return found


def goes(a: list[str], b: list[str], reach: int, given: int, various: int = 32) -> bool:
    """Whether two stretches of ``given`` words match up to where they end, in words that are not the same few over and over.

    The end of a text gives fewer. Texts that repeat a word, or a line of under ``various`` different words, would match one
    another at every place; there a passage ends.
    """
    n = min(len(a), len(b))
    return given <= n <= reach + 2 and len(set(a[:n])) >= various


ANCHOR = ArrayType(StructType([StructField("pos", IntegerType()), StructField("other_pos", IntegerType())]))
CHAINS = StructType([StructField("doc_id", LongType()), StructField("n", IntegerType()), StructField("other_id", LongType()), *[StructField(c, ArrayType(IntegerType())) for c in ("pos", "other_pos")]])


def pairs(docs: DataFrame, k: int = 5, window: int = 16, gap: float = 0.1, pad: int = 64, least: int = 50, identity: float = 0.8) -> DataFrame:
    """Rows (doc_id, start, end, other_id, other_start, other_end, identity): places in words, ends exclusive.

    Each passage of at least ``least`` words that ``doc_id`` shares with the first document to hold its seeds, or to hold
    those runs of ``least`` words that no such passage covers; where seeds stay uncovered, with every document that holds them. Null
    and empty texts hold none; rows with a null id are left out; repeated rows of one id count as one document. Texts
    are read whole: a copy of a document is one passage over all of it, matched with the smallest id of that text, which
    meets all others for its copies. Other columns are not read.
    """
    same = written(copies(docs), "copies")
    once_each = docs.select(F.col("doc_id").cast("long"), "text").join(same.select("doc_id"), "doc_id", "left_anti")
    found, seeds_path = stored(seeds(once_each, k, window), "seeds")
    shared = found.where("pos >= 0").groupBy("hash").agg(F.min("doc_id").alias("other_id"), F.max("doc_id").alias("last"), F.min_by("pos", "doc_id").alias("other_pos"))
    shared, shared_path = stored(shared.where("other_id < last").drop("last"), "shared")
    place = F.when(F.col("pos") < 0, -1 - F.col("pos")).otherwise(F.col("pos")).alias("pos")
    met = found.join(shared, "hash").select("hash", "doc_id", "other_id", place, "other_pos")
    held = written(arrays(met, ["hash", "pos", "other_id", "other_pos"]), "held")
    remove(docs.sparkSession, seeds_path, shared_path)  # nothing reads them any more
    once = written(aligned(docs, chained(held, k, gap), k, pad, least, identity), "once")
    runs = written(runs_left(docs, held, once, k, window, least), "runs")
    first = runs.where("pos >= 0").groupBy("hash").agg(F.min("doc_id").alias("other_id"), F.max("doc_id").alias("last"), F.min_by("pos", "doc_id").alias("other_pos"), F.min_by("own", "doc_id").alias("first_own"))
    met = runs.join(first.where("other_id < last"), "hash").where("doc_id <> other_id and (own or first_own and doc_id = last)")
    again = arrays(met.select("doc_id", "other_id", place, "other_pos"), ["pos", "other_id", "other_pos"])
    twice = written(once.union(aligned(docs, chained(again, k, gap, single=True), k, pad, least, identity)).distinct(), "twice")
    every = twice.union(aligned(docs, rest_left(held, twice, k, window, least, identity, gap), k, pad, least, identity)).distinct()
    sizes = docs.select(F.col("doc_id").cast("long").alias("other_id"), whole_text().alias("text")).join(same.select("other_id").distinct(), "other_id")
    sizes = sizes.select("other_id", F.regexp_count("text", F.lit(WORD)).alias("end")).where(F.col("end") >= least).distinct()
    zero = F.lit(0)
    return every.union(same.join(sizes, "other_id").select("doc_id", zero.alias("start"), "end", "other_id", zero.alias("other_start"), F.col("end").alias("other_end"), F.lit(1.0).alias("identity")))


def copies(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, other_id): documents of one text that equals the whole text of smaller ids, and the smallest of these."""
    keyed = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.unhex(F.sha2(whole_text().cast("binary"), 256)).alias("key"))
    one = written(keyed.groupBy("doc_id").agg(F.min("key").alias("key"), F.max("key").alias("most")).where("key = most").drop("most"), "texts")
    first = one.groupBy("key").agg(F.min("doc_id").alias("other_id"), F.max("doc_id").alias("last")).where("other_id < last")
    return one.join(first, "key").where("doc_id <> other_id").select("doc_id", "other_id")


def arrays(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of each document as one array a column, in one order; they are bounded by the text."""
    some = rows.groupBy("doc_id").agg(F.collect_list(F.struct(*columns)).alias("rows"))
    return some.select("doc_id", *[F.col(f"rows.{c}").alias(c) for c in columns])


def covered_spans(found: DataFrame) -> DataFrame:
    """Rows (doc_id, start, end) with arrays of the passages' places in either text."""
    mirrored = found.select(F.col("other_id").alias("doc_id"), F.col("other_start").alias("start"), F.col("other_end").alias("end"))
    return arrays(found.select("doc_id", "start", "end").union(mirrored).distinct(), ["start", "end"])


def of_hashes(held: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (doc_id, hot): the wanted hashes that a document holds."""
    return held.select("doc_id", F.explode("hash").alias("hash")).join(wanted, "hash", "left_semi").groupBy("doc_id").agg(F.collect_set("hash").alias("hot"))


def rest_left(held: DataFrame, found: DataFrame, k: int, window: int, least: int, identity: float, gap: float) -> DataFrame:
    """Chains, as of ``chained``, of the seeds that no passage covers in some document, with every holder.

    Passages of changed words whose seeds have first holders elsewhere hold such seeds. In both texts a seed must lie
    among shared ones that a passage of ``least`` words can hold, and so must the anchors of each two documents. A line
    that many documents hold is no passage, so holders of one seed don't meet: two documents meet where both hold the
    same two seeds, one after the other, about as far apart as a passage of theirs must reach. They come as
    one row for each two documents that hold some two seeds, and only those are compared seed by seed.
    """
    spans = covered_spans(found)
    outer = least - k - 2 * (window - 1)
    reach = outer - 1 + 3 * window + int(2 * least * (1 - identity) / identity)  # to the next seed, and words that one text has more
    inside = lambda places: [f for f in long_stretches(places, k, 3 * window, 0) if f[-1] - f[0] >= outer]

    def make_open():
        def each(hashes, places, start, end):
            near = [p for f in inside(places) for p in f]
            free = set(uncovered(near, list(zip(start or [], end or [], strict=True)), k))
            return [(h,) for h in {h for h, p in zip(hashes, places, strict=True) if p in free}]

        return each

    seen = held.select("doc_id", "hash", "pos").join(spans, "doc_id", "left")
    hot = flat_rows(seen.select("hash", "pos", "start", "end"), make_open, StructType([StructField("hash", LongType())]))
    hot = written(hot.distinct(), "hot")

    def make_places():
        def each(key, hashes, places, start, end, hot):
            hashes = dict(zip(places, hashes, strict=True))
            near, hot = inside(places), set(hot)
            free = set(uncovered([p for f in near for p in f], list(zip(start or [], end or [], strict=True)), k))
            met = {pair: pair[0] in own or pair[1] in own for f in near for own in [{hashes[p] for p in f if p in free}] for pair in far_pairs(f, hashes, hot, outer, reach)}
            kept = [p for f in near for p in f if hashes[p] in hot]
            joint = [hash(pair) for pair in met]
            return [(key, [hashes[p] for p in kept], kept, [p in free for p in kept], joint, list(met.values()))]

        return each

    kinds = [("doc_id", LongType()), ("hash", ArrayType(LongType())), ("pos", ArrayType(IntegerType())), ("open", ArrayType(BooleanType())), ("joint", ArrayType(LongType())), ("asks", ArrayType(BooleanType()))]
    near = seen.join(of_hashes(held, hot), "doc_id").select("doc_id", "hash", "pos", "start", "end", "hot")
    places = written(flat_rows(near, make_places, StructType([StructField(n, t) for n, t in kinds])), "places")
    joint = written(places.select("doc_id", F.explode(F.arrays_zip("joint", "asks")).alias("x")).select("doc_id", "x.joint", "x.asks").distinct(), "joint")
    asked = joint.where("asks").select("joint", F.col("doc_id").alias("other_id"))
    two = joint.join(asked, "joint").where("doc_id <> other_id").select(F.greatest("doc_id", "other_id").alias("doc_id"), F.least("doc_id", "other_id").alias("other_id")).distinct()
    two = written(two, "two")

    def make():
        def each(key, other, hashes, places, free, other_hashes, other_places, other_free):
            first: dict[int, int] = {}
            other_first: dict[int, int] = {}
            for least_of, hs, ps in ((first, hashes, places), (other_first, other_hashes, other_places)):
                for h, p in zip(hs, ps, strict=True):
                    least_of[h] = min(p, least_of.get(h, p))
            anchors = {(p, other_first[h]) for h, p, o in zip(hashes, places, free, strict=True) if o and h in other_first}
            anchors |= {(first[h], p) for h, p, o in zip(other_hashes, other_places, other_free, strict=True) if o and h in first}
            if not all(max(x) - min(x) >= outer for x in zip(*anchors, strict=True)):
                return []
            found = [c for c in chains(list(anchors), k, gap) if len(c) > 1]
            return [(key, n, other, [p for p, _ in c], [p for _, p in c]) for n, c in enumerate(found)]

        return each

    own = places.select("doc_id", "hash", "pos", "open")
    others = places.select(F.col("doc_id").alias("other_id"), *[F.col(c).alias(f"other_{c}") for c in ("hash", "pos", "open")])
    both = two.join(own, "doc_id").join(others, "other_id")
    return flat_rows(both.select("doc_id", "other_id", "hash", "pos", "open", "other_hash", "other_pos", "other_open"), make, CHAINS)


def far_pairs(places: list[int], hashes: dict[int, int], hot: set[int], low: int, high: int) -> set[tuple[int, int]]:
    """Pairs of hashes, one of them hot, that some places ``low`` to ``high`` words apart have in this order.

    A hash that comes over and over counts as one run from its first place to its last, so pairs may be too many, never too few.
    """
    runs: list[list[int]] = []
    for p in places:
        if runs and runs[-1][0] == hashes[p]:
            runs[-1][2] = p
        else:
            runs.append([hashes[p], p, p])
    found = set()
    for i, (h, start, end) in enumerate(runs):
        for j in range(i + 1, len(runs)):
            to, begins, ends = runs[j]
            if begins - end > high:
                break
            if ends - start >= low and h != to and (h in hot or to in hot):
                found.add((h, to))
    return found


def long_stretches(places: list[int], k: int, window: int, least: int) -> list[list[int]]:
    """The shared seeds' places that a passage of ``least`` words can hold, one list for each stretch.

    Every window of seeds inside a passage holds a shared one, so a passage's seeds are at most ``window`` apart.
    """
    found: list[list[int]] = []
    for p in sorted(set(places)):
        if found and p - found[-1][-1] <= window:
            found[-1].append(p)
        else:
            found.append([p])
    return [f for f in found if f[-1] - f[0] + k + 2 * (window - 1) >= least]


def uncovered(places: list[int], covered: list[tuple[int, int]], k: int) -> list[int]:
    """The places, rising, whose k words no covered span holds whole."""
    covered, top, at, found = sorted(covered), -1, 0, []
    for p in places:
        while at < len(covered) and covered[at][0] <= p:
            top, at = max(top, covered[at][1]), at + 1
        if p + k > top:
            found.append(p)
    return found


def spread(places: list[int], least: int) -> list[int]:
    """The places, rising, without those whose ``least`` words lie in the words of the kept ones: all cover as much."""
    places, kept = sorted(set(places)), []
    for i, n in enumerate(places):
        if not kept or i == len(places) - 1 or places[i + 1] > kept[-1] + least:
            kept.append(n)
    return kept


def runs_left(docs: DataFrame, held: DataFrame, once: DataFrame, k: int, window: int, least: int) -> DataFrame:
    """Rows (hash, doc_id, pos, own), as of ``seeds``: the runs of ``least`` words that hold a seed which some document has outside its passages.

    ``own``: it is this document. Such rows need a partner; the others only serve as one.

    The first holder of a seed may hold only a part of a passage; the first holder of a whole run holds one. No such run
    is left out, so each passage of equal words is found whoever holds its parts.
    """
    seen = held.select("doc_id", "hash", "pos").join(covered_spans(once), "doc_id", "left")

    def make_open():
        def each(hashes, places, start, end):
            inside = [p for f in long_stretches(places, k, window, least) for p in f]
            free = set(uncovered(inside, list(zip(start or [], end or [], strict=True)), k))
            return [(h,) for h in {h for h, p in zip(hashes, places, strict=True) if p in free}]

        return each

    left = flat_rows(seen.select("hash", "pos", "start", "end"), make_open, StructType([StructField("hash", LongType())]))
    left = written(left.distinct(), "open")

    def make_stretches():
        def each(key, hashes, places, start, end, hot):
            hot, spans = set(hot), list(zip(start or [], end or [], strict=True))
            free = {p for h, p in zip(hashes, places, strict=True) if h in hot}
            found: list[list[int]] = []
            bare: list[int] = []
            for f in long_stretches(places, k, window, least):
                low, high = max(0, f[0] - window + 1), f[-1] + k + window - 1
                bare += uncovered(f, spans, k)
                for p in f:
                    a, b = max(low, p + k - least), min(high, p + least)
                    if p not in free or b - a < least:
                        continue
                    if found and a <= found[-1][1] - least + 1:  # the same runs, or the next
                        found[-1][1] = b
                    else:
                        found.append([a, b])
            return [(key, [{"pos": a, "other_pos": b} for a, b in found], bare)] if found else []

        return each

    flagged = seen.join(of_hashes(held, left), "doc_id").select("doc_id", "hash", "pos", "start", "end", "hot")
    kinds = StructType([StructField("id", LongType()), StructField("stretches", ANCHOR), StructField("bare", ArrayType(IntegerType()))])
    wanted = written(flat_rows(flagged, make_stretches, kinds), "stretches")
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), whole_text().alias("text"))

    def make_runs():
        def each(key, text, stretches, bare):
            words, found = text.encode("utf-8", "surrogatepass").split(), {}
            for s in stretches:
                for n, h in enumerate(kmers(words[s["pos"] : s["other_pos"]], least).view(np.int64).tolist(), s["pos"]):
                    found.setdefault(h, []).append(n)
            holds = lambda n: (i := bisect_left(bare, n)) < len(bare) and bare[i] + k <= n + least
            return [(h, key, n if n == places[0] else -1 - n, own) for h, places in found.items() for own in [any(map(holds, places))] for n in spread(places, least)]

        return each

    kinds = [("hash", LongType()), ("doc_id", LongType()), ("pos", IntegerType()), ("own", BooleanType())]
    return flat_rows(texts.join(wanted, "id").select("id", "text", "stretches", "bare"), make_runs, StructType([StructField(n, t) for n, t in kinds]))


def chained(anchors: DataFrame, k: int, gap: float, single: bool = False) -> DataFrame:
    """Chains (doc_id, n, other_id, pos, other_pos), arrays of places, of a document's anchors; ``single``: of one anchor too."""

    def make():
        def each(key, places, others, other_places):
            groups: dict[int, list[tuple[int, int]]] = {}
            for other, *anchor in zip(others, places, other_places, strict=True):
                if other != key:
                    groups.setdefault(other, []).append(tuple(anchor))
            found = [(other, c) for other, some in sorted(groups.items()) for c in chains(some, k, gap) if single or len(c) > 1]
            return [(key, n, other, [p for p, _ in c], [p for _, p in c]) for n, (other, c) in enumerate(found)]

        return each

    return flat_rows(anchors.select("doc_id", "pos", "other_id", "other_pos"), make, CHAINS)


def words_cut(rows: DataFrame) -> DataFrame:
    """The rows with the words from place ``from`` up to ``to`` of their text, one space apart, in its stead."""
    ship(rows.sparkSession)
    kept = [c for c in rows.columns if c not in ("text", "to")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, words = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, cut = batch.slice(at, 256), []
                for own, start, end in zip(*(part.column(c) for c in ("text", "from", "to")), strict=True):
                    own = own.as_py()
                    if own != text:  # after a merge join the rows of a text follow one another
                        text, words = own, own.split()
                    cut.append(b" ".join(words[start.as_py() : end.as_py()]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(cut, pa.binary())], names=[*kept, "words"])

    return rows.mapInArrow(run, StructType([*(rows.schema[c] for c in kept), StructField("words", BinaryType())]))


def aligned(docs: DataFrame, chains: DataFrame, k: int, pad: int, least: int, identity: float) -> DataFrame:
    """The passages of the rows of ``pairs`` that chains lead to."""
    linked = written(chains, "chains")
    wanted = lambda side, key, pos, *chain: linked.select(
        F.col(key).alias("id"), "doc_id", "other_id", "n", F.lit(side).alias("side"), *[c.alias(n) for n, c in zip(("pos", "other_pos"), chain, strict=True)],
        F.greatest(F.col(pos)[0] - pad, F.lit(0)).alias("from"), (F.element_at(pos, -1) + k + pad).alias("to"),
    )
    none = F.lit(None).cast("array<int>")  # one side is enough
    wants = wanted(0, "doc_id", "pos", F.col("pos"), F.col("other_pos")).union(wanted(1, "other_id", "other_pos", none, none))
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), whole_text().alias("text"))
    sliced = words_cut(wants.join(texts.withColumn("text", F.col("text").cast("binary")), "id").drop("id"))
    both = sliced.groupBy("doc_id", "other_id", "n").agg(F.collect_list(F.struct("side", "from", "words", "pos", "other_pos")).alias("sides"))

    def make_aligned():
        def each(key, other, sides):
            ways = {s["side"]: s for s in sides}
            if len(ways) < 2:
                return []
            mine, theirs = ways[0], ways[1]
            places = list(zip(mine["pos"], mine["other_pos"], strict=True))
            parts = align(places, mine["words"].split(), theirs["words"].split(), mine["from"], theirs["from"], k, least, identity, pad)
            good = lambda a, b, c, d, same: min(b - a, d - c) >= least and same >= identity * max(b - a, d - c)
            return [(key, *p[:2], other, *p[2:]) for p in parts if p[5] or p[6] or good(*p[:5])]

        return each

    kinds = StructType([StructField(n, t) for n, t in (("doc_id", LongType()), *[(c, IntegerType()) for c in ("start", "end")], ("other_id", LongType()), *[(c, IntegerType()) for c in ("other_start", "other_end", "same")], ("left", BooleanType()), ("right", BooleanType()))])
    made = written(flat_rows(both.select("doc_id", "other_id", "sides"), make_aligned, kinds), "aligned")
    full = followed(texts, made.distinct())
    ratio = F.col("same") / F.greatest(F.col("end") - F.col("start"), F.col("other_end") - F.col("other_start"))
    kept = full.withColumn("identity", ratio).where(F.least(F.col("end") - F.col("start"), F.col("other_end") - F.col("other_start")) >= least)
    return kept.where(F.col("identity") >= identity).select("doc_id", "start", "end", "other_id", "other_start", "other_end", "identity")


def followed(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows whose ends went on where their words ran out, followed through the rest of both texts as far as they match.

    Seeds lie all along a match of long equal runs, so only ends of dense edits go on. The join is a merge at every size.
    """
    ends = ["start", "end", "other_start", "other_end"]
    key, open_ = ["doc_id", "other_id", *ends], rows.where("left or right")
    near = lambda side, start, end: [F.lit(side).alias("side"), F.when(F.col("left"), F.col(start)).alias("low"), F.when(F.col("right"), F.col(end)).alias("high")]
    wants = open_.select(F.col("doc_id").alias("id"), *key, *near(0, "start", "end")).union(open_.select(F.col("other_id").alias("id"), *key, *near(1, "other_start", "other_end")))
    held = wants.hint("merge").join(texts, "id").withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    before = F.reverse(F.slice("words", F.lit(1), F.coalesce("low", F.lit(0)))).alias("before")
    after = F.slice("words", F.coalesce("high", F.size("words")) + 1, F.size("words")).alias("after")
    sides = held.select(*key, F.struct("side", before, after).alias("words")).groupBy(*key).agg(F.collect_list("words").alias("sides"))
    both = open_.join(sides, key).select(*rows.columns, "sides")

    def make():
        def each(key, start, end, other, other_start, other_end, same, left, right, sides):
            ways = {s["side"]: (s["before"], s["after"]) for s in sides}  # rows of one id count as one
            (a, b), (c, d) = ways[0], ways[1]
            back, more = stretch(a, c)
            on, again = stretch(b, d)
            return (key, start - back, end + on, other, other_start - back, other_end + on, same + more + again, False, False)

        return each

    return rows.where("not left and not right").union(map_rows(both, make, rows.schema))


def passages(docs: DataFrame, **how) -> DataFrame:
    """One row for each repeated passage of each document, the first document's own included.

    Columns doc_id, start, end, n_words, first_id (the smallest other document that it was matched with), n_matches
    and identity (the highest). Ties and repeated rows as for ``pairs``.
    """
    found = written(pairs(docs, **how), "pairs")
    mirrored = found.select(F.col("other_id").alias("doc_id"), F.col("other_start").alias("start"), F.col("other_end").alias("end"), F.col("doc_id").alias("other_id"), "identity")
    every = found.select(*mirrored.columns).union(mirrored).groupBy("doc_id", "start", "end")
    out = every.agg(F.min("other_id").alias("first_id"), F.count("*").alias("n_matches"), F.max("identity").alias("identity"))
    return out.select("doc_id", "start", "end", (F.col("end") - F.col("start")).alias("n_words"), "first_id", "n_matches", "identity")


def op5(spark, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"))
