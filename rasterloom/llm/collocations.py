"""Phrase collocations by suffix sorting.

Each word that starts a phrase gives a suffix of at most ``longest`` words of its piece of text. Suffixes with their numbers
are dealt out by first word in ranges that split frequent words, sorted in reverse, and one stack a language counts all
their prefixes: a prefix is complete when a suffix without it follows. Only the prefixes at a part's two ends can go on
in the next part; those are added up afterwards. A word below the least number is in no phrase that counts, so suffixes
end before it.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import remove, stored, table, whole_text

#: The least number of a phrase, the most words, the phrases reported a language, the share that absorbs.
LEAST, LONGEST, TOP, ABSORBED = 30, 4, 2_000, 80
#: Bits that mark the frequent words; a word that shares a rare one's bit keeps it in suffixes, which costs time alone.
BITS = 1 << 23
#: Different words or suffixes that a task counts before it hands them on.
HELD = 800_000


def _normal() -> bytes:
    """A byte table that lower-cases A-Z, makes a tab a space and each mark that ends a piece a line end."""
    out = bytearray(range(256))
    out[ord("A") : ord("Z") + 1] = range(ord("a"), ord("z") + 1)
    out[ord("\t")] = ord(" ")
    for mark in b".,;:!?\n\x0b\x0c\r":
        out[mark] = ord("\n")
    return bytes(out)


NORMAL = _normal()


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), whole_text().cast("binary").alias("text"))


def counted(rows: DataFrame, take, column: str) -> DataFrame:
    """Rows (lang, column, n): what ``take()`` makes of each text, as a function (lang, normal text) -> list of bytes; partly added up."""
    ship(rows.sparkSession)

    def batch_of(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            every = list(counts)
            for at in range(0, len(every), 20_000):
                keys = every[at : at + 20_000]
                columns = [pa.array([lang] * len(keys)), pa.array(keys, pa.string()), pa.array([counts[k] for k in keys], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", column, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, held = take(), {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.setdefault(lang, Counter()).update(each(lang, text.as_py().translate(NORMAL)))
                if sum(map(len, held.values())) > HELD:
                    yield from batch_of(held)
                    held = {}
        yield from batch_of(held)

    return rows.mapInArrow(run, f"lang string, {column} string, n long")


def words(docs: DataFrame) -> DataFrame:
    """Rows (lang, word, f)."""
    found = counted(texts(docs), lambda: lambda lang, text: text.split(), "word")
    return found.groupBy("lang", "word").agg(F.sum("n").alias("f"))


def marks(frequent: DataFrame) -> np.ndarray:
    """Bytes with a bit for the checksum of each (lang, word): as many whatever the corpus."""
    place = F.crc32(F.concat("lang", F.lit("\t"), "word").cast("binary")) % BITS
    by = frequent.select(place.alias("place")).groupBy((F.col("place") / 32).cast("int").alias("cell"))
    cells = by.agg(F.expr("bit_or(shiftleft(1L, cast(place % 32 as int)))").alias("bits")).toPandas()  # at most BITS / 32 rows
    out = np.zeros(BITS // 32, np.uint32)
    out[cells["cell"].to_numpy(np.int64)] = cells["bits"].to_numpy(np.int64).astype(np.uint32)
    return out


class Frequent(dict):
    """Word -> whether its bit is set, looked up once a word as long as there is room."""

    def __init__(self, lang: str, bits: np.ndarray) -> None:
        super().__init__()
        self.start, self.bits = zlib.crc32(f"{lang}\t".encode()), bits

    def __missing__(self, word: bytes) -> bool:
        place = zlib.crc32(word, self.start) % (32 * len(self.bits))
        if len(self) > HELD:
            self.clear()
        found = self[word] = bool(self.bits[place >> 5] >> np.uint32(place & 31) & np.uint32(1))
        return found


def suffixes(docs: DataFrame, bits: np.ndarray, longest: int) -> DataFrame:
    """Rows (lang, suffix, n): of two and more frequent words in a row, each with a tab behind it; partly added up.

    Tabs fill up for words that are not there, so every suffix has ``longest`` of them and suffixes sort word by word: a
    prefix of words is a prefix of characters.
    """
    sent = docs.sparkSession.sparkContext.broadcast(bits)  # BITS / 8 bytes
    ends = [b"\t" * (longest + 1 - n) for n in range(longest + 1)]

    def take():
        known: dict[str, Frequent] = {}

        def of(run: list[bytes]) -> list[bytes]:
            last = len(run) - longest
            return [b"\t".join(run[i : i + longest]) + ends[longest if i <= last else len(run) - i] for i in range(len(run) - 1)]

        def each(lang: str, text: bytes) -> list[bytes]:
            flags = known.get(lang)
            if flags is None:
                flags = known[lang] = Frequent(lang, sent.value)
            out = []
            for piece in text.split(b"\n"):
                run: list[bytes] = []
                for word in piece.split():
                    if flags[word]:
                        run.append(word)
                    else:
                        if len(run) > 1:
                            out += of(run)
                        run = []
                if len(run) > 1:
                    out += of(run)
            return out

        return each

    return counted(texts(docs), take, "suffix")


class Stack:
    """The open prefixes of a language's last suffix with their numbers, shortest first, while its suffixes pass in order.

    Suffixes come in sorted batches, so whole batches are pushed and popped at once: where a word or one before it
    changes, the prefix that ends with it is popped.
    """

    def __init__(self, least: int, longest: int) -> None:
        self.least, self.longest = least, longest
        self.open: list[tuple[str, int] | None] = [None] * (longest + 1)
        self.first = [True] * (longest + 1)

    def push(self, suffixes: pa.Array, n: np.ndarray) -> list[tuple[str, int]]:
        """The prefixes of two and more words that end in this batch, if they reach the least number or came first of all."""
        words, size, out = pc.list_flatten(pc.split_pattern(suffixes, "\t")), len(suffixes), []
        column = lambda k: words.take(pa.array(np.arange(size) * (self.longest + 1) + k))
        changed = np.zeros(size, bool)
        changed[0] = True
        for k in range(self.longest):
            word = column(k)
            changed = changed.copy()
            changed[1:] |= pc.not_equal(word.slice(1), word.slice(0, size - 1)).to_numpy(zero_copy_only=False)
            if not k:
                continue
            starts = np.flatnonzero(changed)
            sums = np.add.reduceat(n, starts)
            held = pc.not_equal(word.take(pa.array(starts)), "").to_numpy(zero_copy_only=False)
            wanted = held & (sums >= self.least)
            wanted[[0, -1]] = held[[0, -1]]
            places = np.flatnonzero(wanted)
            names = ["\t".join(s.split("\t")[: k + 1]) for s in suffixes.take(pa.array(starts[places])).to_pylist()]
            for place, name, total in zip(places.tolist(), names, sums[places].tolist(), strict=True):
                if place == 0 and self.open[k] and self.open[k][0] == name:
                    self.open[k] = (name, self.open[k][1] + total)
                else:
                    out += self.pop(k)
                    self.open[k] = (name, total)
            if not held[-1]:
                out += self.pop(k)
        return out

    def pop(self, k: int, end: bool = False) -> list[tuple[str, int]]:
        found, self.open[k] = self.open[k], None
        first, self.first[k] = self.first[k], self.first[k] and found is None
        return [found] if found and (end or first or found[1] >= self.least) else []

    def close(self) -> list[tuple[str, int]]:
        return [x for k in range(1, self.longest) for x in self.pop(k, end=True)]


def prefix_counts(found: DataFrame, least: int, longest: int) -> DataFrame:
    """Rows (lang, phrase, f) of the phrases of two and more words that reach ``least``, from suffixes (lang, suffix, n).

    A language's first and last prefixes of a part go on whatever their number, for the sum over the parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stacks: dict[str, Stack] = {}

        def batch_of(lang: str, out: list[tuple[str, int]]) -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(out), "phrase": [p for p, _ in out], "f": [f for _, f in out]})

        for batch in batches:
            langs = batch.column(0)
            for lang in pc.unique(langs).to_pylist():
                mine = batch.filter(pc.equal(langs, lang))
                stack = stacks.setdefault(lang, Stack(least, longest))
                yield from batch_of(lang, stack.push(mine.column(1), mine.column(2).to_numpy()))
        for lang, stack in stacks.items():
            yield from batch_of(lang, stack.close())

    dealt = found.repartitionByRange(F.desc("suffix")).sortWithinPartitions(F.desc("suffix"))
    parts = dealt.select("lang", "suffix", "n").mapInArrow(run, "lang string, phrase string, f long")
    return parts.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def part(first: Column, size: Column) -> Column:
    return F.array_join(F.slice("parts", first, size), "\t")


def scored(phrases: DataFrame, frequent: DataFrame) -> DataFrame:
    """Rows (lang, phrase, a, l, r, score): each phrase at its lowest-scoring cut, ties to the first."""
    known = phrases.unionByName(frequent.select("lang", F.col("word").alias("phrase"), "f"))
    parts = phrases.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", "\t").alias("parts"))
    cuts = parts.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.size("parts") - F.col("k")).alias("tail"))
    side = lambda name, f: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    both = cuts.join(side("head", "l"), ["lang", "head"]).join(side("tail", "r"), ["lang", "tail"])
    score = F.expr("cast(cast(a as decimal(20, 0)) * 2000000 div (cast(l as decimal(20, 0)) + r) as long)")
    least = both.withColumn("score", score).groupBy("lang", "phrase").agg(F.min("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return least.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def free(rows: DataFrame, phrases: DataFrame) -> DataFrame:
    """Without phrases that a longer one holds and nearly equals in number."""
    parts = phrases.select("lang", "f", F.split("phrase", "\t").alias("parts")).where(F.size("parts") > 2)
    wide = parts.withColumn("size", F.explode(F.sequence(F.lit(2), F.size("parts") - 1)))
    wide = wide.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("parts") - F.col("size") + 1)))
    held = wide.groupBy("lang", part(F.col("at"), F.col("size")).alias("phrase")).agg(F.max("f").alias("longer"))
    return rows.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < ABSORBED * F.col("a"))).drop("longer")


def best(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows a language, with their rank; ranked in many shares first, so a language is in no task whole."""
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    shares = max(256, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    for share in (shares, 16, 1):
        group = Window.partitionBy("lang", F.pmod(F.pmod(F.xxhash64("phrase"), F.lit(shares)), F.lit(share))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(group)).where(F.col("rank") <= top)
    return rows


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score) of each language's best phrases.

    Texts and languages are read, no other column. A null text is empty, a null language ``und``. Repeated rows count as
    often as they come. Equal scores go by number, then by phrase, which no two share. Words may be of any length and
    texts too. Empty tables and texts without a phrase give no rows.
    """
    spark = docs.sparkSession
    every, every_path = stored(words(docs), "words")
    frequent = every.where(F.col("f") >= least)
    found, found_path = stored(suffixes(docs, marks(frequent), longest), "suffixes", compression="zstd")
    phrases, _ = stored(prefix_counts(found, least, longest), "phrases")
    totals, _ = stored(every.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    frequent, _ = stored(frequent, "frequent")
    remove(spark, every_path, found_path)
    spaced = free(scored(phrases, frequent), phrases).withColumn("phrase", F.translate("phrase", "\t", " "))
    ranked = best(spaced, top).join(totals, "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


#: The same rows in DuckDB: all phrases counted one by one.
OP12_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
listed as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
starts as (select lang, w, unnest(range(1, len(w) + 1)) as i from listed),
grams as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase from starts, (values (1), (2), (3), (4)) s(k) where i + k - 1 <= len(w)),
f as (select lang, phrase, k, count(*) as f from grams group by all),
totals as (select lang, sum(f)::bigint as n from f where k = 1 group by 1),
cand as (select lang, phrase, k, f as a, string_split(phrase, ' ') as w from f where k > 1 and f >= 30),
cuts as (select c.lang, c.phrase, c.a, j, l.f as l, r.f as r, ((2000000::hugeint * c.a) // (l.f::hugeint + r.f))::bigint as score
  from (select *, unnest(range(1, k)) as j from cand) c
  join f l on l.lang = c.lang and l.phrase = array_to_string(c.w[1:j], ' ') join f r on r.lang = c.lang and r.phrase = array_to_string(c.w[j + 1:], ' ')),
low as (select lang, phrase, any_value(a) as a, arg_min(l, score * 10 + j) as l, arg_min(r, score * 10 + j) as r, min(score) as score from cuts group by 1, 2),
inside as (select d.lang, array_to_string(d.w[i:i + s - 1], ' ') as phrase, max(d.a) as longer
  from (select *, unnest(range(2, k)) as s from cand) d, unnest(range(1, d.k - d.s + 2)) u(i) group by 1, 2),
left_ as (select low.* from low left join inside using (lang, phrase) where longer is null or 100 * longer < 80 * a)
select lang, rank, phrase, a, l, r, n, score from (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from left_) join totals using (lang) where rank <= 2000
"""
