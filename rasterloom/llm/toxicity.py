"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lower-cases, strips accents, full-width forms and invisible characters, maps look-alike letters and digits that
stand for letters, and turns all else into spaces. The lexicon, whole words and word stems, is learned from labelled rows:
entries whose documents are toxic far more often than others' by the likelihood ratio, in both halves of the rows,
weighted by log odds. A stem counts where a text has two different words of it, as one such word may be chance. A
document's matches outside exception phrases are summed, normalised by its length, and a logistic fit turns the sum
into a score.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..shipping import ship
from .common import flat_rows, map_rows, remainder, table, whole_text, written

#: Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
LOOKALIKES = dict(zip("авекмнорстухіјѕԁɡαεικνορτυχ", "abekmhopctyxijsdgaeikvoptux", strict=True))
STANDINGS = dict(zip("0134578@$", "oieastbas", strict=True))
#: Phrases whose words mean no harm.
EXCEPTIONS = ("clown fish", "trash can", "trash bin", "white trash bag", "stupid simple", "sore loser rule")


class Folding(dict):
    """str.translate table: what isn't a letter becomes a space, marks and invisible characters go."""

    def __missing__(self, code: int) -> str:
        out = "".join(self.one(c) for c in unicodedata.normalize("NFKD", chr(code)).lower())
        self[code] = out
        return out

    @staticmethod
    def one(c: str) -> str:
        if unicodedata.category(c) in ("Mn", "Me", "Cf"):
            return ""
        return LOOKALIKES.get(c) or STANDINGS.get(c) or (c if c.isalpha() else " ")


FOLDS = Folding()


def fold(text: str) -> str:
    """The folded text with a space before, after and between words."""
    return f" {' '.join(text.lower().translate(FOLDS).split())} "


def entries_of(folded: str, stems: tuple[int, ...] = (4, 5, 6, 7, 8)) -> set[str]:
    """The different entries that a folded text holds: ' word ', and the stems ' wor', ' word', ... of two different words."""
    words = set(folded.split())
    seen = Counter(f" {w[:n]}" for w in words for n in stems if len(w) >= n)
    return {f" {w} " for w in words if 3 <= len(w) <= 30} | {s for s, n in seen.items() if n > 1}


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    exceptions: tuple[str, ...]
    fit: tuple[float, ...]

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for phrase in self.exceptions:
            key = fold(phrase)
            found.add_word(key, (len(key), 0.0))
        for entry, weight in self.lexicon.items():
            found.add_word(entry, (len(entry), weight))
        if len(found):
            found.make_automaton()
        return found


def measure(automaton, folded: str) -> tuple[float, float]:
    """The matches' weights outside exception phrases, summed, and the number of words. Stems count from two different words on."""
    words = folded.count(" ") - 1 if len(folded) > 2 else 0
    if not len(automaton) or not words:
        return 0.0, float(words)
    spared, hits, stems = [], [], {}
    for end, (size, weight) in automaton.iter(folded):
        start, end = end + 1 - size, end + 1
        if not weight:
            spared.append((start, end))
            continue
        stem = folded[start:end] if folded[end - 1] != " " else ""
        hits.append((start, end, weight, stem))
        if stem:
            stems.setdefault(stem, set()).add(folded[start : folded.find(" ", end)])
    hits = [h for h in hits if not h[3] or len(stems[h[3]]) > 1]
    total = sum(w for a, b, w, _ in hits if not any(x <= a and b <= y for x, y in spared))
    return total, float(words)


def features(total: float, words: float) -> tuple[float, float]:
    """The sum, and the sum by length: weight for each hundred words, short texts counted as of twenty."""
    return math.log1p(total), math.log1p(100 * total / (words + 20))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[float, ...]:
    """Weights, intercept first, of a ridge logistic regression by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), ridge * np.diag([1e-6] + [1.0] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
    return tuple(map(float, w))


def train(docs: DataFrame, labels: DataFrame, sample: int = 12_000, most: int = 2_000, evidence: float = 20.0, exceptions: tuple = EXCEPTIONS) -> Model:
    """Learn from labelled rows whose crc32(doc_id as text) mod 4 is not 2.

    Of these, the ``sample`` first by the id's hash are used; ``most`` bounds the entries that the driver sees. An entry's
    least likelihood ratio is ``evidence`` for ``sample`` different texts and falls with the logarithm of their number, as
    fewer texts hold fewer entries that could stand out by chance. A repeated
    id teaches once: its least text, toxic if any of its labels says so. Equal texts count once, by their labels' majority.
    Rows with a null id, text or label teach nothing; without labelled rows, or with one label only, the lexicon is
    empty and scores are the labels' smoothed mean.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(remainder("doc_id", 4) != 2)
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most sample small rows
    text = text.groupBy("doc_id").agg(F.min(F.struct("text", "toxic")).alias("row")).select("row.*")
    schema = StructType([StructField("folded", StringType()), StructField("toxic", DoubleType())])
    rows = map_rows(text, lambda: lambda t, y: (fold(t), float(y)), schema)
    rows = rows.groupBy("folded").agg(F.when(F.avg("toxic") >= 0.5, 1.0).otherwise(0.0).alias("toxic"))
    rows = written(rows.withColumn("half", F.pmod(F.xxhash64("folded"), F.lit(2)).cast("double")), "folded")
    sums = [F.coalesce(F.sum(c), F.lit(0.0)) for c in (F.lit(1.0), F.col("toxic"), F.col("half"), F.col("toxic") * F.col("half"))]
    total, toxic, second, second_toxic = rows.agg(*sums).first()
    clean = total - toxic
    lexicon: dict[str, float] = {}
    if toxic and clean:
        pair = StructType([StructField(c, DoubleType() if c != "entry" else StringType()) for c in ("entry", "toxic", "half")])
        seen = flat_rows(rows, lambda: lambda f, y, h: [(e, y, h) for e in entries_of(f)], pair)
        n, a, n2, a2 = F.col("n").cast("double"), F.col("a"), F.col("n2"), F.col("a2")
        found = seen.groupBy("entry").agg(F.count("*").alias("n"), F.sum("toxic").alias("a"), F.sum("half").alias("n2"), F.sum(F.col("toxic") * F.col("half")).alias("a2"))
        twice = lambda a, n, y, x: (a >= 1) & (a * x > 2 * n * y)  # toxic over twice as often as the rows
        found = found.where((a >= 3) & twice(a2, n2, second_toxic, second) & twice(a - a2, n - n2, toxic - second_toxic, total - second))
        term = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(F.lit(0.0))
        ratio = 2 * (term(a, n * toxic / total) + term(n - a, n * clean / total) + term(toxic - a, toxic * (total - n) / total) + term(clean - (n - a), clean * (total - n) / total))
        enough = evidence * math.log1p(total) / math.log1p(sample)
        top = found.withColumn("g", ratio).where(F.col("g") >= enough).orderBy(F.desc(F.round("g", 6)), F.desc(F.length("entry")), "entry").limit(most).collect()
        for r in top:
            # an entry that begins like one already taken, or the other way round, says the same again
            bare = r["entry"].strip()
            if not any(bare.startswith(k.strip()) or k.strip().startswith(bare) for k in lexicon):
                lexicon[r["entry"]] = math.log((r["a"] + 0.5) / (toxic + 1)) - math.log((r["n"] - r["a"] + 0.5) / (clean + 1))
    draft = Model(lexicon, exceptions, ())
    numbers = StructType([StructField(c, DoubleType()) for c in ("x", "z", "y")])

    def make():
        automaton = draft.automaton()
        return lambda f, y, _: (*features(*measure(automaton, f)), y)

    points = map_rows(rows, make, numbers).collect()  # at most sample rows of three numbers
    data = np.array([tuple(p) for p in points], dtype=float).reshape(-1, 3)
    data = data[np.lexsort(data.T)]  # one order in every run
    fit = logistic(data[:, :2], data[:, 2]) if toxic and clean else (math.log((toxic + 0.5) / (clean + 0.5)), 0.0, 0.0)
    return Model(lexicon, exceptions, fit)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, score): 0 to 1, higher for texts likelier toxic. Null and empty texts score as no matches do."""
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("score", DoubleType())])

    def make():
        rate = rater(model)
        return lambda key, text: (key, rate(text))

    return map_rows(docs.select("doc_id", whole_text()), make, schema)


def rater(model: Model):
    automaton, (w0, w1, w2) = model.automaton(), model.fit

    def rate(text: str) -> float:
        x, z = features(*measure(automaton, fold(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, w0 + w1 * x + w2 * z))))

    return rate


def without_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.3) -> DataFrame:
    """The documents, in all their columns, that score under the limit; null texts score as empty ones."""
    model = train(docs, labels)
    ship(docs.sparkSession)

    @F.pandas_udf("double")
    def rated(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rate = rater(model)  # one automaton a task
        for texts in parts:
            yield texts.fillna("").map(rate)

    return docs.where(rated(F.col("text")) < limit)


def op9(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    held = (remainder("doc_id", 4) == 2).alias("held_out")
    return found.select("doc_id", held, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
