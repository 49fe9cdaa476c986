"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Shallow trees over the statistics give rules, one for each path from a root; a lasso logistic regression over the
rules keeps a few with weights; these are compiled into one Spark column expression, which scores without Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, remainder, table, whole_text, written


def statistics(text: Column) -> dict[str, Column]:
    """Name -> number of a text: lengths, shares of kinds of characters, repetition of words and lines."""
    words = F.regexp_count(text, F.lit(WORD)).cast("double")
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    lines = F.split(text, "\n")
    listed = F.split(text, r"[\x20\x09-\x0D]+")
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / chars
    return {
        "words": words,
        "word_length": chars / F.greatest(words, F.lit(1.0)),
        "symbols": share(r"[#$%&*+=<>@^_~\\|{}\[\]]"),
        "shouts": share(r"[!?]"),
        "stops": share(r"[.,;:]"),
        "digits": share(r"[0-9]"),
        "capitals": share(r"\p{Lu}"),
        "distinct_words": F.size(F.array_distinct(listed)) / F.size(listed).cast("double"),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines).cast("double"),
        "line_length": chars / F.size(lines),
    }


@dataclass(frozen=True)
class Rule:
    """All of (statistic, is_at_most, threshold), and the weight in log odds when they hold."""

    parts: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        held = F.lit(True)
        for name, at_most, limit in self.parts:
            held = held & ((F.col(name) <= limit) if at_most else (F.col(name) > limit))
        return held.cast("double")


@dataclass(frozen=True)
class Model:
    rules: tuple[Rule, ...]
    base: float

    def score(self) -> Column:
        """The probability of label 1 over columns of statistics."""
        total = F.lit(self.base)
        for rule in self.rules:
            total = total + F.lit(rule.weight) * rule.column()
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def paths(node, names: list[str], parts: tuple = ()) -> list[tuple]:
    """The conditions of every node below a tree's root."""
    found = [parts] if parts else []
    if node.subtreeDepth() == 0:
        return found
    split, name = node.split(), names[node.split().featureIndex()]
    limit = float(split.threshold())
    return found + paths(node.leftChild(), names, (*parts, (name, True, limit))) + paths(node.rightChild(), names, (*parts, (name, False, limit)))


def shortest(parts: tuple) -> tuple:
    """Conditions in one order, of several on one side of a statistic only the tightest."""
    tight: dict[tuple[str, bool], float] = {}
    for name, at_most, limit in parts:
        key = (name, at_most)
        tight[key] = limit if key not in tight else (min if at_most else max)(tight[key], limit)
    return tuple((n, m, v) for (n, m), v in sorted(tight.items()))


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, trees: int = 20, depth: int = 3, lasso: float = 0.002) -> Model:
    """Learn from labelled rows whose crc32(doc_id as text) mod 5 is not 0: of these the ``sample`` first by hash.

    Null texts count as empty. Without rows of both labels the model is the labels' smoothed mean.
    """
    known = labels.where("doc_id is not null and quality is not null").where(remainder("doc_id", 5) != 0)
    known = known.select("doc_id", F.col("quality").cast("double").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    rows = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(known), "doc_id")  # at most sample small rows
    stats = statistics(F.col("text"))
    names = list(stats)
    data = written(rows.select("label", *[c.cast("double").alias(n) for n, c in stats.items()]), "statistics").coalesce(8)
    n, ones = data.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < ones < n:
        return Model((), math.log((ones + 0.5) / (n - ones + 0.5)))
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(data)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="0.5").fit(vectors)
    every = {shortest(p) for tree in forest.trees for p in paths(tree._call_java("rootNode"), names)}
    drafts = [Rule(p) for p in sorted(every)]
    held = data.select("label", *[r.column().alias(f"r{i}") for i, r in enumerate(drafts)])
    matrix = VectorAssembler(inputCols=[f"r{i}" for i in range(len(drafts))], outputCol="features").transform(held)
    fit = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=60).fit(matrix.select("label", "features"))
    rules = (Rule(r.parts, float(w)) for r, w in zip(drafts, fit.coefficients, strict=True) if w)
    return Model(tuple(rules), float(fit.intercept))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, score) of every document, null texts as empty ones; repeated rows score alike."""
    stats = statistics(F.col("text"))
    rows = docs.select("doc_id", whole_text().alias("text"))
    rows = rows.select("doc_id", *[c.cast("double").alias(n) for n, c in stats.items()])
    return rows.select("doc_id", model.score().alias("score"))


def op1(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    held = (remainder("doc_id", 5) == 0).alias("held_out")
    return found.select("doc_id", held, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
