"""Mixing sources to target weights, in DataFrame functions alone.

Targets come from the sources' sizes by filling up to caps. A target above a source's size takes whole epochs first;
the fraction left is drawn by Efraimidis-Spirakis: rows in order of an exponential key divided by their quality
weight, as far as the words left go. No source is ever sorted whole: keys fall into buckets of about ``bucket`` rows,
bucket sums give the one bucket in which the budget ends, and only that bucket's rows are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, table, whole_text, written

#: The weights that sources take in turn, the share of all sizes to mix, the most epochs of a source.
WEIGHTS, SHARE, EPOCHS = (5, 2, 1), 1.5, 2.0
PUNCTUATION = r"[!-/:-@\[-`{-~]"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for a text without ASCII punctuation, less the more of it there is; 1 for the empty text."""
    marks = F.regexp_count(text, F.lit(PUNCTUATION)).cast("double")
    return F.lit(1.0) / (F.lit(1.0) + F.lit(8.0) * marks / F.greatest(F.length(text), F.lit(1)).cast("double"))


def uniform(key: Column) -> Column:
    """A number strictly between 0 and 1 from 52 bits of the key's md5: the same in every run and engine."""
    digits = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10)
    return (digits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def sized(docs: DataFrame) -> DataFrame:
    """Rows (row, doc_id, source, size, quality, draw): row is the whole document, draw its sampling key."""
    text = whole_text("row.text")
    base = docs.select(F.struct("*").alias("row"))
    base = base.select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), word_count(text).alias("size"), quality_weight(text).alias("quality"))
    key = F.coalesce(F.col("doc_id").cast("string"), text)  # rows without an id draw by their text, so many of them spread
    return base.withColumn("draw", -F.log(uniform(key)) / F.col("quality"))


def targets(stats: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """One row a source: place, source, source_size, n_docs, mean_quality, target.

    Sources in code-point order, null last, weigh ``weights`` in turn. With caps of ``epochs`` sizes and sources in
    order of cap over weight, all before some place are capped and the rest share what is left by weight.
    This table has one row a source; its windows see no documents.
    """
    by = stats.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"), F.avg("quality").alias("mean_quality"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = by.withColumn("place", F.row_number().over(ordered) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", epochs * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before, after, every = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    left = share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = ranked.withColumn("level", left / F.sum("weight").over(after)).withColumn("turn", F.row_number().over(fill))
    free = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("turn"))
    found = level.withColumn("level", F.min_by("level", free).over(every))
    share_of = F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return found.select("place", "source", "source_size", "n_docs", "mean_quality", share_of.alias("target"))


def mix(rows: DataFrame, stats: DataFrame, bucket: int = 1024, **how) -> DataFrame:
    """``rows`` (with source, size, quality, draw, doc_id, and anything else) with source_size, target and taken.

    ``stats`` has the same rows' source, size, quality and draw, stored. taken: the words that the mix takes of the
    row, repeats counted; the row in which the budget ends is taken in part, so a source meets its target rounded
    down. Equal rows draw equal keys and are interchangeable; empty texts take nothing; an empty table stays empty.
    """
    goal = written(targets(stats, **how), "targets")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("full", full).withColumn("rest", F.floor("target").cast("long") - F.col("full") * F.col("source_size"))
    goal = goal.withColumn("buckets", F.ceil(F.col("n_docs") / bucket))
    # The share of draws below a row's, were all qualities the mean: near uniform, and in the order of the draws.
    below = F.lit(1.0) - F.exp(-F.col("draw") * F.col("mean_quality"))
    cell = F.least(F.floor(below * F.col("buckets")), F.col("buckets") - 1).cast("long")
    small = goal.select(F.col("source").alias("goal_source"), "source_size", "target", "mean_quality", "buckets", "full", "rest", "place")
    at = lambda df: df.join(small, df["source"].eqNullSafe(small["goal_source"])).drop("goal_source").withColumn("cell", cell)
    sums = at(stats).groupBy("place", "rest", "cell").agg(F.sum("size").alias("words"))
    ends = sums.withColumn("reach", F.sum("words").over(Window.partitionBy("place").orderBy("cell")))
    end = ends.where("reach > rest").groupBy("place").agg(F.min_by(F.struct("cell", (F.col("reach") - F.col("words")).alias("before")), "cell").alias("last"))
    end = written(end.select(F.col("place").alias("end_place"), F.col("last.cell").alias("end_cell"), F.col("last.before").alias("before")), "ends")
    small = written(small.join(end, small["place"] == end["end_place"], "left").drop("end_place"), "goals")
    placed = at(rows)
    sure = placed.where("end_cell is null or cell <> end_cell")
    sure = sure.withColumn("extra", F.when(F.col("end_cell").isNull() | (F.col("cell") < F.col("end_cell")), F.col("size")).otherwise(F.lit(0)).cast("long"))
    edge = placed.where("cell = end_cell")
    ahead = Window.partitionBy("place").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(ahead), F.lit(0))
    edge = edge.withColumn("extra", F.greatest(F.lit(0), F.least("size", room)).cast("long"))
    every = sure.unionByName(edge)
    return every.withColumn("taken", F.col("full") * F.col("size") + F.col("extra")).select(*rows.columns, "source_size", "target", "taken")


def mixed(docs: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them: one row for each epoch begun, none for what it leaves out.

    A document taken in part comes whole. Documents without a word take no words and drop out.
    """
    rows = sized(docs)
    found = mix(rows, written(rows.select("source", "size", "quality", "draw"), "sizes"))
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    return found.where("taken > 0").select("row", F.explode(F.array_repeat(F.lit(1), times))).select("row.*")


def op10(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = written(sized(docs).drop("row"), "sizes")
    return mix(rows, rows).select("doc_id", "size", "source_size", "target", "taken")


#: The same rows in DuckDB: here each source is ranked whole.
OP10_SQL = r"""
with base as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    1.0::double / (1.0::double + 8.0::double * (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[!-/:-@\[-`{-~]', '', 'g')))::double
      / greatest(length(coalesce(text, '')), 1)::double) as quality,
    (('0x' || substr(md5(coalesce(doc_id::varchar, text, '')), 1, 13))::bigint::double + 0.5::double) / 4503599627370496.0::double as u
  from documents),
sources as (select source, sum(size)::bigint as source_size from base group by source),
ranked as (select *, row_number() over (order by source nulls last) - 1 as place from sources),
weighed as (select *, [5.0::double, 2.0::double, 1.0::double][place % 3 + 1] as weight, 2.0::double * source_size as cap from ranked),
levels as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0.0::double))
    / sum(weight) over (order by cap / weight, place rows between current row and unbounded following) as own,
    row_number() over (order by cap / weight, place) as turn from weighed),
leveled as (select *, min_by(own, turn) filter (where own <= cap / weight) over () as level from levels),
goals as (select source, source_size, least(cap, coalesce(level * weight, cap)) as target from leveled),
drawn as (select b.doc_id, b.size, g.source_size, g.target, case when g.source_size > 0 then floor(g.target / g.source_size) else 0 end::bigint as epochs,
    coalesce(sum(b.size) over (partition by b.source order by -ln(b.u) / b.quality, b.doc_id, b.size rows between unbounded preceding and 1 preceding), 0)::bigint as ahead
  from base b join goals g on b.source is not distinct from g.source)
select doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target)::bigint - epochs * source_size - ahead)))::bigint as taken
from drawn
"""
