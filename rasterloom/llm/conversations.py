"""Repair of conversations into system?, then user and assistant in turn, by a min-plus matrix scan.

A conversation may stand in one of four states: nothing yet, after the system's turn, after the user's, after the
assistant's. Each turn is a 4x4 matrix whose elements (cost, audit) are the cheapest ways from state to state over that
turn, closed under insertions after it; products of such matrices are associative, least elements first by cost, then by
audit. Turns are dealt out in ranges of (conversation, turn) and folded to segments of at most ``SEGMENT`` rows, segments to
one matrix a partition, and those sixteen at a time, so a conversation of any length spreads over many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..shipping import ship
from .common import flat_rows, map_rows, remove, stored, table

#: Costs of the edits, by the initial that the audit holds; a kept or changed truncated turn costs one more.
COSTS = {"K": 0, "R": 2, "D": 3, "I": 2}
#: Pairs of role initials that may follow one another, and white space.
LEGAL, SPACE = ("su", "ua", "au"), " \t\n\x0b\x0c\r"
#: State -> the state that an inserted or changed turn leads to; of 0 to 3: nothing, system, user, assistant came last.
NEXT = (2, 2, 3, 2)
#: Rows of a segment, as a power of two.
SEGMENT = 8

Element = tuple[int, str]
Matrix = list[Element | None]


def times(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product: of all ways over a state between, the cheapest, ties by the least audit."""
    out: Matrix = [None] * 16
    for i, k in product(range(4), range(4)):
        x = a[4 * i + k]
        if x is None:
            continue
        for j in range(4):
            y = b[4 * k + j]
            if y is not None:
                way = (x[0] + y[0], x[1] + y[1])
                held = out[4 * i + j]
                if held is None or way < held:
                    out[4 * i + j] = way
    return out


def diagonal(cost: int, audit: str) -> Matrix:
    return [(cost, audit) if i == j else None for i in range(4) for j in range(4)]


def closure() -> Matrix:
    """Any number of insertions; more than two lead nowhere that fewer do not."""
    one: Matrix = [(COSTS["I"], "I") if NEXT[i] == j else None for i in range(4) for j in range(4)]
    least = lambda a, b: [min((x for x in p if x is not None), default=None) for p in zip(a, b, strict=True)]
    up_to_one = least(diagonal(0, ""), one)
    return times(up_to_one, up_to_one)


INSERTS = closure()


def turn_matrix(initial: str, fault: str) -> Matrix:
    """One turn: kept where its role may stand, changed to the role that may, or deleted; then insertions."""
    out = diagonal(COSTS["D"], "D")
    if fault not in ("blank", "duplicate"):
        more = int(fault == "truncated")
        keeps = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(initial, {})
        for i in range(4):
            ways = [(NEXT[i], (COSTS["R"] + more, "R"))] + ([(keeps[i], (COSTS["K"] + more, "K"))] if i in keeps else [])
            for j, way in ways:
                held = out[4 * i + j]
                out[4 * i + j] = way if held is None else min(held, way)
    return times(out, INSERTS)


#: What a stretch of a conversation comes to; sides holds the first and last role's initial, the ends its first and last turn.
STRETCH = StructType(
    [StructField(c, LongType()) for c in ("rows", "blank", "duplicate", "truncated", "illegal")]
    + [StructField("first_initial", StringType()), StructField("last_initial", StringType())]
    + [StructField(c, LongType()) for c in ("first_turn", "last_turn", "low", "high", "turns")]
    + [StructField("costs", ArrayType(LongType())), StructField("audits", ArrayType(StringType()))]
)
NAMES = STRETCH.fieldNames()


def joined(a: dict, b: dict) -> dict:
    """Two stretches that follow one another as one."""
    out = {c: a[c] + b[c] for c in ("rows", "blank", "duplicate", "truncated")}
    out["illegal"] = a["illegal"] + b["illegal"] + (a["last_initial"] + b["first_initial"] not in LEGAL)
    out |= {"first_initial": a["first_initial"], "last_initial": b["last_initial"], "first_turn": a["first_turn"], "last_turn": b["last_turn"]}
    known = lambda c: [x[c] for x in (a, b) if x[c] is not None]
    out |= {"low": min(known("low"), default=None), "high": max(known("high"), default=None)}
    same = a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    return out | {"turns": a["turns"] + b["turns"] - same, "matrix": times(a["matrix"], b["matrix"])}


def one_turn(turn: int | None, initial: str, fault: str, copies: int, cache: dict) -> dict:
    """The stretch of a turn and its equal copies; those after the first are duplicates unless blank."""
    key = (initial, fault)
    if key not in cache:
        cache[key] = turn_matrix(initial, fault)
    matrix, rest = cache[key], copies - 1
    if rest:
        matrix = times(matrix, times(diagonal(COSTS["D"] * rest, "D" * rest), INSERTS))
    out = {c: int(fault == c) for c in ("blank", "duplicate", "truncated")}
    out["blank" if fault == "blank" else "duplicate"] += rest
    ends = {"first_initial": initial, "last_initial": initial, "first_turn": turn, "last_turn": turn, "low": turn, "high": turn}
    return out | ends | {"rows": copies, "illegal": rest * (initial * 2 not in LEGAL), "turns": int(turn is not None), "matrix": matrix}


def packed(s: dict) -> tuple:
    held = s | {"costs": [e and e[0] for e in s["matrix"]], "audits": [e and e[1] for e in s["matrix"]]}
    return tuple(held[c] for c in NAMES)


def unpacked(row: dict) -> dict:
    return row | {"matrix": [None if c is None else (c, a) for c, a in zip(row["costs"], row["audits"], strict=True)]}


def fold(parts: list[dict]) -> dict:
    """The product of stretches in order, as a balanced tree, so long audits are copied a logarithmic number of times."""
    while len(parts) > 1:
        parts = [joined(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def conv_key(col: str = "conv_id") -> Column:
    """The conversation's id as text that keeps null apart from every id."""
    return F.when(F.col(col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(col).cast("string")))


def in_order(turns: DataFrame) -> DataFrame:
    """Rows (conv, at, turn, role, text, copies, fault): ``at`` rises with (conv, turn, role, text's digest), nulls first.

    Equal rows of a turn are one row with their number. Ranges are dealt by all of the key, so they split a
    conversation of any length. A duplicate has its first holder's turn looked up by an aggregate, not in a group.
    """
    rows = turns.select(conv_key().alias("conv"), "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    rows = rows.withColumn("turn", F.col("turn").cast("long")).groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("digest", F.sha2("text", 256))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    first = rows.groupBy("conv", "role", "digest").agg(F.min(place).alias("first"))
    bare = F.rtrim("text", F.lit(SPACE))
    fault = F.when(bare == "", "blank").when(F.col("first") != place, "duplicate").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    marked = rows.join(first, ["conv", "role", "digest"]).withColumn("fault", fault)
    order = ("conv", "turn", "role", "digest")
    dealt = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("conv", F.monotonically_increasing_id().alias("at"), "turn", "role", "text", "copies", "fault")


def segments(ordered: DataFrame) -> DataFrame:
    """One row (conv, seg, and a stretch's columns) for each conversation's rows in each run of rows of a partition."""
    row = F.struct("at", "turn", F.left("role", F.lit(1)).alias("initial"), "fault", "copies")
    by = ordered.groupBy("conv", F.shiftright("at", SEGMENT).alias("seg")).agg(F.sort_array(F.collect_list(row)).alias("held"))

    def make():
        cache: dict = {}

        def each(conv, seg, held):
            return (conv, seg, *packed(fold([one_turn(r["turn"], r["initial"], r["fault"], r["copies"], cache) for r in held])))

        return each

    schema = StructType([StructField("conv", StringType()), StructField("seg", LongType()), *STRETCH.fields])
    return map_rows(by, make, schema)


def folded(stretches: DataFrame, group: Column) -> DataFrame:
    """One row (conv, seg, stretch) for each conversation and group; seg is the group's number."""
    by = stretches.groupBy("conv", group.alias("group")).agg(F.sort_array(F.collect_list(F.struct("seg", *NAMES))).alias("held"))

    def make():
        return lambda conv, seg, held: (conv, seg, *packed(fold([unpacked(r) for r in held])))

    return map_rows(by, make, StructType([StructField("conv", StringType()), StructField("seg", LongType()), *STRETCH.fields]))


def whole(stretches: DataFrame, parts: int) -> DataFrame:
    """One row (conv, rows, gaps, blank, duplicate, truncated, illegal, cost, audit) a conversation, by tree reduction."""
    found, last = folded(stretches, F.shiftright("seg", 33 - SEGMENT)), parts - 1
    while last > 0:
        found, last = folded(found, F.shiftright("seg", 4)), last >> 4

    def make():
        def each(conv, seg, *stretch):
            s = unpacked(dict(zip(NAMES, stretch, strict=True)))
            ways = times(INSERTS, s["matrix"])
            cost, audit = min(w for w in (ways[0], ways[3]) if w is not None)
            gaps = s["high"] - s["low"] + 1 - s["turns"] if s["turns"] else 0
            return (conv, s["rows"], gaps, s["blank"], s["duplicate"], s["truncated"], s["illegal"], cost, audit)

        return each

    longs = [StructField(c, LongType()) for c in ("rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return map_rows(found, make, StructType([StructField("conv", StringType()), *longs, StructField("audit", StringType())]))


def pieces(stretches: DataFrame, totals: DataFrame) -> DataFrame:
    """Rows (conv, seg, before, piece): each segment's letters of the audit, and the state that it starts in."""
    by = stretches.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("seg", "rows"))).alias("held"))

    def make():
        def each(conv, held, audit):
            out, at, turns = [], 0, 0
            system = (len(audit) - audit.count("D")) % 2  # an odd number of turns starts with the system's
            for s in held:
                left, start = s["rows"], at
                while at < len(audit) and (left or audit[at] == "I"):
                    left -= audit[at] != "I"
                    at += 1
                state = 0 if not turns else 1 if system and turns == 1 else 2 + (turns + system + 1) % 2
                out.append((conv, s["seg"], state, audit[start:at]))
                turns += at - start - audit.count("D", start, at)
            return out

        return each

    schema = [StructField("conv", StringType()), StructField("seg", LongType()), StructField("before", IntegerType()), StructField("piece", StringType())]
    return flat_rows(by.join(totals.select("conv", "audit"), "conv").select("conv", "held", "audit"), make, StructType(schema))


def edited(ordered: DataFrame, cut: DataFrame) -> DataFrame:
    """Rows (conv, at, n, edit, role, text) of the repaired conversations, in order of (at, n); deleted turns have none."""
    row = F.struct("at", "role", "text", "copies")
    by = ordered.groupBy("conv", F.shiftright("at", SEGMENT).alias("seg")).agg(F.sort_array(F.collect_list(row)).alias("held"))

    def make():
        def each(conv, held, state, piece):
            out, last = [], held[0]["at"]
            rows = (r for r in held for _ in range(r["copies"]))
            for n, edit in enumerate(piece):
                here = None if edit == "I" else next(rows)
                last = here["at"] if here else last
                if edit == "D":
                    continue
                role, text = (here["role"], here["text"]) if here else ("", "")
                if edit == "K":
                    state = {"s": 1, "u": 2, "a": 3}[role[0]]
                else:
                    state = NEXT[state]
                    role = "assistant" if state == 3 else "user"
                out.append((conv, last, n, edit, role, text))
            return out

        return each

    schema = [StructField("conv", StringType()), StructField("at", LongType()), StructField("n", IntegerType()), *[StructField(c, StringType()) for c in ("edit", "role", "text")]]
    return flat_rows(by.join(cut, ["conv", "seg"]).select("conv", "held", "before", "piece"), make, StructType(schema), many=2_000)


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The report and the repaired turns of conversations (conv_id, turn, role, text); other columns are not read.

    Report: conv, rows, gaps, blank, duplicate, truncated, illegal, cost, audit. Repaired: conv, at, n, edit, role, text.
    ``conv`` is ``conv_key`` of the id. A null id is a conversation of its own; null roles and texts count as one space;
    null turns come first. Turns that tie stand in order of role, then of their text's SHA-256; equal rows are
    interchangeable. An empty text is blank. An empty table has no rows. A conversation's audit is one value, so it must
    fit one row; its texts need not.
    """
    spark = ship(turns.sparkSession)
    ordered, _ = stored(in_order(turns), "turns")
    stretches, path = stored(segments(ordered), "stretches")
    parts = stretches.agg(F.max(F.shiftright("seg", 33 - SEGMENT))).first()[0]  # one number
    totals, _ = stored(whole(stretches, (parts or 0) + 1), "totals")
    cut, _ = stored(pieces(stretches.select("conv", "seg", "rows"), totals), "pieces")
    remove(spark, path)
    return totals, edited(ordered, cut)


def hashed(repaired: DataFrame) -> DataFrame:
    """Rows (conv, repaired_sha256) over the repaired turns as role:text, joined by newlines.

    A digest takes its bytes in order, so a conversation's segments meet in one task; they pass through it one after another.
    """
    line = F.struct("at", "n", F.concat("role", F.lit(":"), "text").alias("line"))
    by = repaired.groupBy("conv", F.shiftright("at", SEGMENT).alias("seg")).agg(F.sort_array(F.collect_list(line)).alias("held"))
    runs = by.select("conv", "seg", F.array_join(F.transform("held", lambda x: x["line"]), "\n").alias("run"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda c, s: pa.RecordBatch.from_pydict({"conv": [c], "repaired_sha256": [s.hexdigest()]})
        conv, state = None, None
        for batch in batches:
            for c, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if c != conv:
                    if conv is not None:
                        yield out(conv, state)
                    conv, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(text.as_py().encode("utf-8", "surrogatepass"))
        if conv is not None:
            yield out(conv, state)

    ordered = runs.repartition("conv").sortWithinPartitions("conv", "seg").select("conv", "run")
    return ordered.mapInArrow(run, "conv string, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults by the rest r of crc32 of 'conv_id:turn' by 20, nulls as one space.

    r = 0 drops the row, 1 empties its text, 2 removes its full stops, exclamation and question marks, 3 repeats it,
    4 makes its role user.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rest = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(F.col("rest") == 1, "").when(F.col("rest") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = turns.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), rest.alias("rest")).where("rest <> 0")
    times_ = F.array_repeat(F.lit(1), F.when(F.col("rest") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", F.when(F.col("rest") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times_).alias("copy")).drop("copy")


def op11(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    report, repaired = repair(damaged(turns))
    every = turns.select("conv_id", conv_key().alias("conv")).distinct()
    full = every.join(report, "conv", "left").join(hashed(repaired), "conv", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return full.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


#: The same rows in DuckDB: CRC bit by bit, and the four states' cheapest ways turn by turn.
OP11_SQL = r"""
with recursive keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
crcs as (select *, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(8 * len(k)), lambda i: (ord(k[i // 8 + 1]) >> (i % 8)::int) & 1)),
    lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)))) % 20 as rest from keyed),
copies as (select *, unnest(range(case rest when 0 then 0 when 3 then 2 else 1 end)) as copy from crcs),
rows_ as (select conv_id, turn, case rest when 4 then 'user' else role end as role, case rest when 1 then '' when 2 then translate(text, '.!?', '') else text end as text from copies),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text)) as pos,
    rtrim(text, E' \t\n\x0b\x0c\r') as bare from rows_),
seen as (select *, row_number() over (partition by conv_id, role, text order by pos) > 1 as again from placed),
faulty as (select *, role[1] as initial, lag(role[1]) over (partition by conv_id order by pos) as former,
    case when bare = '' then 'blank' when again then 'duplicate' when right(bare, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault from seen),
counts as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count_if(fault = 'blank') as blank, count_if(fault = 'duplicate') as duplicate,
    count_if(fault = 'truncated') as truncated, count_if(pos > 1 and former || initial not in ('su', 'ua', 'au')) as illegal from faulty group by 1),
inserts(i, j, cost, edit, lines) as (values (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 2, 'I', ['user:']), (0, 3, 4, 'II', ['user:', 'assistant:']),
    (1, 2, 2, 'I', ['user:']), (1, 3, 4, 'II', ['user:', 'assistant:']), (2, 3, 2, 'I', ['assistant:']), (3, 2, 2, 'I', ['user:'])),
edits(i, j, cost, edit, initial, role) as (values (0, 0, 3, 'D', null, null), (1, 1, 3, 'D', null, null), (2, 2, 3, 'D', null, null), (3, 3, 3, 'D', null, null),
    (0, 1, 0, 'K', 's', null), (0, 2, 0, 'K', 'u', null), (1, 2, 0, 'K', 'u', null), (3, 2, 0, 'K', 'u', null), (2, 3, 0, 'K', 'a', null),
    (0, 2, 2, 'R', null, 'user'), (1, 2, 2, 'R', null, 'user'), (3, 2, 2, 'R', null, 'user'), (2, 3, 2, 'R', null, 'assistant')),
ways as (
  select c.conv_id, 0::bigint as pos, x.j as state, x.cost::bigint as cost, x.edit as audit, x.lines::varchar[] as lines from counts c, inserts x where x.i = 0
  union all
  select conv_id, pos, state, best.cost, best.audit, lines from (
    select w.conv_id, f.pos, x.j as state, min({'cost': (w.cost + e.cost + x.cost + case when f.fault = 'truncated' and e.edit <> 'D' then 1 else 0 end)::bigint, 'audit': w.audit || e.edit || x.edit}) as best,
      arg_min(list_concat(w.lines, case when e.edit = 'D' then [] else [coalesce(e.role, f.role) || ':' || f.text] end, x.lines),
        {'cost': (w.cost + e.cost + x.cost + case when f.fault = 'truncated' and e.edit <> 'D' then 1 else 0 end)::bigint, 'audit': w.audit || e.edit || x.edit}) as lines
    from ways w join faulty f on f.conv_id is not distinct from w.conv_id and f.pos = w.pos + 1
    join edits e on e.i = w.state and (e.edit = 'D' or f.fault not in ('blank', 'duplicate')) and coalesce(e.initial, f.initial) = f.initial
    join inserts x on x.i = e.j group by 1, 2, 3)),
ends as (select c.conv_id, any_value(c.n) as n, min({'cost': w.cost, 'audit': w.audit}) as best, arg_min(w.lines, {'cost': w.cost, 'audit': w.audit}) as lines
  from counts c join ways w on w.conv_id is not distinct from c.conv_id and w.pos = c.n and w.state in (0, 3) group by 1)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, coalesce(e.best.cost, 0)::bigint as cost, coalesce(e.best.audit, '') as audit, sha256(coalesce(array_to_string(e.lines, E'\n'), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join counts c on c.conv_id is not distinct from o.conv_id left join ends e on e.conv_id is not distinct from o.conv_id
"""
