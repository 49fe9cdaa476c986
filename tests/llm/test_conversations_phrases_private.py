"""Conversation repair, collocations and personal data against plain versions, on small and odd tables."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import collocations, conversations, private, queries

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


def as_parquet(df, folder, name):
    df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def from_sql(folder, name, query):
    con = duckdb.connect()
    con.sql(f"create view {name} as select * from '{folder}/{name}.parquet{'' if folder == SF else '/*.parquet'}'")
    return con.sql(query)


def same(found, want):
    assert found.columns == want.columns
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want.fetchall(), key=key)


@pytest.mark.parametrize("name, source", [("op11_conversation_repair", "conversations"), ("op12_collocations", "documents")])
def test_queries_equal_their_sql(spark, name, source):
    same(queries.QUERIES[name](spark, SF), from_sql(SF, source, queries.ORACLE_SQL[name]))


# ---- conversations


def plain_repair(rows):
    """(cost, audit, lines) by a search over all edits, cheapest and least audit first."""
    seen, faults = set(), []
    for role, text in rows:
        bare = text.strip(conversations.SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, n, state, lines = heapq.heappop(heap)
        if n == len(rows) and state in (0, 3):
            return cost, audit, list(lines), faults
        if (n, state) in done:
            continue
        done.add((n, state))
        step = {0: 2, 1: 2, 2: 3, 3: 2}[state]
        name = "assistant" if step == 3 else "user"
        heapq.heappush(heap, (cost + 2, audit + "I", n, step, (*lines, f"{name}:")))
        if n < len(rows):
            role, text = rows[n]
            heapq.heappush(heap, (cost + 3, audit + "D", n + 1, state, lines))
            if faults[n] not in ("blank", "duplicate"):
                more = faults[n] == "truncated"
                heapq.heappush(heap, (cost + 2 + more, audit + "R", n + 1, step, (*lines, f"{name}:{text}")))
                to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role[:1], state))
                if to:
                    heapq.heappush(heap, (cost + more, audit + "K", n + 1, to, (*lines, f"{role}:{text}")))
    raise AssertionError


def odd_turns():
    rng = random.Random(4)
    roles, texts = ["system", "user", "assistant", "tool", "", None, "uncle"], ["Yes.", "No!", "so", "", " \n", None, "What? ", "é…", "x" * 5000 + "."]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(1, 9)):
            rows += [(conv, rng.choice([turn, turn, turn, 3, None]), rng.choice(roles[:3] if rng.random() < 0.7 else roles), rng.choice(texts))] * rng.choice([1, 1, 1, 1, 3])
    return rows


def test_repair_equals_a_search_over_all_edits(spark):
    rows = odd_turns()
    report, repaired = conversations.repair(spark.createDataFrame(rows, TURNS).repartition(5).withColumn("at", F.lit("x")).withColumn("conv", F.lit(1)))
    got = {r.conv: r for r in report.collect()}
    lines = {}
    for r in repaired.orderBy("conv", "at", "n").collect():
        lines.setdefault(r.conv, []).append(f"{r.role}:{r.text}")
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault("" if conv is None else f"={conv}", []).append((turn, " " if role is None else role, " " if text is None else text))
    assert set(got) == set(by)
    for conv, held in by.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        cost, audit, want, faults = plain_repair([r[1:] for r in held])
        r = got[conv]
        assert (r.rows, r.cost, r.audit, lines.get(conv, [])) == (len(held), cost, audit, want), conv
        known = [t for t, _, _ in held if t is not None]
        assert r.gaps == (max(known) - min(known) + 1 - len(set(known)) if known else 0)
        assert (r.blank, r.duplicate, r.truncated) == tuple(faults.count(f) for f in ("blank", "duplicate", "truncated"))
        assert r.illegal == sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(held))


def test_a_conversation_over_many_segments_and_partitions(spark, tmp_path):
    rng = random.Random(7)
    rows = [(1, n, rng.choice(["user", "assistant", "assistant"]), f"text {n}" + rng.choice([".", ".", ""])) for n in range(3_000)] + [(2, 0, "user", "Hello."), (2, 1, "assistant", "Hi.")]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, TURNS)
        ordered = conversations.in_order(df)
        assert ordered.where("conv = '=1'").select(F.spark_partition_id()).distinct().count() > 3
        report, repaired = conversations.repair(df)
        cost, audit, want, _ = plain_repair([r[2:] for r in rows if r[0] == 1])
        long = {r.conv: r for r in report.collect()}["=1"]
        assert (long.cost, long.audit) == (cost, audit)
        digests = {r.conv: r.repaired_sha256 for r in conversations.hashed(repaired).collect()}
        assert digests["=1"] == hashlib.sha256("\n".join(want).encode()).hexdigest()
        assert digests["=2"] == hashlib.sha256(b"user:Hello.\nassistant:Hi.").hexdigest()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_matrices_are_associative():
    rng = random.Random(3)
    for _ in range(200):
        a, b, c = (conversations.turn_matrix(rng.choice("suax"), rng.choice(["", "", "blank", "truncated"])) for _ in range(3))
        assert conversations.times(conversations.times(a, b), c) == conversations.times(a, conversations.times(b, c))


def test_damage_follows_the_checksum(spark):
    rows = [(c, t, "assistant", "A. b! c?") for c in [*range(20), None] for t in [0, 1, 2, None]]
    found = Counter((r.conv_id, r.turn, r.role, r.text) for r in conversations.damaged(spark.createDataFrame(rows, TURNS)).collect())
    for c, t, role, text in rows:
        rest = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want = ("user" if rest == 4 else role, {1: "", 2: "A b c"}.get(rest, text))
        assert found[(c, t, *want)] == (0 if rest == 0 else 2 if rest == 3 else 1)


def test_odd_conversation_tables_equal_sql(spark, tmp_path):
    folder = as_parquet(spark.createDataFrame([r for r in odd_turns() if r[2] != ""], TURNS), tmp_path / "odd", "conversations")
    same(conversations.op11(spark, folder), from_sql(folder, "conversations", conversations.OP11_SQL))
    empty = as_parquet(spark.createDataFrame([], TURNS), tmp_path / "empty", "conversations")
    assert conversations.op11(spark, empty).count() == 0


# ---- collocations


def plain_phrases(rows, least, longest, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    held = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = {}
    for p, a in held.items():
        lang, words = p[0], p[1:]
        if any(100 * b >= 80 * a for q, b in held.items() if q[0] == lang and len(q) > len(p) and any(q[i : i + len(words)] == words for i in range(1, len(q) - len(words) + 1))):
            continue
        score, k = min((2_000_000 * a // (f[(lang, *words[:k])] + f[(lang, *words[k:])]), k) for k in range(1, len(words)))
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[(lang, *words[:k])], f[(lang, *words[k:])]))
    return {(lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, some in out.items() for i, (s, a, p, left, right) in enumerate(sorted(some)[:top], 1)}


def phrase_rows():
    rng = random.Random(11)
    vocabulary = ["a", "b", "A", "é", "\x01x", "a\x01", "\xa0", "…", "c-d", "ü", "zz"]
    seps = [" ", " ", " ", " ", "\t", "  ", ". ", "\n", "\x0b", ", "]
    rows = [("en" if i % 3 else None, "".join(w for _ in range(rng.randint(0, 60)) for w in (rng.choice(vocabulary), rng.choice(seps)))) for i in range(80)]
    return rows + [("de", None), ("de", ""), ("fr", "one"), ("en", "hot pair " * 3_000)] + [("es", "same four words here. " * 3)] * 40


def test_collocations_equal_a_count_of_all_phrases(spark):
    rows = phrase_rows()
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("f", F.lit("x")).withColumn("phrase", F.lit(1)).repartition(6)
    for top in (2_000, 7):
        found = {tuple(r) for r in collocations.collocations(df, top=top).collect()}
        assert found == plain_phrases(rows, 30, 4, top)
    assert collocations.collocations(df.limit(0)).count() == 0


def test_counts_go_on_over_parts_and_wrong_bits(spark, monkeypatch):
    rows = phrase_rows()
    monkeypatch.setattr(collocations, "BITS", 32)  # nearly every word shares a frequent one's bit
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {tuple(r) for r in collocations.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(3)).collect()}
        assert found == plain_phrases(rows, 30, 4, 2_000)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_scores_past_64_bits(spark):
    phrases = spark.createDataFrame([("x", "p\tq", 9_000_000_000_000_000)], "lang string, phrase string, f long")
    single = spark.createDataFrame([("x", "p", 9_100_000_000_000_000), ("x", "q", 9_000_000_000_000_001)], "lang string, word string, f long")
    assert collocations.scored(phrases, single).first().score == 2_000_000 * 9_000_000_000_000_000 // 18_100_000_000_000_001


# ---- personal data


def plain_base(text):
    found = [(m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m[0].split("."))) <= 255]
    for kind, pattern, low, high in (("card", r"[0-9]([\x20-]?[0-9])+", 14, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 10, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
            if low <= len(digits) <= high and (kind == "phone" or total % 10 == 0):
                found.append((m.start(), kind, m.end()))
    return private.in_order(found)


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    for alphabet in ("0123456789 .-+()@ab%é\n", "0123 -", "012.+ (", "ab@.-c "):
        for _ in range(4_000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 45)))
            assert private.base_spans(text) == plain_base(text), text


def test_decoding_and_sums_equal_all_segmentations():
    rng = random.Random(5)
    for _ in range(150):
        size = rng.randint(1, 6)
        spans = {(i, rng.randint(i + 1, size), rng.randint(1, 4)) for i in (rng.randrange(size) for _ in range(rng.randint(0, 7)))}
        cands = [(i, j, k, (f"f{n}",)) for n, (i, j, k) in enumerate(sorted(spans))]
        weights = {f"f{n}": rng.uniform(-2, 2) for n in range(len(cands))} | {f"{a}>{b}": rng.uniform(-1, 1) for a in private.KINDS for b in private.KINDS}

        def total(chosen, weights=weights):
            passed = sum(private.passing(weights, a[2], b[2]) for a, b in itertools.pairwise(chosen) if a[1] == b[0])
            return sum(weights[c[3][0]] for c in chosen) + passed

        every = [c for n in range(size + 1) for c in itertools.combinations(cands, n) if all(a[1] <= b[0] for a, b in itertools.pairwise(c))]
        best = private.best_path(size, cands, weights)
        assert total(best) == pytest.approx(max(map(total, every)))
        logs, chances, _ = private.expected(size, cands, weights)
        raised = [2.718281828459045 ** total(c) for c in every]
        assert 2.718281828459045**logs == pytest.approx(sum(raised))
        for c, chance in zip(cands, chances, strict=True):
            assert chance == pytest.approx(sum(r for r, one in zip(raised, every, strict=True) if c in one) / sum(raised))


@pytest.fixture(scope="module")
def weights(spark):
    return private.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_the_field_finds_what_patterns_lose_and_nothing_else(weights):
    added = lambda text: [(k, text[s:e]) for (s, k, e), base in private.spans_of(text, weights) if not base]
    a, b, phone = "7536784127813050", "4845168114407329", "+1 (826) 555-4081"
    assert added(f"x {a} {b} y") == [("card", a), ("card", b)]
    assert added(f"x {phone} 190.137.223.204 y") == [("phone", phone)]
    assert added("x (826) 555-4081 y") == [("phone", "(826) 555-4081")]
    assert added(f"x {a[:-1]}1 {b[:-1]}2 y") == []
    for clean in ("Version 3.0, BY-NC 4.0.", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "1, 2, 3 and 10 000 000", "2024-01-05 10:22:33", ""):
        assert added(clean) == []
    assert private.spans_of(f"x {a} {b} y", {}) == []


def test_held_out_spans_are_found_as_if_unknown(spark, weights):
    """Base spans of other documents, found by the field alone."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text is not null and doc_id % 7 = 3").collect()]
    want = [(n, *s) for n, t in enumerate(texts) for s in private.base_spans(t)]
    got = {(n, *s) for n, t in enumerate(texts) for s in private.added_spans(t, [], weights)}
    assert len(want) > 50 and len(got & set(want)) >= 0.9 * len(want)
    assert len(got - set(want)) <= 0.1 * len(want)


def test_private_scan_on_odd_rows(spark, odd, clashing, none, weights):
    found = private.scan(clashing, weights).collect()
    assert len(found) == clashing.count()
    by = {}
    for r in odd.collect():
        by.setdefault(r.doc_id, r.text or "")
    for r in found:
        if r.doc_id is not None:
            text = by[r.doc_id]
            assert [(s["start"], s["kind"], s["end"]) for s in r.spans if s["base"]] == plain_base(text)
            assert r.redacted == text or r.spans
    assert private.scan(none, weights).count() == 0 and private.train(none) == {}
    assert private.train(spark.createDataFrame([("no digits here",), (None,)], "text string")) == {}
    assert private.redacted("a b@c.de f", [(2, "email", 8)]) == "a [EMAIL] f"


def test_private_query_equals_a_plain_version(spark, tmp_path):
    rows = [(1, "mail a.b@c.de and 10.0.0.256 and 10.0.0.25"), (2, None), (None, ""), (3, "+1 (826) 555-4081 " * 3), (3, "+1 (826) 555-4081 " * 3), (4, "é 4111-1111-1111-1111")]
    folder = as_parquet(spark.createDataFrame(rows, "doc_id long, text string"), tmp_path, "documents")
    found = private.op13(spark, folder).collect()
    assert len(found) == len(rows)
    for r in found:
        text = next(t for d, t in rows if d == r.doc_id) or ""
        base = plain_base(text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for _, k, _ in base) for kind in private.KINDS]
        line = ",".join(f"{k}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(line.split(",")) <= set(r.spans.split(","))


def test_long_texts_take_linear_time(weights):
    for text in ("1" * 40_000, "1 " * 4_000, "a@" * 20_000, "a" * 40_000, "+1" * 4_000, "1.1." * 2_000):
        private.spans_of(text, weights)
