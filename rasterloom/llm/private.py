"""Personal data: four base patterns, and a semi-Markov conditional random field that finds what they miss.

The patterns take whole runs and drop those that fail a test, so two card numbers side by side, a telephone number before
an address, or a number in national form are lost. The field scores whole candidate spans by features that only a span
has, its shape, digits, checksum and surroundings, and a dynamic program over the words around digits and at-signs
chooses boundaries and kinds jointly, an entity being at most ``WIDEST`` tokens long. It is trained on the patterns' own
spans of a bounded sample, rewritten in other forms, with spans that fail the tests as counterexamples. Base spans are
observed: the program fills in only what they leave.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from ..shipping import ship
from .common import flat_rows, map_rows, table, whole_text

#: The kinds, in the order that breaks ties between spans of one start, and their patterns.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: What starts a stretch to look at, and the blank-free chunks that carry it on.
TRIGGER, REST, MORE = re.compile(r"[0-9@]"), re.compile(r"\S*+"), re.compile(r" (?=[^\s0-9@]*+[0-9@])\S++")
TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^0-9A-Za-z]")
#: The most tokens of an entity; labels are no entity (0) or a kind's place plus one.
WIDEST, LABELS = 24, range(len(KINDS) + 1)

Span = tuple[int, str, int]  # start, kind, end
Cand = tuple[int, int, int, tuple[str, ...]]  # first token, token after the last, label, features
Weights = dict[str, float]


def luhn(digits: str) -> bool:
    """Whether the digits, every second from the right doubled, add up to a multiple of ten."""
    doubled = [int(c) * 2 for c in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 * (d > 9) for d in doubled)) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each pattern, in time linear in the text; a match that fails its test is dropped."""
    found, low = [], 0
    for m in DOMAIN.finditer(text):
        at = m.start()
        while at > low and text[at - 1] in LOCAL:
            at -= 1
        if at < m.start():
            found.append((at, "email", m.end()))
            low = m.end()
    found += [(m.start(), "ip", m.end()) for m in IP.finditer(text) if all(small(p) for p in m[0].split("."))]
    for kind, pattern in (("card", CARD), ("phone", PHONE)):
        for m in pattern.finditer(text):
            digits = digits_of(m[0])
            if (14 <= len(digits) <= 19 and luhn(digits)) if kind == "card" else 10 <= len(digits) <= 15:
                found.append((m.start(), kind, m.end()))
    return in_order(found)


def small(part: str) -> bool:
    """Whether a part of an address is at most 255; a long part need not be read as a number."""
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Chunks between white space that hold a digit or an at-sign, those one blank apart together."""
    low = 0
    while m := TRIGGER.search(text, low):
        a = m.start()
        while a > low and not text[a - 1].isspace():
            a -= 1
        b = REST.match(text, m.end()).end()
        while more := MORE.match(text, b):
            b = more.end()
        yield a, b
        low = b


def sort_of(char: str) -> str:
    if not char:
        return "end"
    return "digit" if "0" <= char <= "9" else "letter" if char.isalpha() else "blank" if char.isspace() else char if char in "@.+-_:=/(),\"'" else "mark"


def candidates(text: str, a: int, b: int) -> tuple[list[int], list[Cand]]:
    """The starts of a stretch's tokens, with its end, and the spans that could be an entity, with their features."""
    tokens = [(m.start(), m[0]) for m in TOKEN.finditer(text, a, b)]
    edges, words = [at for at, _ in tokens] + [b], [w for _, w in tokens]
    number = ["0" <= w[0] <= "9" for w in words]
    found: list[Cand] = []

    def add(i: int, j: int, kind: str, *features: str) -> None:
        start, end = edges[i], edges[j]
        around = (f"before={sort_of(text[start - 1 : start])}", f"after={sort_of(text[end : end + 1])}")
        follows = f"then={sort_of(text[end : end + 1])}{sort_of(text[end + 1 : end + 2])}"
        found.append((i, j, KINDS.index(kind) + 1, tuple(f"{kind}|{f}" for f in ("", *around, follows, *features))))

    for i, word in enumerate(words):
        if word == "@":
            emails(words, i, add)
        if not number[i] and word not in "+(":
            continue
        if number[i] and all(number[i + 2 * n : i + 2 * n + 1] == [True] and words[i + 2 * n - 1] == "." for n in (1, 2, 3)):
            add(i, i + 7, "ip", f"small={all(small(words[i + 2 * n]) for n in range(4))}", f"dotted={words[i - 1 : i] == ['.']}")
        total, card = 0, number[i]
        for j in range(i, min(len(words), i + WIDEST)):
            if not number[j]:
                if words[j] not in "+ ().-/" or (words[j] == "+" and j > i) or (words[j] == " " and words[j - 1] == " "):
                    break
                card = card and words[j] in " -" and number[j - 1]
                continue
            total += len(words[j])
            if total > 19:
                break
            if total < 9:
                continue
            span = text[edges[i] : edges[j + 1]]
            digits, parts = digits_of(span), [w for w in re.split(r"[^0-9]+", span) if w]
            grouped = "one" if len(parts) == 1 else "even" if max(map(len, parts[:-1])) == min(map(len, parts[:-1])) >= 3 else "odd"
            if card and total >= 12:
                add(i, j + 1, "card", f"n={total}", f"luhn={luhn(digits)}", f"luhn={luhn(digits)},{grouped}")
            if total <= 15:
                shape = re.sub(r"[0-9]+", "9", span)
                lead = "+" if span[0] == "+" else "(" if span[0] == "(" else "00" if span[:2] == "00" else "0" if span[0] == "0" else "digit"
                add(i, j + 1, "phone", f"n={total}", f"lead={lead}", f"parts={min(len(parts), 6)}", f"shape={shape}", f"brackets={span.count('(')},{span.count(')')}")
    return edges, found


def emails(words: list[str], at: int, add) -> None:
    """The candidates around one at-sign: all starts of its run to the left, all ends after a dot to the right."""
    first = at
    while first > 0 and at - first < WIDEST // 2 and (words[first - 1].isascii() and (words[first - 1].isalnum() or words[first - 1] in "._%+-")):
        first -= 1
    last, dots, ends = at + 1, 0, []
    while last < len(words) and last - at < WIDEST // 2 and words[last].isascii() and (words[last].isalnum() or words[last] in ".-"):
        dots += words[last] == "."
        last += 1
        if dots and words[last - 1].isalnum():
            ends.append((last, dots))
    for i in range(first, at):
        for j, n in ends:
            add(i, j, "email", f"whole={i == first},{j == last or (j == last - 1 and words[j] in '.-')}", f"dots={min(n, 3)}", f"start={sort_of(words[i][0])}", f"end={sort_of(words[j - 1][0])}")


def scores_of(cands: list[Cand], weights: Weights) -> list[float]:
    return [sum(weights.get(f, 0.0) for f in features) for _, _, _, features in cands]


def passing(weights: Weights, before: int, label: int) -> float:
    """The score of an entity right behind another."""
    return weights.get(f"{KINDS[before - 1]}>{KINDS[label - 1]}", 0.0) if before else 0.0


def best_path(size: int, cands: list[Cand], weights: Weights) -> list[Cand]:
    """The highest-scoring choice of disjoint candidates: semi-Markov decoding over ``size`` tokens.

    A token outside scores nothing, so an entity must score above it; on a tie there is none.
    """
    ending: dict[int, list[tuple[Cand, float]]] = {}
    for c, s in zip(cands, scores_of(cands, weights), strict=True):
        ending.setdefault(c[1], []).append((c, s))
    best: list[list[tuple[float, tuple | None]]] = [[(0.0, None)] + [(-math.inf, None)] * len(KINDS)]
    for t in range(1, size + 1):
        row = [(-math.inf, None)] * len(LABELS)
        top = max(LABELS, key=lambda p: (best[t - 1][p][0], -p))
        row[0] = (best[t - 1][top][0], (None, t - 1, top))
        for c, s in ending.get(t, []):
            for p in LABELS:
                way = best[c[0]][p][0] + passing(weights, p, c[2]) + s
                if way > row[c[2]][0]:
                    row[c[2]] = (way, (c, c[0], p))
        best.append(row)
    label = max(LABELS, key=lambda p: (best[size][p][0], -p))
    out, t = [], size
    while t > 0:
        step = best[t][label][1]
        if step[0] is not None:
            out.append(step[0])
        t, label = step[1], step[2]
    return out[::-1]


def added_spans(text: str, base: list[Span], weights: Weights) -> list[Span]:
    """What the field adds: its best choice among the candidates that touch no base span."""
    out = []
    if not weights:
        return out
    for a, b in stretches(text):
        edges, cands = candidates(text, a, b)
        if not cands:
            continue
        near = [s for s in base if s[0] < b and s[2] > a]
        open_ = [c for c in cands if not any(s < edges[c[1]] and e > edges[c[0]] for s, _, e in near)]
        if open_:
            out += [(edges[i], KINDS[k - 1], edges[j]) for i, j, k, _ in best_path(len(edges) - 1, open_, weights)]
    return out


# ---- training


def log_sum(values: list[float]) -> float:
    top = max(values)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))


def expected(size: int, cands: list[Cand], weights: Weights) -> tuple[float, list[float], Counter]:
    """The log of the sum over all segmentations, each candidate's probability, and the expected passings."""
    scores = scores_of(cands, weights)
    ending: dict[int, list[int]] = {}
    starting: dict[int, list[int]] = {}
    for n, c in enumerate(cands):
        ending.setdefault(c[1], []).append(n)
        starting.setdefault(c[0], []).append(n)
    ahead = [[0.0] + [-math.inf] * len(KINDS)]
    for t in range(1, size + 1):
        row = [log_sum(ahead[t - 1])] + [-math.inf] * len(KINDS)
        for n in ending.get(t, []):
            i, _, k, _ = cands[n]
            row[k] = log_sum([row[k], *[ahead[i][p] + passing(weights, p, k) + scores[n] for p in LABELS]])
        ahead.append(row)
    behind = [[0.0] * len(LABELS) for _ in range(size + 1)]
    for t in range(size - 1, -1, -1):
        for p in LABELS:
            ways = [behind[t + 1][0]] + [passing(weights, p, cands[n][2]) + scores[n] + behind[cands[n][1]][cands[n][2]] for n in starting.get(t, [])]
            behind[t][p] = log_sum(ways)
    total, chances, passings = behind[0][0], [], Counter()
    for n, (i, j, k, _) in enumerate(cands):
        ways = [math.exp(min(0.0, ahead[i][p] + passing(weights, p, k) + scores[n] + behind[j][k] - total)) for p in LABELS]
        chances.append(sum(ways))
        for p in LABELS[1:]:
            passings[f"{KINDS[p - 1]}>{KINDS[k - 1]}"] += ways[p]
    return total, chances, passings


Example = tuple[int, tuple[Cand, ...], tuple[int, ...]]  # tokens, candidates, the places of the true ones


def example(text: str, a: int, b: int, truth: list[Span]) -> Example | None:
    """A stretch with the candidates that are its true spans; None where one is no candidate or two overlap."""
    edges, cands = candidates(text, a, b)
    places = {(edges[i], KINDS[k - 1], edges[j]): n for n, (i, j, k, _) in enumerate(cands)}
    inside = [s for s in truth if s[0] < b and s[2] > a]
    clash = any(x[2] > y[0] for x, y in zip(inside, inside[1:], strict=False))
    if clash or any(s not in places for s in inside):
        return None
    return (len(edges) - 1, tuple(cands), tuple(places[s] for s in inside)) if cands else None


def forms(stretch: str, spans: list[Span]) -> Iterator[tuple[str, list[Span]]]:
    """A sampled stretch with its spans, and, if it has one span, that span in other forms and as it fails its test."""
    yield stretch, spans
    if len(spans) != 1:
        return
    start, kind, end = spans[0]
    span, digits = stretch[start:end], digits_of(stretch[start:end])

    def put(new: str, true: bool = True) -> tuple[str, list[Span]]:
        return stretch[:start] + new + stretch[end:], [(start, kind, start + len(new))] if true else []

    if kind == "card":
        for mark in " -":
            yield put(mark.join(digits[n : n + 4] for n in range(0, len(digits), 4)))
        yield put(digits[:-1] + str((int(digits[-1]) + 1) % 10), False)
    elif kind == "ip":
        yield put(span + "9" * 3, False) if not small(span.rsplit(".", 1)[1] + "999") else (stretch, spans)
    elif kind == "phone":
        yield put("00" + span[1:])
        home = re.sub(r"^\+[0-9]{1,3}[ .-]*(?=\()", "", span)
        if home != span and len(digits_of(home)) >= 10:
            yield put(home)
    joined = f"{span} {span}" if kind != "email" else ""
    if joined:
        yield stretch[:start] + joined + stretch[end:], [(start, kind, start + len(span)), (start + len(span) + 1, kind, start + len(joined))]


def fit(examples: list[Example], rounds: int = 60, ridge: float = 0.02) -> Weights:
    """Weights of the greatest penalised likelihood, by steps that grow while a gradient keeps its sign."""
    held = Counter(examples)
    total = sum(held.values())
    known = Counter(f for (_, cands, _), n in held.items() for c in cands for f in c[3] for _ in range(min(n, 3)))
    names = [f for f, n in known.items() if n >= 3] + [f"{a}>{b}" for a in KINDS for b in KINDS]
    weights, steps, last = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.1), dict.fromkeys(names, 0.0)
    for _ in range(rounds if total else 0):
        slope = {f: -ridge * w for f, w in weights.items()}
        for (size, cands, true), n in held.items():
            _, chances, passings = expected(size, list(cands), weights)
            for place, (c, chance) in enumerate(zip(cands, chances, strict=True)):
                gain = n * ((place in true) - chance)
                if gain:
                    for f in c[3]:
                        if f in slope:
                            slope[f] += gain
            for f, chance in passings.items():
                slope[f] -= n * chance
            chosen = [cands[place] for place in true]
            for x, y in zip(chosen, chosen[1:], strict=False):
                if x[1] == y[0]:
                    slope[f"{KINDS[x[2] - 1]}>{KINDS[y[2] - 1]}"] += n
        for f, g in slope.items():
            same = g * last[f]
            steps[f] = min(2.0, steps[f] * 1.2) if same > 0 else max(1e-4, steps[f] * 0.5) if same < 0 else steps[f]
            weights[f] += math.copysign(steps[f], g) if g else 0.0
            last[f] = g
    return {f: w for f, w in weights.items() if w}


def train(docs: DataFrame, sample: int = 1_500, widest: int = 160, text_col: str = "text") -> Weights:
    """The field's weights, from at most ``sample`` different stretches of at most ``widest`` characters, the first by hash.

    Of the stretches that hold a candidate, half at most are such that hold a base span. A stretch with a match that has
    too many digits for its pattern teaches nothing, as it may hold several entities. Without a base span there are no
    weights, so nothing is added.
    """
    schema = StructType([StructField("stretch", StringType()), StructField("spans", ArrayType(SPAN))])

    def make():
        def each(text):
            out, base = [], None
            for a, b in stretches(text):
                if b - a > widest or not candidates(text, a, b)[1]:
                    continue
                base = base_spans(text) if base is None else base
                low, high = max(0, a - 1), min(len(text), b + 2)
                mine = [{"kind": k, "start": s - low, "end": e - low, "base": True} for s, k, e in base if s >= a and e <= b]
                if not any(len(digits_of(m[0])) > n for p, n in ((CARD, 19), (PHONE, 15)) for m in p.finditer(text, a, b)):
                    out.append((text[low:high], mine))
            return out

        return each

    found = flat_rows(docs.select(whole_text(text_col).alias("text")), make, schema).distinct()
    by_hash = [F.xxhash64("stretch"), F.col("stretch")]
    pick = lambda holds: found.where((F.size("spans") > 0) == holds).orderBy(*by_hash).limit(sample // 2)
    examples = []
    for row in pick(True).union(pick(False)).collect():  # at most ``sample`` short rows
        for text, spans in forms(row["stretch"], [(s["start"], s["kind"], s["end"]) for s in row["spans"]]):
            # the characters around the stretch are context alone
            for a, b in stretches(text):
                if (one := example(text, a, b, spans)) is not None:
                    examples.append(one)
    return fit(sorted(examples)) if any(true for _, _, true in examples) else {}


SPAN = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("base", BooleanType())])


def spans_of(text: str, weights: Weights) -> list[tuple[Span, bool]]:
    base = base_spans(text)
    marked = dict.fromkeys(added_spans(text, base, weights), False) | dict.fromkeys(base, True)
    return [(s, marked[s]) for s in in_order(list(marked))]


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every stretch that spans cover replaced by the kind of its first span."""
    out, at, reach = [], 0, 0
    for start, kind, end in spans:
        if start >= reach:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = reach = max(reach, end)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, weights: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, spans, redacted): all spans in order, base or added, and the text without them.

    Null and empty texts have no spans and come back as the empty text. Repeated rows give repeated results, an empty
    table none; other columns are neither read nor returned. Offsets are code points, ends exclusive. An added span
    touches no base span and no other added one; of equal choices the one with fewer entities stays.
    """
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), StructField("spans", ArrayType(SPAN)), StructField("redacted", StringType())])
    sent = ship(docs.sparkSession).sparkContext.broadcast(weights)  # features of a bounded sample

    def make():
        def each(key, text):
            found = spans_of(text, sent.value)
            return key, [{"kind": k, "start": s, "end": e, "base": b} for (s, k, e), b in found], redacted(text, [s for s, _ in found]) if found else text

        return each

    return map_rows(docs.select(id_col, whole_text(text_col)), make, schema)


def op13(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, train(docs))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[of(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
