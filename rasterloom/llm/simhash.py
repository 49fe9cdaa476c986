"""SimHash near-duplicates: fingerprints, BK-trees over shards, connected components.

Two fingerprints of 64 bits that differ in at most ``radius`` agree wholly on some ``blocks - radius`` of ``blocks``
bit blocks, so shards keyed by the values of such blocks hold every link together, whatever the number of rows.
Within a shard, trees of bounded size are built and queried: children hang by their Hamming distance to the parent,
and a query follows only edges within the radius. Links leave a shard as a spanning forest, never as all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from .common import Union, components, flat_rows, map_rows, table, whole_text, written

#: Fixed value: the seed of the shingle hash.
SEED = 42


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """The hashes of all shingles of ``words`` words, repeats included; of fewer words, that of the whole sequence."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, "<u8")
    flat = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(found))
    spans = zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(flat[a:b], SEED) for a, b in spans], dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    over = np.flatnonzero(2 * counts > len(hashes))
    return sum(1 << int(b) for b in over)


def fingerprint(text: str, words: int = 4) -> int:
    """The 64-bit SimHash of the shingles of ``words`` words, repeats included; 0 without a word."""
    return majority(shingle_hashes(text, words))


def smallest(hashes: np.ndarray, size: int) -> np.ndarray:
    """MinHash: for each of ``size`` fixed permutations the smallest image of the hashes; the largest number if none."""
    rng = np.random.default_rng(SEED)
    factor, shift = (rng.integers(0, 1 << 64, size, np.uint64)[:, None] for _ in range(2))
    found = np.full(size, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 2048):
        found = np.minimum(found, (hashes[None, at : at + 2048] * (factor | np.uint64(1)) + shift).min(axis=1))
    return found


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class BKTree:
    """Children keyed by integer Hamming distance to their parent."""

    def __init__(self) -> None:
        self.nodes: list[tuple[int, object, dict[int, int]]] = []

    def add(self, key: int, value) -> None:
        self.nodes.append((key, value, {}))
        if len(self.nodes) == 1:
            return
        at = 0
        while True:
            near, _, children = self.nodes[at]
            d = (near ^ key).bit_count()
            if d not in children:
                children[d] = len(self.nodes) - 1
                return
            at = children[d]

    def within(self, key: int, radius: int) -> list:
        found, left = [], [0] if self.nodes else []
        while left:
            near, value, children = self.nodes[left.pop()]
            d = (near ^ key).bit_count()
            if d <= radius:
                found.append(value)
            left += [c for x, c in children.items() if d - radius <= x <= d + radius]
        return found


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """Rows (doc_id, fp): fp as a signed long. Null texts count as empty, whose fingerprint is zero."""
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("fp", LongType())])
    return map_rows(docs.select("doc_id", whole_text()), lambda: lambda key, text: (key, signed(fingerprint(text, words))), schema)


def shard_keys(fp: str, blocks: int, radius: int) -> list:
    """One column for each choice of ``blocks - radius`` blocks: those blocks' bits, and which choice it is."""
    bounds = [round(i * 64 / blocks) for i in range(blocks + 1)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (bounds[i + 1] - bounds[i])) - 1) << bounds[i] for i in chosen)
        keys.append(F.struct(F.lit(n).cast("byte").alias("choice"), F.col(fp).bitwiseAND(F.lit(signed(mask)).cast("long")).alias("bits")))
    return keys


def blocks_for(n: int, radius: int) -> int:
    """The fewest blocks, from two over the radius on, whose shards would hold at most 64 of n even fingerprints.

    More blocks mean more keys a fingerprint but longer ones; every choice finds all links.
    """
    return next((b for b in range(radius + 2, 2 * radius + 2) if n >> (64 * (b - radius) // b) <= 64), 2 * radius + 2)


def links(reps: DataFrame, radius: int = 4, blocks: int | None = None, tree: int = 512) -> DataFrame:
    """Edges (a, b) that connect the ids of all fingerprints within the radius of one another.

    ``reps`` has one stored row (fp, rep) for each different fingerprint.
    """
    blocks = blocks or blocks_for(reps.count(), radius)
    keyed = reps.select("fp", "rep", F.lit(0).alias("size"), F.explode(F.array(*shard_keys("fp", blocks, radius))).alias("key"))
    return links_in_shards(keyed.select("key.*", "fp", "rep", "size"), radius, tree)


def links_in_shards(keyed: DataFrame, radius: int, tree: int = 512, sets: DataFrame | None = None, least: float = 0.0) -> DataFrame:
    """Edges (a, b) that connect the ``rep`` of rows (choice, bits, fp, rep, size) of one shard within the radius of one another.

    With ``sets`` (rep, hashes: sorted 32-bit numbers), only of rows whose sets are ``least`` similar, computed exactly.
    Shards of one row go before anything wide moves, and of shards with equal members one stays. A shard over ``tree``
    rows (or over a million numbers in its sets) is split into parts by hash. First one part's tree is queried by
    every part, which connects nearly all of a large group of copies. Then, in each shard, the rows outside its largest
    component so far make trees that its other parts query: rows already connected need no comparison, and no link
    to a row outside is missed.
    """
    shard = ["choice", "bits"]
    same = [F.bit_xor(F.xxhash64("rep", F.lit(n))).alias(f"x{n}") for n in (0, 1)]  # the members as a set
    sizes = keyed.groupBy(*shard).agg(F.count("*").alias("n"), F.sum("size").alias("numbers"), *same).where("n > 1")
    shards = sizes.groupBy("n", "numbers", "x0", "x1").agg(F.min(F.struct(*shard)).alias("key"))
    parts = lambda n, numbers: F.ceil(F.greatest(F.col(n) / tree, F.col(numbers) / 1_000_000)).cast("int")
    shards = written(shards.select("key.*", F.greatest(F.lit(1), parts("n", "numbers")).alias("parts")), "shards")
    placed = keyed.join(shards, shard).withColumn("part", F.pmod(F.xxhash64("rep", F.lit(2)), F.col("parts")).cast("int"))
    placed = written(placed, "placed")
    every = F.when(F.col("part") == 0, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part"))
    first = placed.select(*shard, "fp", "rep", F.col("rep").alias("known"), (F.col("part") == 0).alias("pivot"), F.lit(0).alias("i"), F.explode(every).alias("j"))
    edges = written(links_in_groups(first, radius, sets, least), "links")
    if shards.where("parts > 1").isEmpty():
        return edges
    labels = components(edges).withColumnRenamed("id", "rep")
    rest = placed.where("part > 0").join(labels, "rep", "left").withColumn("known", F.coalesce("component", "rep")).drop("component")
    rest = written(rest, "rest")
    held = rest.groupBy(*shard, "known").agg(F.count("*").alias("n"), F.sum("size").alias("numbers"))
    tops = held.groupBy(*shard).agg(F.max(F.struct("n", "known", "numbers")).alias("top"), F.sum("n").alias("n"), F.sum("numbers").alias("numbers"))
    tops = tops.select(*shard, F.col("top.known").alias("most"), (F.col("n") - F.col("top.n")).alias("n"), (F.col("numbers") - F.col("top.numbers")).alias("numbers"))
    tops = written(tops.where("n > 0").select(*shard, "most", F.greatest(F.lit(1), parts("n", "numbers")).alias("outer")), "tops")
    rest = rest.join(tops, shard)
    own = F.pmod(F.xxhash64("rep", F.lit(3)), F.col("outer")).cast("int")
    columns = [*shard, "fp", "rep", "known"]
    outside = rest.where("known <> most").select(*columns, F.lit(True).alias("pivot"), own.alias("i"), F.explode(F.sequence(F.lit(1), F.col("parts") - 1)).alias("j"))
    others = rest.select(*columns, F.lit(False).alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("outer") - 1)).alias("i"), F.col("part").alias("j"))
    return edges.union(written(links_in_groups(outside.union(others), radius, sets, least), "links"))


def alike(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two sets, given as sorted numbers, have a Jaccard similarity of at least ``least``."""
    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate((x, y)), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= least * (len(x) + len(y) - shared)


def links_in_groups(met: DataFrame, radius: int, sets: DataFrame | None, least: float) -> DataFrame:
    """Edges between the ``known`` of rows of a group (choice, bits, i, j) and its pivots; of pivots alone, among them."""
    fields, exact = ["pivot", "fp", "known"], sets is not None
    if exact:
        met, fields = met.join(sets, "rep"), [*fields, "hashes"]
    members = F.collect_list(F.struct(*fields)).alias("members")  # of bounded size: two parts of a shard
    rows = met.groupBy("choice", "bits", "i", "j").agg(members).where(F.size("members") > 1)

    def make():
        def each(members):
            grown, together, numbers = BKTree(), Union(), []
            pivots, rest = [m for m in members if m["pivot"]], [m for m in members if not m["pivot"]]
            if exact:
                numbers = [np.frombuffer(m["hashes"], "<u4") for m in pivots + rest]
            for n, m in enumerate(pivots + rest):
                key = m["fp"] & (1 << 64) - 1
                if not rest or n >= len(pivots):
                    for other in grown.within(key, radius):
                        a, b = together.root(m["known"]), together.root(pivots[other]["known"])
                        if a != b and (not exact or alike(numbers[n], numbers[other], least)):
                            together.join(a, b)
                if n < len(pivots):
                    grown.add(key, n)
            return [(x, top) for x in list(together.up) if (top := together.root(x)) != x]

        return each

    return flat_rows(rows.select("members"), make, StructType([StructField("a", LongType()), StructField("b", LongType())]))


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """Rows (doc_id, fp, component_id): component_id is the smallest doc_id reachable over links.

    Texts without a word share the fingerprint zero and link like others. Repeated ids and rows each come back;
    rows whose id is null come back with their fingerprint's component if another row gives one, else with null.
    An empty table gives no rows. Other columns are not read.
    """
    prints = written(fingerprints(docs.select("doc_id", "text"), words), "prints")
    reps = written(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").cast("long").alias("rep")), "reps")
    # Distinct fingerprints may share a smallest id only where ids repeat; such an id joins them.
    labels = components(links(reps, radius))
    classes = reps.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(written(classes, "classes"), "fp", "left").select("doc_id", "fp", "component_id")


def similar_documents(docs: DataFrame, words: int = 5, least: float = 0.8, radius: int = 24, bands: int = 20) -> DataFrame:
    """Rows (doc_id, component_id) over links between texts whose sets of ``words``-word shingles are ``least`` similar.

    Such texts' fingerprints, here of the distinct shingles, differ in about ten bits, more than shards of fingerprint
    blocks can serve, so the shards are bands of four MinHash values: at a similarity of 0.8 all ``bands`` of them
    miss one pair in 40,000. Their trees are searched within ``radius`` bits, five standard deviations beyond the
    mean, and what the trees find is compared shingle by shingle, as 32-bit hashes. Texts with equal sets are one class.
    Rows of one id are one document. Other rules as near_duplicates.
    """
    kinds = [("doc_id", docs.schema["doc_id"].dataType), ("same", BinaryType()), ("fp", LongType()), ("keys", ArrayType(LongType())), ("size", IntegerType()), ("hashes", BinaryType())]

    def make():
        def each(key, text):
            hashes = np.unique(shingle_hashes(text, words))
            groups = smallest(hashes, 4 * bands).reshape(bands, 4)
            numbers = np.unique(hashes.astype("<u4"))
            keys = [signed(xxhash.xxh64_intdigest(g.tobytes(), SEED)) for g in groups]
            return key, xxhash.xxh128_digest(hashes.tobytes(), SEED), signed(majority(hashes)), keys, len(numbers), numbers.tobytes()

        return each

    rows = map_rows(docs.select("doc_id", whole_text()), make, StructType([StructField(n, t) for n, t in kinds]))
    prints = written(rows, "prints")
    one = F.min(F.struct(F.col("doc_id").cast("long").alias("rep"), "fp", "keys", "size")).alias("one")  # equal but for the id
    reps = written(prints.where("doc_id is not null").groupBy("same").agg(one).select("same", "one.*"), "reps")
    keyed = reps.select(F.posexplode("keys").alias("choice", "bits"), "fp", "rep", "size")
    # an id of several texts has several sets; each comes by its own text
    sets = prints.select("same", F.col("doc_id").cast("long").alias("rep"), "hashes").join(reps.select("same", "rep"), ["same", "rep"], "left_semi")
    labels = components(links_in_shards(keyed, radius, sets=sets.dropDuplicates(["same", "rep"]).select("rep", "hashes"), least=least))
    classes = reps.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("same", F.coalesce("component", "rep").alias("component_id"))
    return prints.select("doc_id", "same").join(written(classes, "classes"), "same", "left").select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents with one of each class of similar ones kept: the smallest doc_id.

    Rows with a null id stay. Where a kept id repeats, each of its texts stays in one row: the first in the order of
    the row as JSON.
    """
    found = similar_documents(docs).where("doc_id = component_id").groupBy("doc_id").count()
    found = written(found, "kept")
    once = docs.join(found.where("count = 1"), "doc_id", "left_semi").select(*docs.columns)
    again = docs.join(written(found.where("count > 1"), "repeated"), "doc_id", "left_semi").select(F.struct(*docs.columns).alias("row"))
    order = F.row_number().over(Window.partitionBy("row.doc_id", whole_text("row.text")).orderBy(F.to_json("row")))
    first = again.withColumn("order", order).where("order = 1").select("row.*")
    return once.union(first).union(docs.where("doc_id is null"))


def op7(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
