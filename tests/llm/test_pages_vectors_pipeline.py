"""Page text, the embedding join and the pipeline."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import embeddings, pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head><body>
<header>Site name</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad banner">Buy</div><div id="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p><b>One&nbsp;two<br>three<p>Four &lt;five&gt; &eacute;<div class="related">Also read</div><ul><li>a<li>b</ul>
<form><input name=q>Search</form><section class="comments"><p>First!</section><p>%s</p></article><aside>Side</aside><footer>&copy; Site</footer></body></html>"""


def test_an_article_without_what_surrounds_it():
    assert pages.main_text(PAGE % "End", frozenset()) == "Title & more\nOne two three\nFour <five> é\na\nb\nEnd"
    for html in ("", "<", "</p>", "<p", "<!-- ", "<script>x", "<article></article>", "<a b='\"'>x</a", "plain  text"):
        pages.main_text(html, frozenset())
    assert pages.main_text("plain \n text", frozenset()) == "plain text"
    assert pages.main_text("<body><nav>x</nav></body>", frozenset()) == ""


def text_of(html):
    return pages.main_text(html, frozenset())


def test_odd_attributes_and_names_lose_no_text():
    assert text_of("<article><p title=it's>One</p><p>Two</p></article>") == "One\nTwo"
    assert text_of('<article><p>One <a href="x>two</a></p><p>Three</p></article>') == "One two\nThree"
    assert text_of("<article><p a = 'b>c' d=e/>One</p><p class=\"share-price\">Two</p><p class='notice-of-meeting'>Three</p></article>") == "One\nTwo\nThree"
    assert text_of('<article><p>One</p><div class="cookie-notice">x</div><div id="ad-300">y</div><ul class="share_buttons"><li>z</ul></article>') == "One"
    assert text_of("<body><form action=/><nav>menu</nav><article><p>One<input></p></article></form><form><p>Search</form></body>") == "One"
    assert text_of("<body><form><h1>One</h1><p>Two</p></form></body>") == "One\nTwo"
    assert text_of("<body><p>One</p><section class=comments><article><p>First!</p></article></section></body>") == "One"
    assert text_of("<article><p>1 < 2 <!-- > --> 3<![CDATA[x]]></p></><p>4<?x ?></p><SCRIPT>'</p>'</sCript ><p>5</article>") == "1 < 2 3\n4\n5"
    assert text_of("<article><span><p>One</span> two</p><table><tr><td>a<td>b<tr><th>c</table></article>") == "One two\na\nb\nc"


def test_odd_markup_takes_linear_time():
    import time

    n = 160_000
    began = time.time()
    for html in (
        '<a b="' * n, "<a b='" * n + '"', "<b>" * n + "</i>" * n, "<p><button>" + "<b>" * n + "<h1></h1>" * (n // 2), "<span><div>" + "<b>" * n + "</span>" * n,
        "<!--" * n, "<" * n, "</" * n, "<title>" * n, "<div>" * n + "</div>" * n, "<li><b>" * n, "<form>" * n, "&#" * n, "<a " + " " * n * 4 + "=", "<article>" * n,
    ):
        pages.main_text(html, frozenset([1]))
    assert time.time() - began < 60


def test_templates_change_pages_without_an_article(spark):
    shell = "<body><div><b>Breaking</b> <i>Weather today</i></div><div><div>%s</div></div><div><p>Our mission statement is long</p><ul><li>One</ul></div></body>"
    rows = [(i, f"https://news.example/{i}", shell % "".join(f"<p>story {i} part {j}</p>" for j in range(3))) for i in range(6)]
    rows += [(50 + i, "https://twin.example/x", shell % "<p>the same page at three addresses</p>") for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    known = {r.host: set(r.hashes) for r in pages.templates(df).collect()}
    brute = collections.Counter(h for _, _, html in rows[:6] for h in pages.subtree_hashes(html))
    assert known == {"news.example": {h for h, n in brute.items() if n >= 3}}
    got = {r.page_id: r.text for r in pages.extract(df).collect()}
    assert got[4] == "\n".join(f"story 4 part {j}" for j in range(3))
    assert got[51] == "Breaking Weather today\nthe same page at three addresses\nOur mission statement is long\nOne"
    assert pages.main_text(rows[4][2], frozenset()) != got[4]


def test_templates_of_a_site_go_and_prose_stays(spark):
    shell = "<body><div><span>Welcome to our site</span> <a>login</a></div><div>%s</div><div><p>All rights</p></div></body>"
    rows = [(i, f"http://h.example/{i}", shell % f"<p>text number {i}</p>") for i in range(12)]
    rows += [(100 + i, f"http://h2.example/{i}", f"<article><p>Same line</p><p>own {i}</p><div>Subscribe now</div></article>") for i in range(10)]
    rows += [(200, "http://lone.example/", shell % "<p>x</p>"), (201, None, None), (202, "nonsense", ""), (0, "http://h.example/0", shell % "<p>text number 0</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("hashes", F.lit("y"))
    found = collections.defaultdict(list)
    for r in pages.extract(df).collect():
        found[r.page_id].append(r.text)
    assert found[3] == ["text number 3"] and found[0] == ["text number 0"] * 2
    assert found[104] == ["Same line\nown 4"]
    assert found[200] == ["Welcome to our site login\nx\nAll rights"]
    assert found[201] == found[202] == [""]
    assert pages.extract(df.limit(0)).count() == 0


def vectors(n, seed=0, dim=12):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 3, dim))
    rows = [base[i % len(base)] + rng.normal(scale=0.12, size=dim) for i in range(n)]
    return [[float(np.float32(x)) for x in r] for r in rows]


@pytest.mark.parametrize(("cell", "block"), [(4096, 4096), (20, 16), (7, 5)])
def test_range_join_equals_brute_force(spark, cell, block):
    v = vectors(120)
    rows = list(enumerate(v)) + [(500 + i, v[0]) for i in range(40)] + [(600, None), (601, []), (602, [0.0] * 12), (603, [float("nan")] + [1.0] * 11), (604, [None] + [1.0] * 11), (605, [float("inf")] + [1.0] * 11), (606, v[0][:5]), (607, [x * 2 for x in v[0]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rep", F.lit("x")).withColumn("cell", F.lit(1)).withColumn("label", F.lit(None).cast("int"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df, cell=cell, block=block).collect()}
    assert len(got) == len(rows)
    good = [(i, np.array(x, float)) for i, x in rows if x and None not in x and np.isfinite(x).all() and any(x)]
    links = collections.Counter()
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, x) in enumerate(good):
        for j, y in good[:n]:
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    for i, _ in rows:
        assert got[i] == (links[i], root(i), root(i) == i), i


def test_links_planted_among_given_vectors_are_all_found(spark):
    """The table of sf0.1 with near copies of a fifth of its vectors, in groups from two to forty, against all pairs by blocks."""
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").where(embeddings.usable()).orderBy("vec_id").toPandas()
    x = np.array(given["embedding"].tolist(), np.float64)
    rng = np.random.default_rng(5)
    sizes = [1, 2, 3, 7, 40]
    made = np.concatenate([x[5 * i] + rng.normal(scale=0.3 * np.linalg.norm(x[5 * i]) / x.shape[1] ** 0.5, size=(sizes[i % 5], x.shape[1])) for i in range(len(x) // 25)])
    every = np.float32(np.concatenate([x, made]))
    ids = np.concatenate([given["vec_id"].to_numpy(), given["vec_id"].max() + 1 + np.arange(len(made))])
    rows = [(int(i), v.tolist()) for i, v in zip(ids, every, strict=True)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    u = every.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    low, pairs = ids.copy(), []
    for a in range(0, len(u), 1000):
        i, j = np.nonzero(u[a : a + 1000] @ u.T >= 0.9)
        pairs.append(np.stack([i + a, j])[:, i + a != j])
    i, j = np.concatenate(pairs, axis=1)
    links = np.bincount(i, minlength=len(ids))
    assert len(i) > 5_000
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        if (new == low).all():
            break
        low = new
    assert got == {int(k): (int(n), int(c)) for k, n, c in zip(ids, links, low, strict=True)}


def test_vectors_are_not_copied_into_cells(spark):
    """Two thousand unrelated vectors in a hundred cells, and ids that come twice: shuffled bytes stay in proportion to the table."""
    rng = np.random.default_rng(8)
    x = np.float32(rng.normal(size=(2000, 64)))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, x[0].tolist()), (5000, (x[0] * 2 + x[1] / 10).tolist()), (5000, (-x[0]).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = shuffled()
    got = {}
    for r in embeddings.near_vectors(df, cell=20).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id))
    assert shuffled() - before < 6 * x.nbytes
    assert got[0] == [(2, 0)] and sorted(n for n, _ in got[5000]) == [0, 2, 2]
    assert all(got[i] == [(0, i)] for i in range(1, 2000))


def test_range_join_of_nothing(spark):
    df = spark.createDataFrame([(None, None), (1, None)], "vec_id long, embedding array<float>")
    assert embeddings.near_vectors(df).count() == 2
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_pipeline_stages(spark, odd, clashing, tmp_path, none):
    import corpus_pipeline

    labels = spark.createDataFrame([(100 + i, 1, int(i % 5 == 0)) for i in range(30)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", odd), ("clashing", clashing), ("none", none)):
        folder = f"{tmp_path}/{name}"
        docs.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, folder).columns == docs.columns
        assert set(corpus_pipeline.run(spark, folder).columns) >= {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, folder)
    clean = spark.read.parquet(f"{folder}/labels.parquet").where("toxic = 0").select("doc_id")
    assert kept.join(clean, "doc_id").count() == docs.join(clean, "doc_id").count()
    once = corpus_pipeline.STAGES[1][1](spark, kept, folder)
    assert once.select("doc_id").distinct().count() == once.count()
    hidden = corpus_pipeline.STAGES[2][1](spark, once, folder)
    assert hidden.count() == once.count() and hidden.where("text rlike 'AKIA[A-Z0-9]{14,}'").count() == 0


def test_pipeline_equals_brute_force_stage_by_stage(spark):
    """All stages on 1,000 documents, each against a plain version of it on what the stage before kept."""
    import zlib

    import corpus_pipeline
    import duckdb
    import public_tokenizers
    from test_documents import brute_classes, shingle_set
    from tokenizers import Tokenizer

    from rasterloom.llm import mixing, secrets, toxicity
    from rasterloom.llm.common import written

    folder = "/root/testdata/sf0.01"
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    rate = toxicity.rater(toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    listed = lambda df: sorted((r.asDict() for r in df.collect()), key=lambda r: r["doc_id"])

    kept = written(stages["toxicity"](spark, docs, folder), "kept")
    want = [r for r in rows if rate(r["text"] or "") < 0.3]
    assert listed(kept) == sorted(want, key=lambda r: r["doc_id"]) and len(want) < len(rows)

    once = written(stages["near_duplicates"](spark, kept, folder), "once")
    want.sort(key=lambda r: r["doc_id"])
    sets = [shingle_set(r["text"]) for r in want]
    classes = brute_classes(len(want), lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    want = [r for n, r in enumerate(want) if classes[n] == n]
    assert listed(once) == want and len(want) < len(sets)

    hidden = written(stages["secrets"](spark, once, folder), "hidden")
    for r in want:
        r["text"] = r["text"] and secrets.redacted(r["text"], secrets.base_spans(r["text"]) + secrets.confirmed_spans(r["text"]))
    assert listed(hidden) == want and any("[SECRET]" in (r["text"] or "") for r in want)

    mixed = written(stages["mixing"](spark, hidden, folder), "mixed")
    con = duckdb.connect()
    con.register("documents", hidden.toPandas())
    times = {r[0]: -(-r[4] // r[1]) if r[1] else 0 for r in con.sql(mixing.OP10_SQL).fetchall()}
    got = collections.Counter(r.doc_id for r in mixed.select("doc_id").collect())
    assert got == {k: n for k, n in times.items() if n}

    packed = stages["packing"](spark, mixed, folder).collect()
    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = collections.Counter()
    for r in want:
        ids = np.array([*full.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            pieces[(r["doc_id"], n, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += times[r["doc_id"]]
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == +pieces
    by = collections.defaultdict(list)
    for r in packed:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert [a for a, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))] and sum(n for _, n in places) <= 1024
    assert len(by) <= 1.02 * max(sum(k[3] * n for k, n in pieces.items()) / 1024, sum(n for k, n in pieces.items() if k[3] > 512)) + 3
