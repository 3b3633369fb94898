"""Operators on inline rows."""

import pytest
from pyspark.sql import functions as F

from lodegraph.functions import scores, text, web
from lodegraph.operators import corpus, extraction, fusion, graph, tables, vectors
from lodegraph.sources import lines


def column(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("counts", "low", "high"),
    [
        ((100, 10, 10, 10), 0.9, 1.0),
        ((100, 10, 10, 1), -0.01, 0.01),
        ((100, 10, 10, 0), -1.0, -1.0),
        ((7, 3, 3, 3), 0.0, 0.0),
        ((50, 50, 50, 50), 0.0, 0.0),
    ],
)
def test_npmi(spark, counts, low, high):
    assert low <= column(spark, scores.npmi(*[F.lit(c) for c in counts])) <= high


def test_npmi_prefers_specific_partners(spark):
    rare = column(spark, scores.npmi(*[F.lit(c) for c in (1000, 20, 120, 18)]))
    assert rare > column(spark, scores.npmi(*[F.lit(c) for c in (1000, 20, 800, 20)]))


@pytest.mark.parametrize(("w", "out"), [(0.4, 0.0), (0.7, 0.5), (1.0, 1.0), (0.1, 0.0)])
def test_rescale(spark, w, out):
    assert column(spark, scores.rescale_weight(F.lit(w), 0.4)) == pytest.approx(out)


def test_rrf_prefers_agreement(spark):
    rows = [(1, "bm25", 1, 1, 9.0), (1, "bm25", 2, 2, 5.0), (1, "vector", 3, 1, 0.9), (1, "vector", 2, 2, 0.8)]
    fused = fusion.rrf(spark.createDataFrame(rows, "query_id int, retriever string, id int, rank int, score double"))
    best = fused.orderBy(F.col("rrf").desc()).first()
    assert best["id"] == 2 and best["rrf"] == pytest.approx(2 / 62) and set(best["sources"]) == {"bm25", "vector"}


SIGNALS = "query_id long, top_cosine double, median_cosine double, top_bm25 double, top_bm25_rare double, retrievers_agree boolean, has_rare boolean, top_exact double"


@pytest.mark.parametrize(
    ("signal", "routed"),
    [
        ((0.50, 0.347, 9.0, 2.17, False, True, 0.0), False),
        ((0.55, 0.31, 9.83, 9.83, True, True, 0.0), True),
        ((0.40, 0.291, 5.25, 5.25, False, True, 0.0), True),
        ((0.60, 0.238, 0.0, 0.0, False, True, 1.0), True),
        ((0.60, 0.397, 0.0, 0.0, False, False, 0.0), True),
        ((0.60, 0.30, 9.0, 0.0, True, True, 0.0), False),
    ],
)
def test_gate(spark, signal, routed):
    fused = spark.createDataFrame([(1, 10, 0.09), (1, 11, 0.05), (1, 12, 0.0001)], "query_id long, id long, rrf double")
    decided = fusion.seed_gate(fused, spark.createDataFrame([(1, *signal)], SIGNALS), fusion.Gate(relative_floor=0.6))
    verdict = {r["id"]: r["verdict"] for r in decided.collect()}
    assert verdict[10] == ("SEED" if routed else "BELOW_THRESHOLD")
    assert verdict[11] == ("NEAR_MISS" if routed else "BELOW_THRESHOLD") and verdict[12] == "BELOW_THRESHOLD"
    assert fusion.knowledge_gaps(decided).first()["gap"] is not routed


def test_gate_caps_seeds(spark):
    fused = spark.createDataFrame([(1, i, 0.05) for i in range(8)], "query_id long, id long, rrf double")
    signal = spark.createDataFrame([(1, 0.9, 0.1, 9.0, 9.0, True, False, 1.0)], SIGNALS)
    verdicts = [r["verdict"] for r in fusion.seed_gate(fused, signal).orderBy("id").collect()]
    assert verdicts == ["SEED"] * 6 + ["OVER_CAP"] * 2


@pytest.mark.parametrize(
    ("a", "b", "out"), [([1.0, 2.0], [2.0, 4.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0], [-3.0], -1.0), ([0.0], [1.0], 0.0)]
)
def test_cosine(spark, a, b, out):
    assert column(spark, vectors.cosine(F.array(*map(F.lit, a)), F.array(*map(F.lit, b)))) == pytest.approx(out)


def test_middle_of_even_list(spark):
    rows = spark.createDataFrame([(i, [float(x), 1.0]) for i, x in enumerate((4, 3, 2, 1))], "id long, vec array<double>")
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vec array<double>")
    out = vectors.field_statistics(queries, rows).first()
    assert out["middle"] == pytest.approx(2 / 5**0.5, abs=1e-8)


def clique(spark, n, weight):
    rows = [(a, b, weight, weight, 5, 3, 0) for a in range(n) for b in range(n) if a != b]
    return graph.with_brake(
        graph.capped(spark.createDataFrame(rows, "src long, dst long, npmi double, weight double, n_obs int, n_domains int, seeded int"), 5)
    )


@pytest.mark.parametrize(("weight", "active"), [(0.3, 1), (0.95, 6)])
def test_cliques_do_not_flood(spark, weight, active):
    seeds = spark.createDataFrame([(1, 0)], "query_id long, id long")
    state, _ = graph.spread_activation(seeds, clique(spark, 60, weight), 1)
    assert state.where("activation >= 0.5").count() == active


def test_activation_of_one_edge(spark):
    seeds = spark.createDataFrame([(1, 0)], "query_id long, id long")
    edge = spark.createDataFrame([(0, 1, 0.9)], "src long, dst long, weight double")
    state, _ = graph.spread_activation(seeds, graph.with_brake(edge), 2)
    assert {r["id"]: round(r["activation"], 3) for r in state.collect()} == {0: 1.0, 1: 0.542}


def test_alternatives_keep_the_stronger(spark):
    active = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.6), (1, 12, 0.8)], "query_id long, id long, activation double")
    out = graph.resolve_alternatives(active, spark.createDataFrame([(11, 10)], "a long, b long"))
    assert {r["id"]: r["in_favour_of"] for r in out.collect()} == {10: None, 11: 10, 12: None}


@pytest.mark.parametrize(
    ("raw", "canon"),
    [("php8.3-fpm", "php-fpm"), ("mariadb-server", "mariadb"), ("nginx=1.24.0", "nginx"), ("the", None), ("7", None), ("libssl", "ssl")],
)
def test_canon_token(spark, raw, canon):
    assert column(spark, text.canon_token(F.lit(raw))) == canon


def test_tokens(spark):
    assert column(spark, text.tokens(F.lit("Über php-fpm, -x- a 8.3. C++!"))) == ["über", "php-fpm", "8.3", "c++"]


@pytest.mark.parametrize(
    "url", ["https://www.Example.com/a/?b=1&utm_source=x#top", "https://example.com/a?b=1&ref=y", "https://example.com/a/?b=1"]
)
def test_urls_collapse(spark, url):
    assert column(spark, web.normalise_url(F.lit(url))) == "https://example.com/a?b=1"
    assert column(spark, web.domain_of(F.lit(url))) == "example.com"


def test_bad_urls(spark):
    assert column(spark, web.domain_of(F.lit("no url"))) == "" and column(spark, web.is_junk(F.lit("ftp://x/y")))
    wrapped = "//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.b%2Fc&rut=1"
    assert column(spark, web.unwrap_redirect(F.lit(wrapped))) == "https://a.b/c"
    assert column(spark, web.unwrap_redirect(F.lit("https://x/ck/a?u=a1aHR0cHM6Ly9hLmIvYw&z"))) == "https://a.b/c"


def test_html(spark):
    html = "<title>A &amp;lt; b</title><script>x</script><p>one</p>two<pre>apt install nginx</pre><!-- no -->"
    assert column(spark, web.title_of(F.lit(html))) == "A &lt; b"
    assert "no" not in column(spark, web.text_of(F.lit(html))).split() and "one" in column(spark, web.text_of(F.lit(html)))
    assert column(spark, web.code_of(F.lit(html))) == "apt install nginx"


def test_prose_requirement_branch(spark):
    rows = spark.createDataFrame([(1, "This panel requires redis. Nothing of redis here")], "id int, t string")
    out = extraction.from_prose(rows, "id", F.col("t"), ["redis"]).orderBy("sentence").collect()
    assert [(r["sentence"], r["confidence"]) for r in out] == [(0, 0.6), (1, 0.25)]


@pytest.mark.parametrize(("a", "b", "ratio"), [((0, 0, 0), (255, 255, 255), 21.0), ((9, 9, 9), (9, 9, 9), 1.0)])
def test_contrast(spark, a, b, ratio):
    got = scores.contrast(scores.luminance(*[F.lit(x) for x in a]), scores.luminance(*[F.lit(x) for x in b]))
    assert column(spark, got) == pytest.approx(ratio)


def test_bucket_bursts_and_refills(spark):
    rows = [("a", 0, i, 1) for i in range(4)] + [("a", 60_000, 9, 1), ("b", 0, 5, 3)]
    out = tables.token_bucket(spark.createDataFrame(rows, "key string, at_ms long, id long, cost int"), 3.0, 1.0)
    got = {(r["key"], r["id"]): (r["allowed"], r["retry_after"]) for r in out.collect()}
    assert [got["a", i][0] for i in range(4)] == [True, True, True, False] and got["a", 3][1] == 60
    assert got["a", 9][0] and got["b", 5][0]


def test_pacing_and_stalls(spark):
    rows = spark.createDataFrame([("k", 0, 1, 0), ("k", 1, 2, 0), ("k", 50, 3, 1)], "key string, at long, id long, ok int")
    assert [r["release"] for r in tables.paced(rows, 10).orderBy("id").collect()] == [0, 10, 50]
    assert [r["stalled"] for r in tables.stalled(rows, "key", "id", last=2).orderBy("id").collect()] == [False, True, False]


def test_lines(spark):
    rows = spark.createDataFrame([('{"a": 1}',), ("broken {",), ("",)], "value string")
    assert [r["a"] for r in lines.ndjson(rows, "a int").collect()] == [1]
    sse = [(1, 1, "event: t"), (1, 2, "data: x"), (1, 3, "data: y"), (1, 4, ""), (1, 5, ": c"), (1, 6, "data: [DONE]")]
    got = lines.server_events(spark.createDataFrame(sse, "s int, n int, value string"), "s", "n").collect()
    assert sorted((r["event"], r["data"]) for r in got) == [("message", "[DONE]"), ("t", "x\ny")]


def test_effort_and_shades(spark):
    from lodegraph.operators import profiles

    assert column(spark, profiles.parse_effort(F.lit(" HIGH "))) == "high"
    assert column(spark, profiles.parse_effort(F.lit("none"))) == "medium"
    step = profiles.accessible_shade(F.lit(200.0), F.lit(200.0), F.lit(200.0), F.lit(1.0), 4.5)
    assert column(spark, step) == 9


@pytest.mark.parametrize(("brief", "medium"), [("a Tkinter form", "tkinter"), ("landing page", "web"), ("poem", "generic")])
def test_medium(spark, brief, medium):
    assert column(spark, text.medium_of(F.lit(brief))) == medium


def test_question_shaping(spark):
    assert column(spark, text.content_tokens(F.lit("are cows evil?"))) == ["cows", "evil"]
    assert column(spark, text.content_tokens(F.lit("how do I?"))) == ["how", "do", "i"]


def test_entities(spark):
    assert column(spark, text.entities(F.lit('why does "the panel" need php8.3-fpm'))) == ["the panel", "php8.3-fpm"]
    assert column(spark, text.entities(F.lit("baking bread with flour"))) == ["baking", "bread", "flour"]


def test_upsert_keeps_what_blanks_would_erase(spark):
    now = spark.createDataFrame([(1, "a", "x", 1), (2, "b", "y", 0)], "id int, name string, kind string, seeded int")
    new = spark.createDataFrame([(1, "", None, 0), (3, "c", "z", 1)], "id int, name string, kind string, seeded int")
    got = tables.upsert(now, new, "id", ["name", "kind"], ["seeded"]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "a", "x", 1), (2, "b", "y", 0), (3, "c", "z", 1)]


def test_stream_agrees_with_batch(spark, tmp_path):
    from lodegraph.streaming import state

    rows = [(k, at, i, 1) for i, (k, at) in enumerate([("a", 0), ("a", 1), ("b", 5), ("a", 2), ("a", 90_000), ("b", 6)])]
    table = spark.createDataFrame(rows, "key string, at_ms long, id long, cost int")
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    got = state.run_once(state.token_bucket(stream, 2.0, 1.0), str(tmp_path / "out"))
    want = tables.token_bucket(table, 2.0, 1.0)
    key = lambda df: sorted(tuple(r) for r in df.select("key", "id", "allowed", "retry_after").collect())
    assert key(got) == key(want)


def test_buckets_are_forgotten_after_their_time_to_live(spark, tmp_path):
    """A bucket emptied by one file is full again in the next if its state has run out in between."""
    import time

    from lodegraph.streaming import state

    schema = "key string, at_ms long, id long, cost int"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([("a", 0, 1, 2), ("a", 1, 2, 1)])
    stream = state.token_bucket(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 2.0, 0.001, idle_ms=1_500)
    with state.keyed_state(spark):
        running = stream.writeStream.format("memory").queryName("buckets").option("checkpointLocation", str(tmp_path / "c")).start()

    def wait(rows):
        deadline = time.time() + 60
        while spark.table("buckets").count() < rows and time.time() < deadline:
            time.sleep(0.5)

    try:
        wait(2)
        time.sleep(2)
        put([("a", 2, 3, 2)])
        wait(3)
    finally:
        running.stop()
    assert {r["id"]: r["allowed"] for r in spark.table("buckets").collect()} == {1: True, 2: False, 3: True}


def test_names_of_any_length_are_found(spark):
    texts = spark.createDataFrame([(1, " the one two three four five way "), (2, " one two three four ")], "id long, text string")
    names = spark.createDataFrame([("one two three four five",), ("two",)], "name string")
    got = corpus.ngram_hits(texts, "id", F.col("text"), names).collect()
    assert sorted((r["id"], r["name"]) for r in got) == [(1, "one two three four five"), (1, "two"), (2, "two")]


def test_references_are_decoded_once(spark):
    said = "a &amp;lt; b &#8217;&#x1F600; &copy;&nbsp;x &unknown; &#0;&#xD800; & &auml;&#160;."
    assert column(spark, web.decode_entities(F.lit(said))) == "a &lt; b ’😀 © x &unknown; &#0;&#xD800; & ä ."
    assert column(spark, web.decode_entities(F.lit("plain"))) == "plain" and column(spark, web.decode_entities(F.lit(None).cast("string"))) is None


def test_bags_count_words_in_their_row(spark):
    rows = spark.createDataFrame([(1, "b a b", "c"), (2, None, "a a"), (3, "", "")], "id long, x string, y string")
    rows = rows.select("id", F.replace("x", F.lit(" "), F.lit("1 ")).alias("x"), F.col("y"))
    got = {r["id"]: r for r in corpus.bags(rows, "id", {"x": 2.0, "y": 1.0}).collect()}
    assert [tuple(t) for t in got[1]["terms"]] == [("a1", 2.0), ("b1", 2.0)] and got[1]["length"] == 2
    assert got[2]["length"] is None and got[3]["terms"] == [] and got[3]["length"] == 0


@pytest.mark.parametrize("seed", range(3))
def test_pruned_search_finds_the_same(spark, seed):
    import random

    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choices(words, [1 / (i + 1) ** 1.2 for i in range(40)], k=n))
    docs = spark.createDataFrame([(i, text(rng.randint(0, 25))) for i in range(150)] + [(500, None)], "id long, text string")
    asked = corpus.asked_terms(spark.createDataFrame([(i, text(rng.randint(1, 8))) for i in range(25)] + [(90, "w0 w1"), (91, "none")], "query_id long, text string"))
    index = corpus.Index.build(docs, "id", {"text": 1.0})
    rows = lambda df: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 8)) for r in df.collect())
    assert rows(corpus.bm25_top(asked, index, 5)) == rows(corpus.top_k(corpus.bm25(asked, index), "id", 5))


def test_vectors_in_many_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(0)
    data = [(i, rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(90)] + [(95, None), (96, [0.0] * 4)]
    rows = spark.createDataFrame(data, "id long, vec array<double>")
    asked = rows.where("id % 4 = 0").withColumnRenamed("id", "query_id")
    plain = lambda df: sorted(tuple(round(x, 7) if isinstance(x, float) else x for x in r) for r in df.collect())
    every = lambda: [
        plain(corpus.top_k(vectors.similarities(asked, rows, 3), "id", 3)),
        plain(vectors.similarities(asked, rows)),
        plain(vectors.field_statistics(asked, rows)),
        plain(vectors.best_over_queries(asked, rows)),
    ]
    whole = every()
    scores = {}
    for q, _, s in [r[:3] for r in whole[1]]:
        scores.setdefault(q, []).append(s)
    for q, top, middle, _ in whole[2]:
        down = sorted(scores[q], reverse=True)
        assert (top, middle) == (pytest.approx(down[0], abs=1e-6), pytest.approx(down[len(down) // 2], abs=1e-6))
    monkeypatch.setattr(vectors, "BLOCK", 7)
    monkeypatch.setattr(vectors, "CHUNK", 20)
    assert every() == whole


def test_slices_give_what_one_window_gives(spark):
    import random

    from pyspark.sql import Window

    from lodegraph.operators import ordered

    rng = random.Random(4)
    rows = spark.createDataFrame([(rng.choice("ab"), rng.randint(0, 400), i) for i in range(120)] + [(None, 5, 200)], "key string, at long, id long")
    order = Window.partitionBy("key").orderBy("at", "id")
    i = F.row_number().over(order) - 1
    plain = rows.withColumn("i", i).withColumn("release", F.max(F.col("at") - 3 * F.col("i")).over(order) + 3 * F.col("i"))
    of = lambda df, *c: sorted(map(repr, (tuple(r) for r in df.select(*c).collect())))
    assert of(tables.paced(rows.where("key is not null"), 3, 50), "id", "release") == of(plain.where("key is not null"), "id", "release")
    numbered = ordered.numbered(rows, ["key"], F.floor(F.col("at") / 50), "at", "id")
    assert of(numbered.withColumn("i", F.col("place") - 1), "id", "i") == of(plain, "id", "i")
    spans = rows.select("key", F.col("at").alias("begin"), (F.col("at") + 30).alias("end"))
    assert of(tables.concurrency_peak(spans, "key", 50), "key", "peak") == of(tables.concurrency_peak(spans, "key", 100_000), "key", "peak")
    near = tables.within_budget(rows, "key", F.lit(1), 7, F.col("at"), F.col("id"), parts=5)
    assert of(near, "id") == of(plain.where("i < 7"), "id")


def test_only_committed_versions_are_read(spark, tmp_path):
    from lodegraph.sources.tables import commit, latest

    root = str(tmp_path / "t")
    commit(spark.range(3), root)
    commit(spark.range(5), root)
    commit(spark.range(9), root, publish=False)
    assert latest(spark, root).count() == 5


def test_pages_are_learned_once_and_the_lexicon_grows(spark, tmp_path):
    from lodegraph.streaming import state

    for n, part in enumerate([[("u1", "alpha beta"), ("u2", "beta")], [("u2", "gone"), ("u3", "alpha gamma")]]):
        spark.createDataFrame(part, "url string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        words = lambda pages: pages.select(F.explode(F.split("text", " ")).alias("term")).distinct()
        cut = lambda pages: pages.select("url", F.explode(F.split("text", " ")).alias("term"))
        held = lambda pages, terms: cut(pages).join(terms, "term").groupBy("url").agg(F.sort_array(F.collect_set("term")).alias("t"))
        stream = spark.readStream.schema("url string, text string").parquet(str(tmp_path / "in"))
        state.learn_stream(stream, str(tmp_path / "out"), words, held).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "evidence")).collect()
    assert sorted((r["url"], r["t"]) for r in got) == [("u1", ["alpha", "beta"]), ("u2", ["beta"]), ("u3", ["alpha", "gamma"])]


def test_recovered_calls_in_odd_texts():
    from lodegraph.operators.calls import calls_of

    names = frozenset({"run"})
    assert calls_of('x {"name": "run", "arguments": {"a": "} {"}} y {"function": {"name": "run"}}', names) == [
        {"name": "run", "arguments": '{"a": "} {"}'}, {"name": "run", "arguments": None}
    ]
    assert calls_of('{"name": "run", "arguments": "open', names) == [] and calls_of("{{}} [] } {", names) == []
    assert calls_of('{"name": "run", "function": 3} {"name": 7}', names) == [{"name": "run", "arguments": None}]


def test_tasks_hold_few_scores_at_once(spark, monkeypatch):
    """Scores of questions and rows are made in slices, with the same best rows as at once."""
    import random

    from lodegraph.operators import vectors

    rng = random.Random(3)
    rows = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(300)], "id long, vec array<double>").coalesce(1)
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vec")
    told = lambda df: sorted((r["query_id"], r["id"], round(r["score"], 9)) for r in corpus.top_k(df, "id", 5).collect())
    whole = told(vectors.similarities(asked, rows, 5))
    monkeypatch.setattr(vectors, "CELLS", 100)
    assert told(vectors.similarities(asked, rows, 5)) == whole and len(whole) == 75

    class Sizes:
        def __init__(self, ids, extra):
            self.most = 0

        def add(self, own, score):
            self.most = max(self.most, score.size)
            return iter(())

        def end(self):
            import pyarrow as pa

            yield pa.RecordBatch.from_pydict({"most": [self.most]})

    sizes = vectors._searched(asked.withColumn("extra", F.lit(0)), rows, "most long", Sizes)
    assert sizes.agg(F.max("most")).first()[0] <= 100


def test_shades_compute_each_luminance_once(spark):
    """Named values, not copies of their expressions: three components of the ground and three of the mixed colour."""
    from lodegraph.functions.scores import luminance
    from lodegraph.operators.profiles import accessible_shade

    rows = spark.createDataFrame([(200, 200, 200, 250), (0, 0, 0, 255), (255, 255, 255, 100), (None, 1, 1, 1)], "r int, g int, b int, k int")
    ground = luminance(F.col("k"), F.col("k"), F.col("k"))
    shade = rows.select(accessible_shade(F.col("r"), F.col("g"), F.col("b"), ground, 4.5).alias("step"))
    assert shade._jdf.queryExecution().optimizedPlan().toString().upper().count("POWER(") <= 6
    linear = lambda v: v / 255 / 12.92 if v / 255 <= 0.03928 else ((v / 255 + 0.055) / 1.055) ** 2.4

    def plain(v, k):
        back, goal = linear(k), 0 if linear(k) > 0.35 else 255
        lum = {i: linear(int(v + (goal - v) * i / 20 + 0.5)) for i in range(1, 21)}
        return next((i for i, x in lum.items() if (max(x, back) + 0.05) / (min(x, back) + 0.05) >= 4.5), None)

    assert [r["step"] for r in shade.collect()] == [plain(200, 250), plain(0, 255), plain(255, 100), None]


def test_canonical_names_are_made_after_the_words_are_distinct(spark):
    from lodegraph.plans import texts

    from .conftest import DATA

    plan = texts.canon_tokens(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "server|client|common" not in plan[plan.index("Aggregate") :]


def test_tokens_are_those_of_cut_and_trimmed_words(spark):
    texts = ["", None, "-", "a-", "-a-b.", "..a..", "a b cd -e. f-g .-.", "Ünï-Çode İstanbul ΣΑΣ x²", "𝒜𝒷 𝒜 日本語 한 é", "a.b.c... c++ c# -.-a-.-b"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id long, x string")
    parts = F.split(F.lower("x"), r"[^\p{L}\p{N}_+#.\-]+")
    plain = F.filter(F.transform(parts, lambda t: F.btrim(t, F.lit("-."))), lambda t: F.length(t) >= 2)
    found = rows.select("id", plain.alias("plain"), text.tokens(F.col("x")).alias("t"))
    assert all(r["plain"] == r["t"] for r in found.collect())
    bags = {r["id"]: r for r in corpus.bags(rows, "id", {"x": 1.0}).collect()}
    for r in found.collect():
        words = r["plain"] or []
        assert bags[r["id"]]["length"] == (None if r["plain"] is None else len(words))
        assert [tuple(t) for t in bags[r["id"]]["terms"]] == [(w, float(words.count(w))) for w in sorted(set(words), key=str.encode)]


def test_bags_add_up_what_fields_share(spark):
    rows = spark.createDataFrame([(1, "aa bb aa", "aa cc")], "id long, x string, y string")
    got = corpus.bags(rows, "id", {"x": 4.0, "y": 1.0}).first()
    assert [tuple(t) for t in got["terms"]] == [("aa", 9.0), ("bb", 4.0), ("cc", 1.0)] and got["length"] == 5


def test_pairs_are_counted_before_they_travel(spark):
    rows = [("x", ["a", "b", "c"]), ("x", ["a", "b"]), ("y", ["a", "b"]), (None, ["b", "c"]), ("y", []), ("y", ["a"]), ("z", None)]
    held = spark.createDataFrame(rows, "domain string, held array<string>")
    found = graph.cooccurrence(held)
    assert sorted(tuple(r) for r in found.collect()) == [("a", "b", 3, 2), ("a", "c", 1, 1), ("b", "c", 2, 1)]
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_sentences_are_cut_once(spark):
    rows = spark.createDataFrame([(1, "You need nginx or apache. Short. nginx nginx and redis run.\n\nno names here"), (2, None)], "id long, x string")
    names = ["nginx", "apache", "redis"]
    prose, pairs = extraction.from_prose(rows, "id", F.col("x"), names), extraction.alternatives(rows, "id", F.col("x"), names)
    assert sorted((r["sentence"], r["term"], r["context"], r["confidence"]) for r in prose.collect()) == [
        (0, "apache", "requirements-list", 0.6), (0, "nginx", "requirements-list", 0.6), (2, "nginx", "prose", 0.25), (2, "redis", "prose", 0.25),
    ]
    assert [tuple(r) for r in pairs.collect()] == [(1, 0, "apache", "nginx")]
    for df in (prose, pairs):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") == plan.count("regexp_extract_all(") == 1


def test_scores_are_binned_once(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7 - 3), 1.0, float(i % 3)]) for i in range(60)], "id long, vec array<double>")
    asked = rows.where("id % 4 = 0").withColumnRenamed("id", "query_id")
    for block, step in ((2048, "MapInArrow"), (7, "FlatMapCoGroupsInArrow")):
        monkeypatch.setattr(vectors, "BLOCK", block)
        plan = vectors.field_statistics(asked, rows)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(step) == 1  # the second pass alone: bins were written


def test_every_task_looks_for_a_part_of_a_stream(spark, tmp_path, monkeypatch):
    from lodegraph.streaming import state

    plans, write = [], type(spark.range(0).write).parquet
    monkeypatch.setattr(type(spark.range(0).write), "parquet", lambda self, *a, **b: (plans.append(self._df.rdd.getNumPartitions()), plans.append("Coalesce" in self._df._jdf.queryExecution().executedPlan().toString()), write(self, *a, **b))[-1])
    state.in_parts(spark.range(0, 100, 1, 4), F.col("id") % 2, 2, str(tmp_path / "in"))
    assert plans == [1, False] * 2
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "in")).collect()) == list(range(100))
