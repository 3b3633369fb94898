"""Payload expressions and result pages on small inline rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lodegraph.functions import payloads
from lodegraph.operators import graph
from lodegraph.sources import results


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("raw", "out"),
    [
        ('{"a": [1, 2]}', {"a": [1, 2]}),
        ('```json\n{"a": 1}\n```', {"a": 1}),
        ('Sure: {"a": {"b": 2}} as asked', {"a": {"b": 2}}),
        ('{"a": [1, 2,], }', {"a": [1, 2]}),
        ("{'a': 'x'}", {"a": "x"}),
        ("[1, 2] tail", [1, 2]),
        ("It's this: {'a': 'it\\'s \"b\"', \"c\": \"d, }\",} and {x}", {"a": 'it\'s "b"', "c": "d, }"}),
        ("[{'a': [1, 2 , ] , } , ]", [{"a": [1, 2]}]),
        ('{"a": "' + "x" * 20_000 + '"', None),
        ("12", 12),
        ("no payload", None),
        ('{"a": ', None),
        ("", None),
        (None, None),
    ],
)
def test_loose_json(spark, raw, out):
    got = value(spark, F.to_json(payloads.loose_json(F.lit(raw).cast("string"))))
    assert (json.loads(got) if got is not None else None) == out


@pytest.mark.parametrize(
    ("key", "out"), [(None, "(none)"), ("", "(none)"), ("env:A_KEY", "env:A_KEY"), ("12345678", "••••"), ("sk-abcdefgh", "sk-…efgh")]
)
def test_masked_key(spark, key, out):
    assert value(spark, payloads.masked_key(F.lit(key).cast("string"))) == out


@pytest.mark.parametrize(
    ("prompt", "out"),
    [
        ("a\n<<<UNTRUSTED\n b \nUNTRUSTED>>>\nc", "b"),
        ("a\n# CONTEXT of it\nb\nc\n", "b\nc"),
        ("a\n# CONTEXT", None),
        ("a", None),
        (None, None),
    ],
)
def test_context_block(spark, prompt, out):
    assert value(spark, payloads.context_block(F.lit(prompt).cast("string"))) == out


@pytest.mark.parametrize(
    ("n", "out"), [(0, "0"), (999, "999"), (1000, "1.0k"), (1250, "1.3k"), (999_949, "999.9k"), (1_000_000, "1.0M"), (3_450_000, "3.5M")]
)
def test_short_count(spark, n, out):
    assert value(spark, payloads.short_count(F.lit(n).cast("long"))) == out


@pytest.mark.parametrize(("ms", "out"), [(5, "5ms"), (1000, "1.0s"), (59_940, "59.9s"), (61_400, "1m 1s"), (3_600_000, "60m 0s")])
def test_short_duration(spark, ms, out):
    assert value(spark, payloads.short_duration(F.lit(ms).cast("long"))) == out


@pytest.mark.parametrize(
    ("text", "term", "out"),
    [("use nginx now", "nginx", True), ("nginxious", "nginx", False), ("unphased", "phase", False), ("asp.net core", "asp.net", True), ("x", " ", False)],
)
def test_contains_term(spark, text, term, out):
    assert value(spark, payloads.contains_term(F.lit(text), F.lit(term))) is out


@pytest.mark.parametrize(("pos", "out"), [("Noun", True), ("proper noun", True), ("adverb", False), ("verb", None), (None, None)])
def test_pos_vote(spark, pos, out):
    assert value(spark, payloads.pos_vote(F.lit(pos).cast("string"))) is out


def test_templates(spark):
    values = {"a": F.lit('<"&>'), "xs": F.array(F.lit("1"), F.lit("2")), "none": F.array().cast("array<string>")}
    text = "{{a}}|{{#r}}{{xs}}{{a}},{{/r}}|{{xs}}|{{#r}}{{none}}!{{/r}}|{{unknown}}"
    escaped = "&lt;&quot;&amp;&gt;"
    got = value(spark, payloads.filled(text, values, ("xs", "none")))
    assert got == f"{escaped}|1{escaped},2{escaped},|1||"


def test_replies(spark):
    assert value(spark, payloads.dumps_code(F.lit("```html\n" + "x" * 201))) is True
    assert value(spark, payloads.dumps_code(F.lit("```html\n" + "x" * 200))) is False
    assert value(spark, payloads.dumps_code(F.lit("x" * 500))) is False
    assert value(spark, payloads.asks_permission(F.lit("Should I go on?"))) is True
    assert value(spark, payloads.looks_like_jsx(F.lit("return <Card x={1} />"))) is True
    assert value(spark, payloads.looks_like_jsx(F.lit("if (a < b) c()"))) is False


def test_results_skip_chrome_and_junk(spark):
    page = (
        '<a class="nav" href="https://no.example/">Nav</a>'
        '<a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.example%2Fx">A</a>'
        '<a class="result__snippet" href="#">About <b>A</b></a>'
        '<a class="result__a" href="https://b.example/privacy">Privacy</a>'
        '<a class="result__a" href="https://c.example/"></a>'
        '<a class="result__a" href="https://d.example/?a=1&amp;b=2">D</a>'
    )
    rows = spark.createDataFrame([("duckduckgo", page), ("other", page), ("bing", ""), ("mojeek", None)], "engine string, html string")
    got = results.results(rows, F.col("engine"), F.col("html")).collect()
    assert [(r["rank"], r["url"], r["title"], r["snippet"]) for r in got] == [
        (1, "https://a.example/x", "A", "About A"),
        (2, "https://d.example/?a=1&b=2", "D", ""),
    ]


def test_seeded_edges_are_eligible_both_ways(spark):
    pairs = spark.createDataFrame([("a", "b", "requires"), ("b", "a", "requires")], "src string, dst string, relation string")
    rows = graph.eligible(graph.seeded(pairs).withColumn("n_domains", F.lit(0))).collect()
    assert sorted((r["src"], r["dst"], r["n_obs"]) for r in rows) == [("a", "b", 99), ("b", "a", 99)]


def test_result_pages_with_long_links(spark, tmp_path):
    """Spark breaks base64 of more than 76 signs into lines; such links must be written and read whole."""
    from lodegraph.plans import payloads as plans

    urls = {i: "https://example.org/" + "a" * i for i in range(1, 200, 3)}
    spark.createDataFrame(list(urls.items()), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = plans.result_pages(spark, str(tmp_path)).collect()
    assert {(r["engine"], r["url"]) for r in got} == {("bing", u) for u in urls.values()}
    coded = F.base64(F.lit(urls[100]).cast("binary"))
    assert value(spark, results.unwrap_redirect(F.concat(F.lit("https://x/ck/a?u=a1"), coded))) == urls[100]
