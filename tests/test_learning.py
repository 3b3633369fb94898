"""Learning from pages: records against a plain reading, deliveries against a rebuild."""

from __future__ import annotations

import collections
import random

import pytest

from lodegraph.operators import learning

NAMES = ["redis", "nginx", "apache", "kafka", "postgres"]


def as_pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, domain string, text string")


def test_records(spark):
    rows = [
        (1, "a", "You need redis for this. We like nginx or apache here; kafka is fine. Redis again."),
        (2, "a", "nginx."),
        (3, None, None),
        (4, "b", "Either redis, nginx, apache, kafka or postgres will do, all five of them."),
        (5, "b", " \n "),
    ]
    got = {r["page_id"]: r for r in learning.records(as_pages(spark, rows), "page_id", NAMES).collect()}
    first = {t["term"]: (t["confidence"], t["context"], t["sentence"]) for t in got[1]["terms"]}
    assert first == {
        "redis": (0.6, "requirements-list", 0), "nginx": (0.25, "prose", 1), "apache": (0.25, "prose", 1), "kafka": (0.25, "prose", 2),
    }
    assert [(m["term"], m["sentence"]) for m in got[1]["mentions"]].count(("redis", 3)) == 1
    assert [tuple(p) for p in got[1]["alternatives"]] == [("apache", "nginx")]
    assert got[4]["alternatives"] == [] and len(got[4]["terms"]) == 5  # five are a list, not a choice
    assert {i: r["skipped"] for i, r in got.items()} == {1: None, 2: "only 0 terms", 3: "empty", 4: None, 5: "empty"}
    assert learning.records(as_pages(spark, rows), "page_id", []).where("skipped is null").count() == 0


def test_glue_goes_unless_more_than_prose_speaks_for_it(spark):
    pages = as_pages(spark, [(1, "a", "You need redis for this. There is nginx and kafka.")])
    rows = learning.records(pages, "page_id", NAMES)
    assert learning.taught(rows, "page_id", ["redis", "nginx"]).first()["held"] == ["kafka", "redis"]
    breadth = spark.createDataFrame([("redis", 0.5), ("nginx", 0.1), ("other", 0.9)], "term string, breadth double")
    assert learning.glue(breadth, NAMES) == ["redis"]


def taught(spark, rows):
    choices = [(k, d, sorted(h), [p for p in zip(sorted(h), sorted(h)[1:]) if hash(p) % 3]) for k, d, h in rows]
    return spark.createDataFrame(choices, "page_id long, domain string, held array<string>, alternatives array<struct<a:string,b:string>>")


def told(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.mark.parametrize("seed", range(2))
def test_deliveries_equal_a_rebuild(spark, seed):
    """Pages fetched again, changed and removed; unknown keys removed; a page removed and fetched again."""
    rng = random.Random(seed)
    draw = lambda k: (k, rng.choice("abc") if rng.random() < 0.9 else None, rng.sample(NAMES, rng.randint(0, 4)))
    known, now = learning.Knowledge.new(spark, "page_id"), {}
    for step in range(4):
        rows = [draw(k) for k in rng.sample(range(25), 12)]
        if step and now:
            rows[0] = now.get(rows[0][0], rows[0])  # as it was
        gone = [] if step == 0 else rng.sample(range(30), 5)
        before = collections.Counter(p for _, _, h in now.values() for p in pairs_of(h))
        known, report = known.deliver(taught(spark, rows), spark.createDataFrame([(k,) for k in gone], "page_id long") if step else None)
        now.update({r[0]: r for r in rows})
        now = {k: r for k, r in now.items() if k not in gone}
        after = collections.Counter(p for _, _, h in now.values() for p in pairs_of(h))
        want = {(*p, before[p], after[p]) for p in {*before, *after} if before[p] != after[p]}
        assert {tuple(r) for r in report.collect()} == want
    rebuilt, _ = learning.Knowledge.new(spark, "page_id").deliver(taught(spark, list(now.values())))
    assert told(known.edges()) == told(rebuilt.edges())
    small = known.compact()
    assert len(small.deliveries) == 1 and told(small.edges()) == told(rebuilt.edges())
    last, _ = small.deliver(taught(spark, []), spark.createDataFrame([(k,) for k in now], "page_id long"))
    assert last.edges().collect() == [] and last.pages().collect() == []


def pairs_of(held):
    held = sorted(held)
    return [(a, b) for i, a in enumerate(held) for b in held[i + 1 :]]


def test_filters_on_records_do_not_read_the_pages_again(spark):
    """A filter below the records would spell out all mentions for each mention."""
    rows = learning.records(as_pages(spark, [(1, "a", "You need redis and nginx.")]), "page_id", NAMES)
    plan = learning.taught(rows, "page_id", ["redis"])._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and learning.taught(rows, "page_id", []).first()["held"] == ["nginx", "redis"]


def test_delivered_drafts_hold_whole_texts(spark, tmp_path, monkeypatch, compare):
    """No delivery is cut: each page's last word is in all its forms; drafts teach more than their pages, and it is taken back."""
    import duckdb

    from lodegraph.plans import catalogue

    said = lambda i: f"You need alpha{i // 4} and beta{i // 4}. " + "Words between. " * 20 + f"Either gamma{i % 15} or alpha{i // 4} is required, last{i}."
    rows = [(i, f"https://site{i % 7}.example/{i}", f"<html><body><p>{said(i)}</p></body></html>") for i in range(60)]
    rows += [(60 + i, f"https://site{i}.example/{i}", f"<p>{text}</p>") for i, text in enumerate(["", " ", "alpha3", "beta2 alone"])]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    seen, records = [], learning.records
    monkeypatch.setattr(learning, "records", lambda pages, *more: seen.append(pages) or records(pages, *more))
    found = catalogue.queries()["ingest_delta"](spark, str(tmp_path)).cache()
    forms = [r for pages in seen for r in pages.where("page_id between 0 and 59").collect()]
    assert 60 < len(forms) < 120 and all(f"last{r['page_id']}" in r["text"] for r in forms)
    assert any(r["domain"] is None for r in forms)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert found.count() > 0 and {r["relation"] for r in found.collect()} == {"together", "alternative"}
    compare(found, con, catalogue.oracle_sql()["ingest_delta"])
