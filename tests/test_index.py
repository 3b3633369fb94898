"""Stored index, phrases, stems and the ranking of documents against plain versions."""

from __future__ import annotations

import collections
import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodegraph.functions import stems as porter
from lodegraph.functions.stems import stemmed
from lodegraph.operators import corpus, inverted, ranking
from lodegraph.operators.inverted import Inverted

# Pairs of Porter's paper.
STEMS = (
    "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing "
    "conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail "
    "filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit "
    "conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam "
    "predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal "
    "sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical "
    "electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop "
    "adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt "
    "homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize "
    "bowdler probate probat rate rate cease ceas controll control roll roll is is c++ c++ über über"
)


def test_stems(spark):
    words = STEMS.split()
    pairs = dict(zip(words[::2], words[1::2]))
    rows = stemmed(spark.createDataFrame([(w, w) for w in pairs], "word string, stem string"), "stem").collect()
    assert {r["word"]: r["stem"] for r in rows} == pairs


def corpus_of(seed, n):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    return {i: [rng.choice(words) for _ in range(rng.choice([0, 3, 20, 60]))] for i in range(n)}


def plain_scores(texts, asked):
    """BM25 by definition; ids and scores per question, best first."""
    n, mean = len(texts), sum(map(len, texts.values())) / len(texts)
    counts = {i: collections.Counter(t) for i, t in texts.items()}
    out = {}
    for q, terms in asked.items():
        found = {}
        for t in set(terms):
            df = sum(t in c for c in counts.values())
            idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6) if df else 0
            idf = idf if idf > 0 else 1e-6
            for i, c in counts.items():
                if t in c:
                    found[i] = found.get(i, 0) + idf * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(texts[i]) / mean))
        out[q] = sorted(found.items(), key=lambda x: (-round(x[1], 9), x[0]))
    return out


def told(df):
    out = collections.defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["id"], round(r["score"], 6)))
    return dict(out)


def as_rows(spark, texts):
    return spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "id long, text string")


@pytest.fixture(scope="module")
def asked():
    rng = random.Random(9)
    return {q: [f"w{int(rng.paretovariate(0.5))}" for _ in range(rng.randint(1, 9))] for q in range(25)}


def asked_rows(spark, asked):
    return spark.createDataFrame([(q, t) for q, ts in asked.items() for t in set(ts)], "query_id long, term string")


@pytest.mark.parametrize(("group", "sampled"), [(16_384, 16), (10, 4)])
def test_ranking_is_exact(spark, asked, monkeypatch, group, sampled):
    """Whether or not there are groups enough for a first threshold."""
    monkeypatch.setattr(ranking, "GROUP", group)
    monkeypatch.setattr(ranking, "SAMPLED", sampled)
    texts = corpus_of(1, 300)
    want = {q: [(i, round(s, 6)) for i, s in rows[:7]] for q, rows in plain_scores(texts, asked).items() if rows}
    index = corpus.Index.build(as_rows(spark, texts), "id", {"text": 1.0})
    assert told(corpus.bm25_top(asked_rows(spark, asked), index, 7)) == want


def test_ranking_leaves_out_what_cannot_win(spark):
    """A rare term decides; documents with the common one alone are not added up."""
    texts = {i: ["common", "filler"] + (["rare"] if i % 50 == 0 else []) for i in range(1000)}
    rows = spark.createDataFrame([(i, t, 1.0, len(ts)) for i, ts in texts.items() for t in set(ts)], "id long, term string, weight double, length long")
    asked = spark.createDataFrame([(1, "common", 0.5), (1, "rare", 3.0)], "query_id long, term string, idf double")
    found = ranking.best(asked, rows.coalesce(1), "id", 1000, 2.0, 1)
    added = found.agg(F.sum("added")).first()[0]
    assert added < 200  # 1,020 postings in all


def test_segments_replacements_and_compaction(spark, asked):
    old, new = corpus_of(1, 120), corpus_of(2, 60)
    third = {i + 100: t for i, t in corpus_of(3, 40).items()}
    index = Inverted.create(as_rows(spark, old), "id", {"text": 1.0}, buckets=8).append(as_rows(spark, new)).append(as_rows(spark, third))
    texts = {**old, **new, **third}
    want = {q: [(i, round(s, 6)) for i, s in rows[:5]] for q, rows in plain_scores(texts, asked).items() if rows}
    rows = asked_rows(spark, asked)
    reopened = Inverted.open(spark, index.root)
    assert (reopened.n, reopened.tokens) == (len(texts), sum(map(len, texts.values())))
    assert told(reopened.search(rows, 5)) == want
    compact = reopened.compact()
    assert len(compact.segments) == 1 and compact.replaced == 0
    assert told(compact.search(rows, 5)) == want
    full = {(r["query_id"], r["id"]): round(r["score"], 6) for r in compact.scores(rows).collect()}
    assert full == {(q, i): round(s, 6) for q, found in plain_scores(texts, asked).items() for i, s in found}


def test_searches_read_the_asked_partitions_alone(spark):
    index = Inverted.create(as_rows(spark, corpus_of(1, 50)), "id", {"text": 1.0}, buckets=8)
    one = spark.createDataFrame([(1, "w1")], "query_id long, term string")
    plan = index.asked_rows(one)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#", plan)


def test_phrases_against_plain_search(spark):
    texts = corpus_of(5, 80)
    texts[3] = ["w1"] * 6
    phrases = {"a": ["w1", "w1"], "b": ["w1"], "c": ["w2", "w1", "w2"], "d": ["w1", "never"], "e": texts[7][2:7] or ["w3"]}
    rows = spark.createDataFrame([(q, i, t) for q, ts in phrases.items() for i, t in enumerate(ts)], "query_id string, at int, term string")
    got = {(r["query_id"], r["id"]): r["places"] for r in Inverted.create(as_rows(spark, texts), "id", {"text": 1.0}).phrases(rows).collect()}
    want = {}
    for q, p in phrases.items():
        for i, t in texts.items():
            if at := [j for j in range(len(t) - len(p) + 1) if t[j : j + len(p)] == p]:
                want[q, i] = at
    assert got == want


def test_phrases_stay_within_a_field(spark):
    docs = spark.createDataFrame([(1, "alpha beta", "gamma"), (2, "alpha", "beta gamma"), (3, None, "alpha beta gamma")], "id long, a string, b string")
    rows = spark.createDataFrame([(1, 0, "alpha"), (1, 1, "beta")], "query_id long, at int, term string")
    got = Inverted.create(docs, "id", {"a": 2.0, "b": 1.0}).phrases(rows).collect()
    assert {(r["id"], r["field"], tuple(r["places"])) for r in got} == {(1, 0, (0,)), (3, 1, (0,))}


def test_tokens_are_cut_once(spark):
    """The optimizer must not repeat the tokeniser below an explode."""
    docs = as_rows(spark, corpus_of(1, 10))
    plan = corpus.doc_terms(docs, "id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


@pytest.mark.parametrize("most", [1, 100, 1 << 20])
def test_postings_are_packed_by_bucket(spark, asked, monkeypatch, most):
    """One row per block and bucket, whatever the terms; the same results with blocks of any size."""
    monkeypatch.setattr(inverted, "BLOCK_TOKENS", most)
    texts = corpus_of(4, 90) | {1000: []}
    rows = as_rows(spark, texts).unionByName(spark.createDataFrame([(1001, None)], "id long, text string"))
    index = Inverted.create(rows.coalesce(1), "id", {"text": 1.0}, buckets=8)
    assert (index.n, index.tokens) == (len(texts) + 1, sum(map(len, texts.values())))
    stored = spark.read.parquet(f"{index.root}/segments/{index.segments[0]}/postings")
    blocks = stored.select("block").distinct().count()
    assert stored.count() <= 9 * blocks and (most < 1000 or blocks <= 4)
    want = {q: [(i, round(s, 6)) for i, s in found[:5]] for q, found in plain_scores(texts | {1001: []}, asked).items() if found}
    assert told(index.search(asked_rows(spark, asked), 5)) == want
    monkeypatch.setattr(inverted, "MOST_TERMS", 3)
    assert told(index.search(asked_rows(spark, asked), 5)) == want
    again = Inverted.create(rows.limit(0), "id", {"text": 1.0}, buckets=8).append(rows)
    assert told(again.search(asked_rows(spark, asked), 5)) == want


def test_stems_of_one_document_are_one_posting(spark):
    docs = spark.createDataFrame([(1, "cats cat", "a cat"), (2, "dogs", None)], "id long, a string, b string")
    index = Inverted.create(docs, "id", {"a": 2.0, "b": 1.0}, stem=True)
    rows = index.asked_rows(spark.createDataFrame([("cat",)], "term string"), places=True).collect()
    assert [(r["n"], r["keys"], r["weights"], r["lengths"], r["fields"], r["at"]) for r in rows] == [(1, [1], [5.0], [3], [0, 0, 1], [0, 1, 0])]


@pytest.mark.parametrize("group", [16_384, 10])
def test_best_question_of_each_document(spark, asked, monkeypatch, group):
    """As the maximum over all pairs, which are never made; the smaller question on ties."""
    monkeypatch.setattr(ranking, "GROUP", group)
    twice = {**asked, **{q + 100: ts for q, ts in asked.items()}}
    index = corpus.Index.build(as_rows(spark, {**corpus_of(1, 200), 900: ["unasked"]}), "id", {"text": 1.0})
    rows = lambda df: sorted((r["id"], round(r["best_score"], 6), r["best_query"]) for r in df.collect())
    every = corpus.max_over_queries(corpus.bm25(asked_rows(spark, twice), index), "id")
    found = corpus.best_question(asked_rows(spark, twice), index)
    assert rows(found) == rows(every) and max(r[2] for r in rows(found)) < 100
    assert "query_id" not in [c for c in found.columns]


def test_frequencies_without_a_written_index(spark, monkeypatch):
    """Counts of slices add up to those of the index, and nothing is written for them."""
    from lodegraph.operators import corpus

    texts = ["one two two Three", None, "", "two-. one", "three four three", "one"] * 5
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(3)
    want = {"one": 15, "two": 10, "three": 10, "four": 5}
    monkeypatch.setattr(corpus, "TALLY", 2)
    index = corpus.Index.build(docs, "id", {"text": 1.0})
    monkeypatch.setattr(corpus, "written", None)
    for found in (corpus.frequency_of(docs, "text"), index.frequency()):
        assert {r["term"]: r["df"] for r in found.collect()} == want


@pytest.mark.parametrize("most", [3, 200_000])
def test_search_ranks_packed_postings(spark, asked, monkeypatch, most):
    """No row of a single posting is made, though a segment replaces documents of another, and whatever number of terms is asked."""
    monkeypatch.setattr(inverted, "MOST_TERMS", most)
    monkeypatch.setattr(inverted, "BLOCK_TOKENS", 500)
    old, new = corpus_of(6, 90), corpus_of(7, 40) | {200: []}
    index = Inverted.create(as_rows(spark, old), "id", {"text": 1.0}, buckets=8).append(as_rows(spark, new))
    monkeypatch.setattr(Inverted, "_flat", None)
    want = {q: [(i, round(s, 6)) for i, s in rows[:5]] for q, rows in plain_scores({**old, **new}, asked).items() if rows}
    assert told(index.search(asked_rows(spark, asked), 5)) == want


def test_packed_rows_are_small(spark):
    """Rows that are dealt and sorted hold compressed bytes: less than a third of plain arrays (24 bytes a posting, 8 a place)."""
    rng = random.Random(8)
    texts = {i: [f"w{int(rng.paretovariate(0.9)) % 5000}" for _ in range(200)] for i in range(1000)}
    rows = inverted.packed(as_rows(spark, texts), "id", {"text": 1.0}, False, 8).where("bucket >= 0")
    size = rows.agg(F.sum(F.length("postings") + F.length("places"))).first()[0]
    assert 3 * size < sum(24 * len(set(t)) + 8 * len(t) for t in texts.values())


def test_stemmed_search_ranks_packed_postings(spark, monkeypatch):
    """Forms of one stem are one posting of the packed rows; no row of a single posting is made."""
    texts = {1: "cats cat dog", 2: "dogs running", 3: "a run of cats", 4: "", 5: "nothing here"}
    index = Inverted.create(spark.createDataFrame(list(texts.items()), "id long, text string"), "id", {"text": 1.0}, stem=True, buckets=4)
    monkeypatch.setattr(Inverted, "_flat", None)
    got = told(index.search(spark.createDataFrame([(1, "cat"), (1, "cats"), (2, "runs")], "query_id long, term string"), 5))
    assert {q: [i for i, _ in rows] for q, rows in got.items()} == {1: [1, 3], 2: [2, 3]}


def test_stems_of_many_words_at_once(monkeypatch):
    """As word by word, and no word is stemmed alone: a block's distinct words are too many for that."""
    rng = random.Random(9)
    endings = [r[1] for rules in (porter.PLURALS, porter.LONG, porter.SHORT, porter.LAST) for r in rules] + ["eed", "ed", "ing", "y", "e", "ll", ""]
    draw = lambda: "".join(rng.choice("aeiouybcdlstwxz") for _ in range(rng.randint(0, 5)))
    words = [None, "", "a", "is", "c++", "über", "ed-ing"] + [draw() + rng.choice(endings) + rng.choice([*endings, *[""] * 40]) for _ in range(4000)]
    want = [w if w is None else porter.stem(w) for w in words]
    monkeypatch.setattr(porter, "stem", None)
    assert porter.stems(pa.array(words)).to_pylist() == want
    assert porter.stems(pa.array([], pa.string())).to_pylist() == []


@pytest.mark.parametrize("stem", [False, True])
def test_packing_gets_texts_and_not_lists_of_tokens(spark, stem):
    """Tokens are cut in the packing task, with the places and lengths that only words of two signs and more count for."""
    texts = {1: "a -- .cats. x cats-, b.c +1", 2: None, 3: "", 4: " Cat!c++ -.- "}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    plan = inverted.packed(docs, "id", {"text": 1.0}, stem, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
    index = Inverted.create(docs, "id", {"text": 1.0}, stem=stem, buckets=4)
    assert {r["id"]: r["length"] for r in index._documents().collect()} == {1: 4, 2: 0, 3: 0, 4: 2}
    names = spark.createDataFrame([(t,) for t in ("cat", "cats", "b.c", "+1", "c++", "--")], "term string")
    got = {}
    for r in index.asked_rows(names, places=True).collect():
        at = iter(r["at"])
        got |= {(r["term"], k): [next(at) for _ in range(n)] for k, n in zip(r["keys"], r["tf"])}
    cats = "cat" if stem else "cats"
    assert got == {(cats, 1): [0, 1], ("b.c", 1): [2], ("+1", 1): [3], ("cat", 4): [0], ("c++", 4): [1]}


def test_max_over_queries_asks_for_all_of_a_question(spark, tmp_path, compare):
    """A question's words from the 25th on count, in the query and in its SQL."""
    import duckdb

    from lodegraph.plans import catalogue

    words = [f"w{i}" for i in range(40)]
    tables = {
        "documents": ([(1, "w39 here", "a"), (2, "w2 w3", "b"), (3, "none of it", "a"), (4, "w30 w31 w0", "b")], "doc_id long, text string, source string"),
        "benchmark": ([(1, " ".join(words)), (2, "w2 w0")], "item_id long, text string"),
    }
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    found, sql = catalogue.queries()["bm25_max_over_queries"](spark, str(tmp_path)), catalogue.oracle_sql()["bm25_max_over_queries"]
    assert {r["id"]: r["best_query"] for r in found.collect()} == {1: 1, 2: 1, 4: 1}
    assert "24" not in sql
    compare(found, con, sql)
