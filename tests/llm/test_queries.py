"""Queries against SQL, the pipeline against its stages, accuracy on rows not learned from."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodegraph.llm import decontamination, mixing, near_duplicates, quality, queries, secrets
from lodegraph.llm.common import table

from ..conftest import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
LARGER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(name, spark, duck, compare):
    compare(queries.queries()[name](spark, DATA), duck, queries.oracle_sql()[name])


def test_languages_on_rows_not_learned_from(spark):
    rows = queries.op7_languages(spark, LARGER).where("held_out").join(table(spark, LARGER, "documents"), "doc_id")
    hit, n = rows.agg(F.sum((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*")).first()
    assert hit / n > 0.99


def test_quality_on_rows_not_learned_from(spark):
    rows = queries.op1_quality(spark, LARGER).where("held_out").join(table(spark, LARGER, "labels"), "doc_id")
    hit, n = rows.agg(F.sum((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert hit / n > 0.93


def test_outliers_leave_clean_documents(spark):
    rows = queries.op2_outliers(spark, LARGER).where("not base_failed").join(table(spark, LARGER, "labels"), "doc_id")
    kept = {r["quality"]: r["k"] for r in rows.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert kept[1] > 0.97 and kept[0] < 0.25


def test_pipeline_is_its_stages(spark):
    """The stages written out plainly over collected rows give the same rows."""
    docs = table(spark, DATA, "documents")
    model = queries.quality_model(spark, DATA, docs)
    good = {r["doc_id"] for r in quality.score(docs, model, ["doc_id"]).collect() if r["score"] >= 0.5}
    left = docs.where(F.col("doc_id").isin(sorted(good)))
    shingles = near_duplicates.near_duplicates(left.select("doc_id", "text")).where("kept")
    single = {r["doc_id"] for r in shingles.collect()}
    found = decontamination.overlaps(left, table(spark, DATA, "benchmark"), keep=["doc_id"]).where("size(spans) = 0")
    clean = single & {r["doc_id"] for r in found.collect()}
    texts = {r["doc_id"]: r["text"] for r in secrets.scan(docs, redact=True).collect()}
    mixed = docs.where(F.col("doc_id").isin(sorted(clean))).collect()
    again = spark.createDataFrame([(r["doc_id"], texts[r["doc_id"]], r["source"]) for r in mixed], "doc_id long, text string, source string")
    want = sorted((r["doc_id"], c + 1, texts[r["doc_id"]]) for r in mixing.mix(again).collect() for c in range(r["copies"]))
    got = corpus_pipeline.run(spark, DATA)
    assert got.columns == [*docs.columns, "copy"]
    assert sorted((r["doc_id"], r["copy"], r["text"]) for r in got.collect()) == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.collect())


def test_pipeline_judges_duplicates_by_row(spark):
    words = lambda n: " ".join(f"w{n}x{i}" for i in range(60))
    near = words(4) + " end"
    rows = [(2, words(2)), (2, words(2)), (1, words(1)), (None, words(3)), (None, words(3)), (None, words(4)), (7, near)]
    rows += [(8, words(8)), (8, words(1)), (9, ""), (9, ""), (10, ""), (None, None), (None, None)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string").repartition(3)
    got = corpus_pipeline.deduplicate(spark, docs, DATA)
    assert got.columns == docs.columns
    want = [(1, words(1)), (2, words(2)), (None, words(3)), (7, near), (8, words(8)), (9, ""), (10, ""), (None, None)]
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(repr, want))
