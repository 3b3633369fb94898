"""Queries over a stored inverted index: searches across segments, phrases, stems."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stems import stem_sql
from ..functions.text import tokens
from ..operators import corpus
from ..operators.inverted import Inverted
from .lexical import DOCS, PART_FIELDS, TERMS, benchmark_queries, part_bm25_sql, part_modules, part_queries, scored_sql
from .registry import query, table, tok

RANKED = (
    "SELECT query_id, id, round(score, 6) AS score, "
    "row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s QUALIFY rank <= 20"
)


def waves(spark, sf_dir):
    """All documents in two deliveries: short ones with half of the long ones' first drafts, then the long ones as they are."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "n_chars")
    middle = docs.agg(F.percentile_approx("n_chars", 0.5)).scalar()
    long_ = F.coalesce(F.col("n_chars") > middle, F.lit(False))
    drafted = long_ & (F.pmod(F.xxhash64("id"), F.lit(2)) == 0)
    first = docs.where(~long_ | drafted).withColumn("text", F.when(long_, F.concat_ws(" ", F.lit("draft"), "text", "text")).otherwise(F.col("text")))
    return first.select("id", "text"), docs.where(long_).select("id", "text")


@query("index_segments", f"WITH {TERMS}, {scored_sql('s', 'q')} {RANKED}")
def index_segments(spark, sf_dir):
    """Searches an index made in two segments, the second of which replaces documents of the first; as if made at once."""
    first, second = waves(spark, sf_dir)
    index = Inverted.create(first, "id", DOCS).append(second)
    found = Inverted.open(spark, index.root).search(corpus.asked_terms(benchmark_queries(spark, sf_dir)), 20)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("index_fields", part_bm25_sql(PART_FIELDS))
def index_fields(spark, sf_dir):
    """Weighted fields over a stored index."""
    questions = part_queries(spark, sf_dir)
    index = Inverted.create(part_modules(spark, sf_dir), "p_partkey", PART_FIELDS)
    best = index.search(corpus.asked_terms(questions), 10).join(questions, "query_id")
    return best.select("text", "p_partkey", F.round("score", 6).alias("score"), "rank")


@query(
    "phrase_match",
    f"""
WITH d AS (SELECT doc_id AS id, {tok('text')} AS t FROM documents),
b AS (SELECT item_id, {tok('text')} AS t FROM benchmark),
p AS (
  SELECT DISTINCT array_to_string(t[i : i + 2], ' ') AS phrase FROM b, unnest(range(1, len(t) - 1, 3)) AS u(i)),
w AS (
  SELECT id, i - 1 AS place, array_to_string(t[i : i + 2], ' ') AS phrase FROM d, unnest(range(1, len(t) - 1)) AS u(i))
SELECT phrase, id, count(*) AS n_places, min(place)::INT AS first_place FROM w JOIN p USING (phrase) GROUP BY phrase, id
""",
)
def phrase_match(spark, sf_dir):
    """Every run of three words that the benchmark's items are cut into, wherever it stands in a document."""
    items = table(spark, sf_dir, "benchmark").select(tokens(F.col("text")).alias("t"))
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size("t") - 2, F.lit(1)), F.lit(3)), lambda i: i + 2 <= F.size("t"))
    phrases = items.select(F.explode(F.transform(starts, lambda i: F.slice("t", i, 3))).alias("w")).distinct()
    asked = phrases.select(F.array_join("w", " ").alias("query_id"), F.posexplode("w").alias("at", "term"))
    index = Inverted.create(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id", DOCS)
    return index.phrases(asked).select(
        F.col("query_id").alias("phrase"), "id", F.size("places").cast("long").alias("n_places"), F.array_min("places").alias("first_place")
    )


STEMS = f"""
WITH dt AS (SELECT doc_id, unnest({tok('text')}) AS term FROM documents),
bt AS (SELECT item_id, {tok('text')} AS t FROM benchmark),
asked AS (SELECT item_id AS query_id, unnest(list_distinct(t)) AS term FROM bt),
words AS (SELECT term FROM dt UNION SELECT term FROM asked),
{stem_sql('words', 'term', 'st_')},
idx AS (SELECT doc_id, stem AS term, count(*) AS tf FROM dt JOIN st_ USING (term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM idx GROUP BY term),
len AS (SELECT doc_id, len({tok('text')}) AS length FROM documents),
st AS (SELECT count(*) AS n, avg(length) AS m FROM len),
q AS (SELECT DISTINCT query_id, stem AS term FROM asked JOIN st_ USING (term))"""


@query("stemmed_search", f"{STEMS}, {scored_sql('s', 'q')} {RANKED}")
def stemmed_search(spark, sf_dir):
    """Questions and documents by Porter's stems."""
    asked = benchmark_queries(spark, sf_dir).select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    found = Inverted.create(docs, "id", DOCS, stem=True).search(asked, 20)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")
