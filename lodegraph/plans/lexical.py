"""Queries of corpus statistics, lexical and vector retrieval, fusion and the gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scores import evidence_factor, specificity
from ..functions.text import canon, padded, tokens
from ..operators import corpus, fusion, vectors
from ..sources.tables import written
from .registry import first_distinct, query, table, tok

DOCS = {"text": 1.0}
PART_FIELDS = {"name": 4.0, "display": 3.0, "aliases": 2.0, "description": 1.0}
GATE = fusion.Gate(max_seeds=4, relative_floor=0.9)


def benchmark_queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def part_modules(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("display"),
        F.col("p_type").alias("aliases"),
        F.concat_ws(" ", "p_name", "p_type").alias("description"),
    )


def part_queries(spark, sf_dir):
    """One question per distinct name and type, numbered in their order."""
    texts = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("text")).distinct()
    return texts.select(F.xxhash64("text").alias("query_id"), "text")


TERMS = f"""
dt AS (SELECT doc_id, source, unnest({tok('text')}) AS term FROM documents),
idx AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM idx GROUP BY term),
spread AS (
  SELECT term, count(DISTINCT source) AS n_domains,
         count(DISTINCT source) / (SELECT count(DISTINCT source) FROM documents)::DOUBLE AS breadth
  FROM dt GROUP BY term),
len AS (SELECT doc_id, len({tok('text')}) AS length FROM documents),
st AS (SELECT count(*) AS n, avg(length) AS m FROM len),
bt AS (SELECT item_id, {tok('text')} AS t FROM benchmark),
q AS (SELECT item_id AS query_id, unnest({first_distinct('t', 24)}) AS term FROM bt),
rare AS (
  SELECT query_id, q.term, coalesce(df, 0) AS df, coalesce(breadth, 0) AS breadth
  FROM q LEFT JOIN df ON df.term = q.term LEFT JOIN spread s ON s.term = q.term
  WHERE coalesce(df, 0) <= greatest(2, (SELECT n FROM st) * 5 // 100) AND coalesce(breadth, 0) <= 0.25)"""


def scored_sql(name: str, asked: str) -> str:
    return f"""
{name} AS (
  SELECT query_id, i.doc_id AS id,
         sum((CASE WHEN ln((n - df.df + 0.5) / (df.df + 0.5)) > 0 THEN ln((n - df.df + 0.5) / (df.df + 0.5)) ELSE 1e-6 END)
             * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / m))) AS score
  FROM {asked} q JOIN idx i ON i.term = q.term JOIN df ON df.term = q.term JOIN len l ON l.doc_id = i.doc_id, st
  GROUP BY query_id, i.doc_id)"""


HYBRID = f"""
{scored_sql('lexical_all', 'q')},
{scored_sql('lexical_rare', 'rare')},
lex AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM lexical_all
  QUALIFY rank <= 20),
cos AS (
  SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
  FROM embeddings a, embeddings b WHERE a.vec_id IN (SELECT item_id FROM benchmark)),
vec AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM cos
  QUALIFY rank <= 20),
both_lists AS (SELECT *, 'bm25' AS retriever FROM lex UNION ALL SELECT *, 'vector' AS retriever FROM vec),
fused AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS rrf FROM both_lists GROUP BY ALL),
field AS (
  SELECT query_id, round(score, 9) AS middle FROM cos
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC) = floor(count(*) OVER (PARTITION BY query_id) / 2) + 1),
tops AS (
  SELECT k.query_id, coalesce(v.s, 0) AS top_cosine, coalesce(middle, 0) AS median_cosine, coalesce(l.s, 0) AS top_bm25,
         coalesce(r.s, 0) AS top_bm25_rare, coalesce(l.i = v.i, false) AS retrievers_agree,
         k.query_id IN (SELECT query_id FROM rare) AS has_rare
  FROM (SELECT DISTINCT query_id FROM fused) k
  LEFT JOIN (SELECT query_id, round(score, 9) AS s, id AS i FROM lex WHERE rank = 1) l USING (query_id)
  LEFT JOIN (SELECT query_id, round(score, 9) AS s, id AS i FROM vec WHERE rank = 1) v USING (query_id)
  LEFT JOIN (SELECT query_id, max(round(score, 9)) AS s FROM lexical_rare GROUP BY query_id) r USING (query_id)
  LEFT JOIN field USING (query_id)),
tests AS (
  SELECT *, top_cosine - median_cosine AS prominence, CASE WHEN has_rare THEN top_bm25_rare ELSE top_bm25 END AS lexical
  FROM tops),
verdicts AS (
  SELECT *, (NOT has_rare OR top_bm25_rare > 0)
     AND ((prominence >= 0.13 AND top_cosine >= 0.35 AND (lexical >= 2.8
           OR CASE WHEN median_cosine <= 0 THEN top_cosine > 0 ELSE prominence >= 0.166 END))
          OR lexical >= 3.5 OR (retrievers_agree AND top_cosine >= 0.28 AND lexical >= 2.8)) AS relevant,
     greatest(0.0, least(1.0, lexical / 7.0), least(1.0, prominence / 0.13))::DOUBLE AS confidence
  FROM tests),
gated AS (
  SELECT f.query_id, id, rrf, relevant, confidence,
         row_number() OVER (PARTITION BY f.query_id ORDER BY round(rrf, 12) DESC, id) AS place,
         max(rrf) OVER (PARTITION BY f.query_id) * 0.9::DOUBLE AS floor
  FROM fused f JOIN verdicts v ON v.query_id = f.query_id),
decided AS (
  SELECT query_id, id, rrf, CASE WHEN NOT relevant OR rrf < floor * 0.85::DOUBLE THEN 'BELOW_THRESHOLD'
         WHEN rrf < floor THEN 'NEAR_MISS' WHEN place > 4 THEN 'OVER_CAP' ELSE 'SEED' END AS verdict, confidence
  FROM gated)"""


@query("tok_doc_terms", f"WITH {TERMS} SELECT * FROM idx")
def tok_doc_terms(spark, sf_dir):
    return corpus.doc_terms(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("module_doc_freq", f"WITH {TERMS} SELECT * FROM df")
def module_doc_freq(spark, sf_dir):
    return corpus.doc_frequency(table(spark, sf_dir, "documents"), "text")


@query("term_domain_breadth", f"WITH {TERMS} SELECT term, n_domains, round(breadth, 6) AS breadth FROM spread")
def term_domain_breadth(spark, sf_dir):
    out = corpus.breadth(table(spark, sf_dir, "documents"), "text", "source")
    return out.withColumn("breadth", F.round("breadth", 6))


@query(
    "page_term_breadth",
    f"""
WITH p AS (
  SELECT regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\\.', '') AS host,
         {tok('html')} AS t FROM pages)
SELECT term, count(DISTINCT host) AS n_domains,
       round(count(DISTINCT host) / (SELECT count(DISTINCT host) FROM p)::DOUBLE, 6) AS breadth
FROM (SELECT host, unnest(t) AS term FROM p) GROUP BY term
""",
)
def page_term_breadth(spark, sf_dir):
    """Breadth over hosts of the raw page source, markup included."""
    from ..functions.web import domain_of

    pages = table(spark, sf_dir, "pages").select(domain_of(F.col("url")).alias("host"), "html")
    return corpus.breadth(pages, "html", "host").withColumn("breadth", F.round("breadth", 6))


@query("distinctive_tokens", f"WITH {TERMS} SELECT query_id, term, df, round(breadth, 6) AS breadth FROM rare")
def distinctive_tokens(spark, sf_dir):
    return distinctive_of(spark, sf_dir).withColumn("breadth", F.round("breadth", 6))


def document_index(spark, sf_dir):
    """The documents cut into tokens once; all that a query asks of them reads this."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    return corpus.Index.build(docs, "id", DOCS, "source")


def distinctive_of(spark, sf_dir, index=None):
    index = index or document_index(spark, sf_dir)
    return corpus.distinctive(benchmark_queries(spark, sf_dir), index.statistics(), index.n)


def lexical_list(spark, sf_dir, index=None):
    asked = corpus.asked_terms(benchmark_queries(spark, sf_dir))
    return corpus.bm25_top(asked, index or document_index(spark, sf_dir), 20)


def vector_table(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def benchmark_vectors(spark, sf_dir):
    """A question's vector is the one with its number (a convention of these tables)."""
    ids = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))
    return vector_table(spark, sf_dir).join(ids, "id", "left_semi").withColumnRenamed("id", "query_id")


def vector_list(spark, sf_dir):
    found = vectors.similarities(benchmark_vectors(spark, sf_dir), vector_table(spark, sf_dir), 20)
    return corpus.top_k(found, "id", 20)


def twentieth_vectors(spark, sf_dir):
    return vector_table(spark, sf_dir).where(F.col("id") % 20 == 0).withColumnRenamed("id", "query_id")


@query(
    "bm25_single_field",
    f"WITH {TERMS}, {scored_sql('s', 'q')} SELECT query_id, id, round(score, 6) AS score, "
    "row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s QUALIFY rank <= 20",
)
def bm25_single_field(spark, sf_dir):
    return lexical_list(spark, sf_dir).withColumn("score", F.round("score", 6))


def part_bm25_sql(fields: dict[str, float]) -> str:
    columns = {"name": "p_name", "display": "p_brand", "aliases": "p_type", "description": "p_name || ' ' || p_type"}
    each = " UNION ALL ".join(
        f"SELECT p_partkey, unnest({tok(columns[f])}) AS term, {w}::DOUBLE AS w FROM part" for f, w in fields.items()
    )
    length = " + ".join(f"len({tok(columns[f])})" for f in fields)
    return f"""
WITH dt AS ({each}),
idx AS (SELECT p_partkey, term, sum(w) AS wtf FROM dt GROUP BY ALL),
len AS (SELECT p_partkey, {length} AS length FROM part),
st AS (SELECT count(*) AS n, avg(length) AS m FROM len),
df AS (SELECT term, count(*) AS df FROM idx GROUP BY term),
qs AS (SELECT DISTINCT p_name || ' ' || p_type AS text FROM part),
qt AS (SELECT text, {tok('text')} AS t FROM qs),
q AS (SELECT text, unnest({first_distinct('t', 24)}) AS term FROM qt),
s AS (
  SELECT text, i.p_partkey,
         sum((CASE WHEN ln((n - df.df + 0.5) / (df.df + 0.5)) > 0 THEN ln((n - df.df + 0.5) / (df.df + 0.5)) ELSE 1e-6 END)
             * wtf * 2.2::DOUBLE / (wtf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / m))) AS score
  FROM q JOIN idx i ON i.term = q.term JOIN df ON df.term = q.term JOIN len l ON l.p_partkey = i.p_partkey, st
  GROUP BY text, i.p_partkey)
SELECT text, p_partkey, round(score, 6) AS score,
       row_number() OVER (PARTITION BY text ORDER BY round(score, 9) DESC, p_partkey) AS rank
FROM s QUALIFY rank <= 10
"""


def part_bm25(spark, sf_dir, fields):
    questions = part_queries(spark, sf_dir)
    index = corpus.Index.build(part_modules(spark, sf_dir), "p_partkey", fields)
    best = corpus.bm25_top(corpus.asked_terms(questions), index, 10).join(questions, "query_id")
    return best.select("text", "p_partkey", F.round("score", 6).alias("score"), "rank")


@query("bm25_multi_field", part_bm25_sql(PART_FIELDS))
def bm25_multi_field(spark, sf_dir):
    return part_bm25(spark, sf_dir, PART_FIELDS)


NAME_FIELDS = {"name": 4.0, "aliases": 2.0}


@query("bm25_name_scoped", part_bm25_sql(NAME_FIELDS))
def bm25_name_scoped(spark, sf_dir):
    return part_bm25(spark, sf_dir, NAME_FIELDS)


@query(
    "bm25_max_over_queries",
    f"WITH {TERMS.replace(first_distinct('t', 24), 'list_distinct(t)')}, {scored_sql('s', 'q')} "
    "SELECT id, round(max(round(score, 9)), 6) AS best_score, "
    "arg_min(query_id, (-round(score, 9), query_id)) AS best_query FROM s GROUP BY id",
)
def bm25_max_over_queries(spark, sf_dir):
    asked = corpus.asked_terms(benchmark_queries(spark, sf_dir), None)
    best = corpus.best_question(asked, document_index(spark, sf_dir))
    return best.withColumn("best_score", F.round("best_score", 6))


@query(
    "exact_name_hits",
    r"""
WITH names AS (
  SELECT name, max(score) AS score FROM (
    SELECT DISTINCT trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS name, 1.0::DOUBLE AS score FROM part
    UNION ALL
    SELECT DISTINCT trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')), 0.8::DOUBLE FROM part)
  WHERE length(name) >= 3 GROUP BY name),
qs AS (SELECT DISTINCT p_brand || ' ' || p_name || ' ' || p_type AS text FROM part)
SELECT text, name, score FROM qs, names
WHERE contains(' ' || regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || name || ' ')
""",
)
def exact_name_hits(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    names = part.select(F.trim(padded(F.col("p_name"))).alias("name"), F.lit(1.0).alias("score")).unionByName(
        part.select(F.trim(padded(F.col("p_type"))).alias("name"), F.lit(0.8).alias("score"))
    )
    names = names.where(F.length("name") >= 3).groupBy("name").agg(F.max("score").alias("score"))
    texts = part.select(F.concat_ws(" ", "p_brand", "p_name", "p_type").alias("text")).distinct()
    return corpus.ngram_hits(texts, "text", padded(F.col("text")), names).select("text", "name", "score")


@query(
    "name_claim",
    f"""
WITH names AS (SELECT DISTINCT regexp_replace(lower(trim(p_name)), '\\s+', '-', 'g') AS name FROM part),
qs AS (SELECT DISTINCT p_brand || ' ' || p_name || ' ' || p_type AS text FROM part),
t AS (SELECT text, {tok('text')} AS t FROM qs)
SELECT text, name FROM t, names
WHERE list_contains(t, name) OR list_has_all(t, list_filter(string_split(name, '-'), lambda x: length(x) >= 2))
""",
)
def name_claim(spark, sf_dir):
    """A question claims a name that is one of its tokens, or whose hyphened parts all are.

    Names meet questions by an equi-join on parts; a name is claimed when all
    its parts have met.
    """
    part = table(spark, sf_dir, "part")
    names = part.select(canon(F.col("p_name")).alias("name")).distinct()
    parts = F.array_distinct(F.filter(F.split("name", "-"), lambda x: F.length(x) >= 2))
    each = names.select("name", F.size(parts).alias("needed"), F.explode(parts).alias("term"))
    texts = part.select(F.concat_ws(" ", "p_brand", "p_name", "p_type").alias("text")).distinct()
    asked = texts.select("text", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    whole = asked.join(names.withColumnRenamed("name", "term"), "term", "left_semi").select(
        "text", F.col("term").alias("name")
    )
    met = asked.join(each, "term").groupBy("text", "name", "needed").agg(F.count("*").alias("met"))
    return met.where("met = needed").select("text", "name").unionByName(whole).distinct()


@query(
    "specificity_weight",
    f"""WITH {TERMS} SELECT term, round(breadth, 6) AS breadth,
    round(CASE WHEN breadth - 0.06 <= 0 THEN 1.0 ELSE 1.0 / (1.0 + 15.0 * (breadth - 0.06)) END::DOUBLE, 6) AS weight FROM spread""",
)
def specificity_weight(spark, sf_dir):
    out = corpus.breadth(table(spark, sf_dir, "documents"), "text", "source")
    return out.select(
        "term", F.round("breadth", 6).alias("breadth"), F.round(specificity(F.col("breadth")), 6).alias("weight")
    )


COSINES = """
WITH cos AS (
  SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
  FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)"""


@query(
    "cosine_topk",
    COSINES
    + """ SELECT query_id, id, round(score, 6) AS score,
    row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM cos QUALIFY rank <= 20""",
)
def cosine_topk(spark, sf_dir):
    found = vectors.similarities(twentieth_vectors(spark, sf_dir), vector_table(spark, sf_dir), 20)
    return corpus.top_k(found, "id", 20).withColumn("score", F.round("score", 6))


@query(
    "vector_median_prominence",
    COSINES
    + """, m AS (
  SELECT query_id, round(score, 9) AS middle FROM cos
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC) = floor(count(*) OVER (PARTITION BY query_id) / 2) + 1)
SELECT query_id, round(max(score), 6) AS top, round(any_value(middle), 6) AS middle,
       round(max(round(score, 9)) - any_value(middle), 6) AS prominence
FROM cos JOIN m USING (query_id) GROUP BY query_id""",
)
def vector_median_prominence(spark, sf_dir):
    out = vectors.field_statistics(twentieth_vectors(spark, sf_dir), vector_table(spark, sf_dir))
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in ("top", "middle", "prominence")])


@query(
    "multi_query_max_cosine",
    COSINES + " SELECT id, round(max(score), 6) AS best_score FROM cos GROUP BY id",
)
def multi_query_max_cosine(spark, sf_dir):
    found = vectors.best_over_queries(twentieth_vectors(spark, sf_dir), vector_table(spark, sf_dir))
    return found.select("id", F.round("score", 6).alias("best_score"))


def hybrid_lists(spark, sf_dir, index=None):
    lexical = lexical_list(spark, sf_dir, index).withColumn("retriever", F.lit("bm25"))
    vector = vector_list(spark, sf_dir).withColumn("retriever", F.lit("vector"))
    return lexical, vector


@query("rrf_fuse", f"""WITH {TERMS}, {HYBRID}
SELECT f.query_id, f.id, round(rrf, 9) AS rrf,
       max(CASE WHEN retriever = 'bm25' THEN rank END) AS bm25_rank, max(CASE WHEN retriever = 'vector' THEN rank END) AS vector_rank
FROM fused f JOIN both_lists b ON b.query_id = f.query_id AND b.id = f.id GROUP BY ALL""")
def rrf_fuse(spark, sf_dir):
    lexical, vector = hybrid_lists(spark, sf_dir)
    fused = fusion.rrf(lexical.unionByName(vector))
    place = lambda name: F.try_element_at("sources", F.lit(name))["rank"]
    return fused.select(
        "query_id",
        "id",
        F.round("rrf", 9).alias("rrf"),
        place("bm25").alias("bm25_rank"),
        place("vector").alias("vector_rank"),
    )


@query("evidence_weighted_rrf", f"""WITH {TERMS}, {HYBRID},
per AS (SELECT source, count(*) AS n_docs FROM documents GROUP BY source)
SELECT query_id, id, coalesce(n_docs, 0) AS n_docs, round(rrf * (1 + 0.08::DOUBLE * ln(1 + coalesce(n_docs, 0))), 9) AS weighted
FROM fused LEFT JOIN documents ON doc_id = id LEFT JOIN per USING (source)""")
def evidence_weighted_rrf(spark, sf_dir):
    """A document's evidence is the number of documents of its source."""
    lexical, vector = hybrid_lists(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    per = docs.groupBy("source").agg(F.count("*").alias("n_docs"))
    fused = fusion.rrf(lexical.unionByName(vector)).join(docs, "id", "left").join(per, "source", "left")
    n = F.coalesce("n_docs", F.lit(0))
    return fused.select(
        "query_id", "id", n.alias("n_docs"), F.round(F.col("rrf") * evidence_factor(n), 9).alias("weighted")
    )


def gate_inputs(spark, sf_dir, index=None):
    """Fused hits and signals, over one index."""
    index = index or document_index(spark, sf_dir)
    rare = written(distinctive_of(spark, sf_dir, index).select("query_id", "term"), "rare")
    lexical, vector = (written(x, "hits") for x in hybrid_lists(spark, sf_dir, index))
    by_rare = corpus.bm25_top(rare, index, 1).select("query_id", "id", "score")  # the gate looks at the best one only
    fused = fusion.rrf(lexical.unionByName(vector))
    field = vectors.field_statistics(benchmark_vectors(spark, sf_dir), vector_table(spark, sf_dir))
    signal = fusion.signals(fused, lexical, vector, field, by_rare)
    has_rare = rare.select("query_id", F.lit(True).alias("has_rare")).distinct()
    signal = signal.join(has_rare, "query_id", "left").withColumn("has_rare", F.coalesce("has_rare", F.lit(False)))
    return fused, signal.withColumn("top_exact", F.lit(0.0))


@query("relevance_signals", f"""WITH {TERMS}, {HYBRID}
SELECT query_id, round(top_cosine, 6) AS top_cosine, round(median_cosine, 6) AS median_cosine, round(top_bm25, 6) AS top_bm25,
       round(top_bm25_rare, 6) AS top_bm25_rare, retrievers_agree, has_rare FROM tops""")
def relevance_signals(spark, sf_dir):
    _, signal = gate_inputs(spark, sf_dir)
    return signal.select(
        "query_id",
        *[F.round(c, 6).alias(c) for c in ("top_cosine", "median_cosine", "top_bm25", "top_bm25_rare")],
        "retrievers_agree",
        "has_rare",
    )


@query("seed_gate", f"""WITH {TERMS}, {HYBRID}
SELECT query_id, id, round(rrf, 9) AS rrf, verdict, round(CASE WHEN verdict = 'SEED' THEN confidence END, 6) AS confidence FROM decided""")
def seed_gate(spark, sf_dir):
    out = fusion.seed_gate(*gate_inputs(spark, sf_dir), GATE).drop("reason")
    return out.withColumn("rrf", F.round("rrf", 9)).withColumn("confidence", F.round("confidence", 6))


@query("gate_near_miss", f"WITH {TERMS}, {HYBRID} SELECT query_id, id, verdict FROM decided WHERE verdict IN ('NEAR_MISS', 'OVER_CAP')")
def gate_near_miss(spark, sf_dir):
    out = fusion.seed_gate(*gate_inputs(spark, sf_dir), GATE)
    return out.where(F.col("verdict").isin("NEAR_MISS", "OVER_CAP")).select("query_id", "id", "verdict")


@query("knowledge_gaps", f"WITH {TERMS}, {HYBRID} SELECT query_id, NOT bool_or(verdict = 'SEED') AS gap FROM decided GROUP BY query_id")
def knowledge_gaps(spark, sf_dir):
    return fusion.knowledge_gaps(fusion.seed_gate(*gate_inputs(spark, sf_dir), GATE))
