"""The whole route: questions and their entities, four retrievers, gate, activation, alternatives, budget, context.

The registry of these tables: a module per lexicon term.  Every third is named by
its term and the next one's, joined by a dash, so that questions can match a name
without claiming it.  A module's description is the first document that holds
its term, its evidence the documents that do.  Its vector is the one with its
number, as a question's is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.scores import evidence_factor, specificity
from ..operators import corpus, extraction, fusion, graph, vectors
from ..sources.tables import written
from .fittings import KNOWN, question_entities, variants
from .graphs import GRAPH, Prepared, docs_of, prepared
from .lexical import benchmark_vectors, vector_table
from .registry import ORACLES, first_distinct, query, tok
from .texts import ALTERNATIVES

TOP, MOST_MODULES, CONTEXT_TOKENS = 20, 8, 2000
FIELDS = {"words": 4.0, "description": 1.0}


@dataclass(frozen=True)
class Registry:
    """What is routed to, prepared once: modules, their indexes, the graph, and pairs of alternatives."""

    ready: Prepared
    modules: DataFrame
    index: corpus.Index
    by_name: corpus.Index
    alternatives: DataFrame


def registry(spark, sf_dir) -> Registry:
    ready = prepared(spark, sf_dir)
    held = graph.held_terms(ready.index, ready.names).select("id", F.explode("held").alias("term"))
    seen = held.groupBy("term").agg(F.count("*").alias("n_docs"), F.min("id").alias("doc_id"))
    numbered = seen.withColumn("id", F.row_number().over(Window.orderBy(F.col("n_docs").desc(), "term")).cast("long"))
    after = numbered.select((F.col("id") - 1).alias("id"), F.col("term").alias("next"))
    both = F.concat("term", F.lit("-"), F.coalesce("next", F.lit("end")))
    named = numbered.join(after, "id", "left").withColumn("name", F.when(F.col("id") % 3 == 0, both).otherwise(F.col("term")))
    breadth = ready.index.statistics().select(F.col("term").alias("name"), "breadth")
    texts = docs_of(spark, sf_dir).select("doc_id", F.col("text").alias("description"))
    modules = named.join(breadth, "name", "left").join(texts, "doc_id").select(
        "id",
        "term",
        "name",
        F.replace("name", F.lit("-"), F.lit(" ")).alias("words"),
        "description",
        "n_docs",
        specificity(F.coalesce("breadth", F.lit(0.0))).alias("specificity"),
    )
    modules = written(modules, "modules")
    pairs = extraction.alternatives(docs_of(spark, sf_dir), "doc_id", F.col("text"), ready.names)
    return Registry(
        ready,
        modules,
        corpus.Index.build(modules, "id", FIELDS),
        corpus.Index.build(modules, "id", {"words": 1.0}),
        written(pairs.select("a", "b").distinct(), "alternatives"),
    )


def retrieved(spark, sf_dir, reg: Registry) -> tuple[DataFrame, DataFrame]:
    """Fused hits (query_id, id, rrf) and the gate's signals of every question."""
    asked = question_entities(spark, sf_dir, reg.ready.names)
    asked = written(asked.select("query_id", "text", variants(F.col("text"), F.col("entities")).alias("variants")), "asked")
    each = asked.select("query_id", F.explode("variants").alias("variant"))
    each = each.select(F.col("query_id").alias("of"), F.xxhash64("query_id", "variant").alias("query_id"), "variant")
    by_variant = corpus.bm25_top(corpus.asked_terms(each.select("query_id", F.col("variant").alias("text"))), reg.index, TOP)
    best = by_variant.join(each.select("query_id", "of"), "query_id").groupBy(F.col("of").alias("query_id"), "id")
    lexical = corpus.top_k(best.agg(F.max("score").alias("score")), "id", TOP)

    words = F.slice(F.array_distinct(F.flatten(F.transform("variants", tx.tokens))), 1, 24)
    terms = written(asked.select("query_id", F.explode(words).alias("term")), "asked-words")
    known = terms.join(reg.index.frequency(), "term", "left").join(reg.ready.index.statistics().select("term", "breadth"), "term", "left")
    few = F.coalesce("df", F.lit(0)) <= max(2, reg.index.n * 5 // 100)
    rare = written(known.where(few & (F.coalesce("breadth", F.lit(0.0)) <= 0.25)).select("query_id", "term"), "rare-words")
    by_rare = corpus.bm25_top(rare, reg.index, TOP)

    matched = corpus.bm25_top(terms, reg.by_name, 2 * TOP).select("query_id", "id")
    parts = F.filter(F.split("name", "-"), lambda x: F.length(x) >= 2)
    held = terms.groupBy("query_id").agg(F.collect_set("term").alias("held"))
    claims = F.array_contains("held", F.col("name")) | (F.contains("name", F.lit("-")) & (F.size(F.array_except(parts, "held")) == 0))
    unclaimed = matched.join(reg.modules.select("id", "name"), "id").join(held, "query_id").where(~claims).select("query_id", "id")
    unclaimed = written(unclaimed, "unclaimed")

    names = reg.modules.select("id", "name").where(F.length("name") >= 3)
    loose = F.concat(F.lit(" "), F.regexp_replace(F.lower("text"), r"[^a-z0-9+#.\-_]+", " "), F.lit(" "))
    exact = corpus.ngram_hits(asked.select("query_id", "text"), "query_id", loose, names).select("query_id", "id", F.lit(1.0).alias("score"))

    ids = reg.modules.select("id")
    vecs = vector_table(spark, sf_dir).join(ids, "id", "left_semi")
    near = corpus.top_k(vectors.similarities(benchmark_vectors(spark, sf_dir), vecs, TOP), "id", TOP)
    field = vectors.field_statistics(benchmark_vectors(spark, sf_dir), vecs)

    lists = {"bm25": lexical, "bm25Rare": by_rare, "exact": exact, "vector": near}
    lists = {k: written(fusion.grounded(v, unclaimed, reg.modules), f"list-{k}") for k, v in lists.items()}
    every = None
    for name, hits in lists.items():
        hits = hits.withColumn("retriever", F.lit(name))
        every = hits if every is None else every.unionByName(hits)
    fused = fusion.rrf(every).join(reg.modules.select("id", "n_docs", "specificity"), "id").select(
        "query_id", "id", (F.col("rrf") * evidence_factor(F.col("n_docs")) * F.col("specificity")).alias("rrf")
    )
    fused = written(fused, "fused")
    signal = fusion.signals(fused, lists["bm25"], lists["vector"], field, lists["bm25Rare"])
    flag = lambda df, name: df.select("query_id", F.lit(True).alias(name)).distinct()
    top = lists["exact"].groupBy("query_id").agg(F.max("score").alias("top_exact"))
    signal = signal.join(flag(rare, "has_rare"), "query_id", "left").join(top, "query_id", "left")
    return fused, signal.fillna({"has_rare": False, "top_exact": 0.0})


def routed(spark, sf_dir, reg: Registry | None = None, gate: fusion.Gate = fusion.Gate(), hops: int = 2) -> DataFrame:
    """query_id, id (a module's term), how, value, note for all questions in one job.

    how: the gate's verdict (value: fused mass, note: reason); HOP_n (activation;
    the alternative that won); SELECTED or BUDGET (place; whether it is in the
    context, whose blocks are taken until one does not fit).
    """
    reg = reg or registry(spark, sf_dir)
    decided = written(fusion.seed_gate(*retrieved(spark, sf_dir, reg), gate), "verdicts")
    named = reg.modules.select("id", "term")
    terms = decided.join(named, "id").select("query_id", F.col("term").alias("id"), "rrf", "verdict", "reason")
    verdicts = terms.select("query_id", "id", F.col("verdict").alias("how"), F.col("rrf").alias("value"), F.col("reason").alias("note"))
    state, _ = graph.spread_activation(terms.where("verdict = 'SEED'").select("query_id", "id"), reg.ready.edges, hops)
    active = written(state.where("activation >= 0.5"), "active")
    resolved = graph.resolve_alternatives(active.select("query_id", "id", "activation"), reg.alternatives)
    resolved = written(resolved.select("query_id", "id", "in_favour_of").join(active, ["query_id", "id"]), "resolved")
    reached = resolved.select(
        "query_id", "id", F.concat(F.lit("HOP_"), F.col("hop").cast("string")).alias("how"), F.col("activation").alias("value"),
        F.coalesce("in_favour_of", F.lit("")).alias("note"),
    )
    order = Window.partitionBy("query_id").orderBy(F.round("activation", 9).desc(), "hop", "id")
    kept = resolved.where("in_favour_of is null").withColumn("place", F.row_number().over(order))
    body = reg.modules.select(
        F.col("term").alias("id"),
        F.when(F.trim("description") != "", F.length(F.concat(F.lit("## "), "name", F.lit("\n"), "description", F.lit("\n")))).otherwise(0).alias("size"),
    )
    sized = kept.join(body, "id").withColumn("size", F.when(F.col("place") <= MOST_MODULES, F.col("size")).otherwise(0))
    used = F.sum("size").over(Window.partitionBy("query_id").orderBy("place"))
    chosen = sized.withColumn("used", used).select(
        "query_id",
        "id",
        F.when(F.col("place") <= MOST_MODULES, "SELECTED").otherwise("BUDGET").alias("how"),
        F.col("place").cast("double").alias("value"),
        F.when((F.col("place") <= MOST_MODULES) & (F.col("size") > 0) & (F.col("used") <= 4 * CONTEXT_TOKENS), "context").otherwise("").alias("note"),
    )
    return verdicts.unionByName(reached).unionByName(chosen).withColumn("value", F.round("value", 6))


def _index_sql(p: str, fields: dict[str, float]) -> str:
    rows = " UNION ALL ".join(f"SELECT id, unnest({tok(c)}) AS term, {w}::DOUBLE AS w FROM reg" for c, w in fields.items())
    length = " + ".join(f"len({tok(c)})" for c in fields)
    return f"""
{p}idx AS (SELECT id, term, sum(w) AS wtf FROM ({rows}) GROUP BY ALL),
{p}len AS (SELECT id, {length} AS length FROM reg),
{p}st AS (SELECT count(*) AS n, avg(length) AS m FROM {p}len),
{p}df AS (SELECT term, count(*) AS df FROM {p}idx GROUP BY term)"""


def _scored_sql(name: str, p: str, asked: str) -> str:
    idf = "ln((n - d.df + 0.5) / (d.df + 0.5))"
    return f"""
{name} AS (
  SELECT query_id, variant, i.id, sum((CASE WHEN {idf} > 0 THEN {idf} ELSE 1e-6 END)
         * wtf * 2.2::DOUBLE / (wtf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / m))) AS score
  FROM {asked} a JOIN {p}idx i ON i.term = a.term JOIN {p}df d ON d.term = a.term JOIN {p}len l ON l.id = i.id, {p}st
  GROUP BY query_id, variant, i.id)"""


def _grounded_sql(name: str, hits: str) -> str:
    return f"""
{name} AS (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank
  FROM (SELECT h.query_id, h.id, CASE WHEN (h.query_id, h.id) IN (SELECT (query_id, id) FROM unclaimed) THEN score * 0.2::DOUBLE ELSE score END * spec AS score
        FROM ({hits}) h JOIN reg USING (id)))"""


def _top_sql(source: str, k: int) -> str:
    return f"SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= {k}"


_SPREAD = re.sub(r"\b(s0|f1|g1|s1|f2|g2|s2)\b", r"m\1", GRAPH[GRAPH.index("s0 AS") :]).replace("FROM seeds", "FROM mseeds")
_RESOLVE = ORACLES["resolve_alternatives"]
_RESOLVE = _RESOLVE[_RESOLVE.index("ways_out AS") : _RESOLVE.index("SELECT n.query_id, n.id, round(activation")].rstrip()
_RESOLVE = _RESOLVE.replace("FROM s2)", "FROM ms2 WHERE activation >= 0.5)")

ROUTE = f"""
WITH RECURSIVE {GRAPH}, {ALTERNATIVES}, {KNOWN},
reg0 AS (SELECT row_number() OVER (ORDER BY df DESC, term) AS id, term, df AS n_docs FROM lexicon),
reg1 AS (
  SELECT r.id, r.term, r.n_docs, CASE WHEN r.id % 3 = 0 THEN r.term || '-' || coalesce(x.term, 'end') ELSE r.term END AS name
  FROM reg0 r LEFT JOIN reg0 x ON x.id = r.id + 1),
firsts AS (SELECT term, min(doc_id) AS doc_id FROM lt GROUP BY term),
reg AS (
  SELECT r.id, r.term, r.name, r.n_docs, replace(r.name, '-', ' ') AS words, d.text AS description,
         CASE WHEN coalesce(s.breadth, 0) - 0.06 <= 0 THEN 1.0 ELSE 1.0 / (1.0 + 15.0 * (s.breadth - 0.06)) END::DOUBLE AS spec
  FROM reg1 r JOIN firsts f ON f.term = r.term JOIN documents d ON d.doc_id = f.doc_id LEFT JOIN spread s ON s.term = r.name),
{_index_sql("m", FIELDS)}, {_index_sql("w", {"words": 1.0})},
vs AS (
  SELECT query_id, text, {first_distinct('v', 100)} AS v
  FROM (SELECT item_id AS query_id, text, list_filter(list_concat([text], entities), lambda x: length(trim(x)) > 1) AS v FROM en)),
ve AS (SELECT query_id, unnest(v) AS variant FROM vs),
vt AS (SELECT query_id, variant, unnest({first_distinct('t', 24)}) AS term FROM (SELECT *, {tok('variant')} AS t FROM ve)),
{_scored_sql("lex_each", "m", "vt")},
lex_all AS (SELECT query_id, id, max(score) AS score FROM lex_each GROUP BY ALL),
aw AS (
  SELECT query_id, '' AS variant, unnest({first_distinct('t', 24)}) AS term FROM (SELECT query_id, {tok("array_to_string(v, ' ')")} AS t FROM vs)),
rw AS (
  SELECT a.* FROM aw a LEFT JOIN mdf d ON d.term = a.term LEFT JOIN spread s ON s.term = a.term
  WHERE coalesce(df, 0) <= greatest(2, (SELECT n FROM mst) * 5 // 100) AND coalesce(breadth, 0) <= 0.25),
{_scored_sql("rare_all", "m", "rw")}, {_scored_sql("name_all", "w", "aw")},
heldw AS (SELECT query_id, list(term) AS held FROM aw GROUP BY query_id),
unclaimed AS (
  SELECT m.query_id, m.id FROM ({_top_sql("name_all", 2 * TOP)}) m JOIN reg USING (id) JOIN heldw h ON h.query_id = m.query_id
  WHERE NOT (list_contains(held, name) OR (contains(name, '-')
    AND list_has_all(held, list_filter(string_split(name, '-'), lambda x: length(x) >= 2))))),
exact_all AS (
  SELECT query_id, id, 1.0::DOUBLE AS score FROM vs, reg WHERE length(name) >= 3
    AND contains(' ' || regexp_replace(lower(text), '[^a-z0-9+#.\\-_]+', ' ', 'g') || ' ', ' ' || name || ' ')),
cosm AS (
  SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
  FROM embeddings a, embeddings b WHERE a.vec_id IN (SELECT item_id FROM benchmark) AND b.vec_id IN (SELECT id FROM reg)),
{_grounded_sql("l_bm25", _top_sql("lex_all", TOP))}, {_grounded_sql("l_rare", _top_sql("rare_all", TOP))},
{_grounded_sql("l_exact", "SELECT * FROM exact_all")}, {_grounded_sql("l_vec", _top_sql("cosm", TOP))},
fusedm AS (
  SELECT query_id, f.id, rrf * (1 + 0.08::DOUBLE * ln(1 + n_docs)) * spec AS rrf
  FROM (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS rrf FROM (
          SELECT query_id, id, rank FROM l_bm25 UNION ALL SELECT query_id, id, rank FROM l_rare
          UNION ALL SELECT query_id, id, rank FROM l_exact UNION ALL SELECT query_id, id, rank FROM l_vec) GROUP BY ALL) f JOIN reg USING (id)),
fieldm AS (
  SELECT query_id, round(score, 9) AS middle FROM cosm
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC) = floor(count(*) OVER (PARTITION BY query_id) / 2) + 1),
sigm AS (
  SELECT k.query_id, coalesce(round(v.score, 9), 0) AS cos, coalesce(middle, 0) AS med, coalesce(round(l.score, 9), 0) AS bm,
         coalesce(round(r.score, 9), 0) AS rare, coalesce(x.score, 0) AS exact, coalesce(l.id = v.id, false) AS agree,
         k.query_id IN (SELECT query_id FROM rw) AS has_rare
  FROM (SELECT DISTINCT query_id FROM fusedm) k
  LEFT JOIN (SELECT * FROM l_vec WHERE rank = 1) v USING (query_id) LEFT JOIN (SELECT * FROM l_bm25 WHERE rank = 1) l USING (query_id)
  LEFT JOIN (SELECT * FROM l_rare WHERE rank = 1) r USING (query_id) LEFT JOIN (SELECT * FROM l_exact WHERE rank = 1) x USING (query_id)
  LEFT JOIN fieldm USING (query_id)),
testm AS (SELECT *, cos - med AS prom, CASE WHEN has_rare THEN rare ELSE bm END AS lexm, (NOT has_rare OR rare > 0 OR exact > 0) AS covered FROM sigm),
judgem AS (
  SELECT *, covered AND ((prom >= 0.13 AND cos >= 0.35 AND (lexm >= 2.8 OR exact >= 0.99 OR CASE WHEN med <= 0 THEN cos > 0 ELSE prom >= 0.166 END))
    OR lexm >= 3.5 OR (agree AND cos >= 0.28 AND lexm >= 2.8) OR exact >= 0.99) AS relevant FROM testm),
gatem AS (
  SELECT f.*, covered, relevant, row_number() OVER (PARTITION BY f.query_id ORDER BY round(rrf, 12) DESC, id) AS place,
         max(rrf) OVER (PARTITION BY f.query_id) * 0.72::DOUBLE AS floor FROM fusedm f JOIN judgem j ON j.query_id = f.query_id),
decidem AS (
  SELECT query_id, term AS id, rrf, CASE WHEN NOT relevant OR rrf < floor * 0.85::DOUBLE THEN 'BELOW_THRESHOLD' WHEN rrf < floor THEN 'NEAR_MISS'
           WHEN place > 6 THEN 'OVER_CAP' ELSE 'SEED' END AS how,
         CASE WHEN NOT covered THEN 'no module holds a distinctive term of the question' WHEN NOT relevant THEN 'no retriever finds anything relevant'
           WHEN rrf < floor THEN 'too far below the best' WHEN place > 6 THEN 'all seeds are taken' ELSE 'in contention with the best' END AS note
  FROM gatem JOIN reg USING (id)),
mseeds AS (SELECT query_id, id FROM decidem WHERE how = 'SEED'),
{_SPREAD},
{_RESOLVE},
resolvedm AS (
  SELECT a.query_id, a.id, a.activation, a.hop, in_favour_of FROM ms2 a LEFT JOIN favour f ON f.query_id = a.query_id AND f.id = a.id
  WHERE activation >= 0.5),
keptm AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(activation, 9) DESC, hop, id) AS place FROM resolvedm WHERE in_favour_of IS NULL),
sizem AS (
  SELECT k.*, CASE WHEN place <= {MOST_MODULES} AND trim(description) <> '' THEN length('## ' || name || chr(10) || description || chr(10)) ELSE 0 END AS size
  FROM keptm k JOIN reg ON reg.term = k.id)
SELECT query_id, id, how, round(rrf, 6) AS value, note FROM decidem
UNION ALL SELECT query_id, id, 'HOP_' || hop, round(activation, 6), coalesce(in_favour_of, '') FROM resolvedm
UNION ALL SELECT query_id, id, CASE WHEN place <= {MOST_MODULES} THEN 'SELECTED' ELSE 'BUDGET' END, place::DOUBLE,
  CASE WHEN place <= {MOST_MODULES} AND size > 0 AND sum(size) OVER (PARTITION BY query_id ORDER BY place) <= {4 * CONTEXT_TOKENS} THEN 'context' ELSE '' END
FROM sizem
"""


@query("route_e2e", ROUTE)
def route_e2e(spark, sf_dir):
    return routed(spark, sf_dir)
