"""Queries of the association graph and of routing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import npmi, npmi_to_weight
from ..functions.text import query_tokens
from ..operators import corpus, fusion, graph, ordered, tables
from ..sources.tables import written
from .lexical import GATE, HYBRID, TERMS, benchmark_queries, document_index, gate_inputs
from .registry import first_distinct, query, table


@dataclass(frozen=True)
class Prepared:
    """What questions are routed over: the documents' index, the lexicon, and the edges that carry activation."""

    index: corpus.Index
    names: list[str]
    edges: DataFrame


def docs_of(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source")


def names_of(spark, sf_dir, index=None) -> list[str]:
    if index is not None:
        return graph.lexicon(index)
    docs = docs_of(spark, sf_dir)
    return [r["term"] for r in graph.banded(corpus.frequency_of(docs, "text"), docs.count()).collect()]


def edges_of(spark, sf_dir):
    index = document_index(spark, sf_dir)
    return graph.edges(index, graph.lexicon(index))


def prepared(spark, sf_dir) -> Prepared:
    """Every table that routing reads, written once: the corpus is cut into tokens a single time."""
    index = document_index(spark, sf_dir)
    names = graph.lexicon(index)
    usable = graph.with_brake(graph.capped(graph.eligible(graph.edges(index, names))))
    return Prepared(index, names, written(usable, "edges"))


def seeds_of(spark, sf_dir, names: list[str] | None = None, most: int = 6):
    """Seeds of a benchmark question: the first six of its terms that the lexicon knows."""
    names = names_of(spark, sf_dir) if names is None else names
    known = F.array(*[F.lit(x) for x in names])
    asked = F.slice(F.array_intersect(query_tokens(F.col("text"), 1000), known), 1, most)
    return benchmark_queries(spark, sf_dir).select("query_id", F.explode(asked).alias("id"))


NPMI = """CASE WHEN n < 8 OR df_a <= 0 OR df_b <= 0 THEN 0.0::DOUBLE WHEN both_n <= 0 THEN -1.0::DOUBLE
  WHEN -ln(both_n / n) < 1e-9 THEN 0.0::DOUBLE
  ELSE greatest(-1.0, least(1.0, ln((both_n / n) / ((df_a / n) * (df_b / n))) / -ln(both_n / n))) END"""

GRAPH = f"""
{TERMS},
lexicon AS (
  SELECT term, df FROM df, st WHERE length(term) >= 4 AND df >= 0.02 * n AND df <= 0.12 * n
  ORDER BY df DESC, term LIMIT 200),
lt AS (SELECT DISTINCT doc_id, source, term FROM dt WHERE term IN (SELECT term FROM lexicon)),
pr AS (
  SELECT x.term AS a, y.term AS b, count(*)::DOUBLE AS both_n, count(DISTINCT x.source) AS n_domains
  FROM lt x JOIN lt y ON x.doc_id = y.doc_id AND x.term < y.term GROUP BY ALL),
pn AS (
  SELECT a, b, both_n, n_domains, la.df::DOUBLE AS df_a, lb.df::DOUBLE AS df_b, n::DOUBLE AS n
  FROM pr JOIN lexicon la ON la.term = a JOIN lexicon lb ON lb.term = b, st),
pv AS (SELECT *, {NPMI} AS npmi FROM pn),
ways AS (
  SELECT a AS src, b AS dst, npmi, both_n, n_domains, df_b AS df_dst, n FROM pv
  UNION ALL SELECT b, a, npmi, both_n, n_domains, df_a, n FROM pv),
edges AS (
  SELECT src, dst, npmi, CASE WHEN npmi <= 0 THEN 0.0::DOUBLE WHEN df_dst / n > 0.6 THEN least(npmi, 0.25) ELSE npmi END AS weight,
         both_n::BIGINT AS n_obs, n_domains FROM ways),
ok_edges AS (SELECT * FROM edges WHERE n_obs >= 3 AND n_domains >= 2),
cap_edges AS (
  SELECT * FROM ok_edges QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(weight, 9) DESC, dst) <= 24),
brake AS (SELECT *, greatest(0.0, least(1.0, (weight - 0.4::DOUBLE) / 0.6::DOUBLE)) AS rescaled FROM cap_edges),
seeds AS (
  SELECT query_id, term AS id
  FROM (SELECT item_id AS query_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos
        FROM (SELECT item_id, {first_distinct('t', 1000)} AS t FROM bt))
  WHERE term IN (SELECT term FROM lexicon)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos) <= 6),
s0 AS (SELECT query_id, id, 1.0::DOUBLE AS activation, 0 AS hop FROM seeds),
f1 AS (
  SELECT query_id, src, dst, activation * rescaled * 0.65::DOUBLE AS contribution
  FROM s0 JOIN brake ON src = id WHERE rescaled > 0),
g1 AS (SELECT query_id, dst AS id, sum(contribution) AS more FROM f1 GROUP BY ALL),
s1 AS (
  SELECT query_id, id, least(1.0, coalesce(activation, 0) + coalesce(more, 0)) AS activation, coalesce(hop, 1) AS hop
  FROM s0 FULL JOIN g1 USING (query_id, id)),
f2 AS (
  SELECT query_id, src, dst, activation * rescaled * 0.4225::DOUBLE AS contribution
  FROM s1 JOIN brake ON src = id WHERE rescaled > 0 AND hop = 1 AND activation >= 0.5),
g2 AS (SELECT query_id, dst AS id, sum(contribution) AS more FROM f2 GROUP BY ALL),
s2 AS (
  SELECT query_id, id, least(1.0, coalesce(activation, 0) + coalesce(more, 0)) AS activation, coalesce(hop, 2) AS hop
  FROM s1 FULL JOIN g2 USING (query_id, id))"""


@query("cooccur_pairs", f"WITH {GRAPH} SELECT a, b, both_n::BIGINT AS both, n_domains FROM pr")
def cooccur_pairs(spark, sf_dir):
    index = document_index(spark, sf_dir)
    return graph.cooccurrence(graph.held_terms(index, graph.lexicon(index)))


@query("npmi_edges", f"WITH {GRAPH} SELECT src, dst, round(npmi, 6) AS npmi, round(weight, 6) AS weight, n_obs, n_domains FROM edges")
def npmi_edges(spark, sf_dir):
    return edges_of(spark, sf_dir).select(
        "src", "dst", F.round("npmi", 6).alias("npmi"), F.round("weight", 6).alias("weight"), "n_obs", "n_domains"
    )


@query(
    "npmi_brand_baskets",
    f"""
WITH b AS (SELECT DISTINCT l_orderkey AS o, p_brand AS t FROM lineitem JOIN part ON p_partkey = l_partkey),
c AS (SELECT t, count(*)::DOUBLE AS df FROM b GROUP BY t),
p AS (SELECT x.t AS a, y.t AS b, count(*)::DOUBLE AS both_n FROM b x JOIN b y ON x.o = y.o AND x.t < y.t GROUP BY ALL),
v AS (
  SELECT a, b, both_n, ca.df AS df_a, cb.df AS df_b, (SELECT count(DISTINCT o) FROM b)::DOUBLE AS n
  FROM p JOIN c ca ON ca.t = a JOIN c cb ON cb.t = b),
w AS (SELECT *, {NPMI} AS npmi FROM v)
SELECT a, b, both_n::BIGINT AS both, round(npmi, 6) AS npmi,
       round(CASE WHEN npmi <= 0 THEN 0 WHEN df_b / n > 0.6 THEN least(npmi, 0.25) ELSE npmi END, 6) AS weight FROM w
""",
)
def npmi_brand_baskets(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    baskets = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(part, "l_partkey")
    terms = baskets.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_brand")).alias("held"))
    both = graph.pairs(terms, F.col("held")).groupBy("a", "b").agg(F.count("*").alias("both"))
    df = terms.select(F.explode("held").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    n = terms.agg(F.count("*")).scalar()
    known = (
        both.join(df.select(F.col("t").alias("a"), F.col("df").alias("df_a")), "a")
        .join(df.select(F.col("t").alias("b"), F.col("df").alias("df_b")), "b")
        .withColumn("n", n)
    )
    value = known.withColumn("npmi", npmi(F.col("n"), F.col("df_a"), F.col("df_b"), F.col("both")))
    weight = npmi_to_weight(F.col("npmi"), F.col("df_b"), F.col("n"))
    return value.select("a", "b", "both", F.round("npmi", 6).alias("npmi"), F.round(weight, 6).alias("weight"))


def evidence_of(index, names: list[str]):
    """One row per edge and document: an observation, each of the same confidence."""
    seen = graph.pairs(graph.held_terms(index, names), F.col("held"), "id", "domain")
    return seen.select(
        F.col("a").alias("src"), F.col("b").alias("dst"), F.col("id").alias("doc_id"), F.col("domain").alias("source")
    ).withColumn("confidence", F.lit(0.25))


@query("edge_evidence_stats", f"WITH {GRAPH} SELECT a AS src, b AS dst, both_n::BIGINT AS n_obs, n_domains FROM pr")
def edge_evidence_stats(spark, sf_dir):
    index = document_index(spark, sf_dir)
    by_domain = evidence_of(index, graph.lexicon(index)).groupBy("src", "dst", "source").agg(F.count("*").alias("n"))
    return by_domain.groupBy("src", "dst").agg(F.sum("n").alias("n_obs"), F.count("source").alias("n_domains"))


@query("eligible_edges", f"WITH {GRAPH} SELECT src, dst, round(weight, 6) AS weight, n_obs, n_domains FROM ok_edges")
def eligible_edges(spark, sf_dir):
    return graph.eligible(edges_of(spark, sf_dir)).select(
        "src", "dst", F.round("weight", 6).alias("weight"), "n_obs", "n_domains"
    )


@query(
    "edge_rescale",
    f"""WITH {GRAPH} SELECT src, dst, round(greatest(0.0, least(1.0, (weight - 0.4::DOUBLE) / 0.6::DOUBLE)), 6) AS rescaled,
    weight <= 0.4 AS blocked FROM edges""",
)
def edge_rescale(spark, sf_dir):
    return graph.with_brake(edges_of(spark, sf_dir)).select(
        "src", "dst", F.round("rescaled", 6).alias("rescaled"), "blocked"
    )


@query("out_degree_cap", f"WITH {GRAPH} SELECT src, dst, round(weight, 6) AS weight FROM cap_edges")
def out_degree_cap(spark, sf_dir):
    return graph.capped(graph.eligible(edges_of(spark, sf_dir))).select("src", "dst", F.round("weight", 6).alias("weight"))


@query("spread_activation_1hop", f"WITH {GRAPH} SELECT query_id, id, round(activation, 6) AS activation, hop, activation >= 0.5 AS active FROM s1")
def spread_activation_1hop(spark, sf_dir):
    return activated_of(spark, sf_dir, 1)


@query("spread_activation_2hop", f"WITH {GRAPH} SELECT query_id, id, round(activation, 6) AS activation, hop, activation >= 0.5 AS active FROM s2")
def spread_activation_2hop(spark, sf_dir):
    return activated_of(spark, sf_dir, 2)


def activated_of(spark, sf_dir, hops):
    ready = prepared(spark, sf_dir)
    state, _ = graph.spread_activation(seeds_of(spark, sf_dir, ready.names), ready.edges, hops)
    return state.select(
        "query_id",
        "id",
        F.round("activation", 6).alias("activation"),
        "hop",
        (F.col("activation") >= 0.5).alias("active"),
    )


@query(
    "activation_paths",
    f"""WITH {GRAPH} SELECT query_id, src, dst, round(contribution, 9) AS contribution, 1 AS hop FROM f1
    UNION ALL SELECT query_id, src, dst, round(contribution, 9), 2 FROM f2""",
)
def activation_paths(spark, sf_dir):
    ready = prepared(spark, sf_dir)
    _, flows = graph.spread_activation(seeds_of(spark, sf_dir, ready.names), ready.edges, 2)
    return flows.withColumn("contribution", F.round("contribution", 9))


@query(
    "why_module",
    f"""WITH {GRAPH},
best AS (SELECT * FROM ok_edges WHERE src < dst),
ev AS (SELECT x.term AS src, y.term AS dst, x.doc_id, x.source FROM lt x JOIN lt y ON x.doc_id = y.doc_id AND x.term < y.term)
SELECT b.src, b.dst, round(weight, 6) AS weight, n_obs, doc_id, source FROM best b JOIN ev ON ev.src = b.src AND ev.dst = b.dst
QUALIFY row_number() OVER (PARTITION BY b.src, b.dst ORDER BY doc_id) <= 2""",
)
def why_module(spark, sf_dir):
    index = document_index(spark, sf_dir)
    names = graph.lexicon(index)
    best = graph.eligible(graph.edges(index, names)).where("src < dst").select(
        "src", "dst", F.round("weight", 6).alias("weight"), "n_obs"
    )
    some = graph.evidence_sample(evidence_of(index, names)).select("src", "dst", "doc_id", "source")
    return best.join(some, ["src", "dst"])


@query(
    "graph_neighbours",
    f"""WITH {GRAPH}, n AS (
  SELECT src AS module, dst AS neighbour, weight, 'out' AS direction FROM ok_edges
  UNION ALL SELECT dst, src, weight, 'in' FROM ok_edges)
SELECT module, neighbour, direction, round(weight, 6) AS weight, CASE WHEN weight > 0.4 THEN 'routes' ELSE 'recorded' END AS kind FROM n""",
)
def graph_neighbours(spark, sf_dir):
    table_ = graph.eligible(edges_of(spark, sf_dir))
    out = table_.select(F.col("src").alias("module"), F.col("dst").alias("neighbour"), "weight", F.lit("out").alias("direction"))
    back = table_.select(F.col("dst").alias("module"), F.col("src").alias("neighbour"), "weight", F.lit("in").alias("direction"))
    both = out.unionByName(back).dropDuplicates(["module", "neighbour", "direction"])
    return both.select(
        "module",
        "neighbour",
        "direction",
        F.round("weight", 6).alias("weight"),
        F.when(F.col("weight") > 0.4, "routes").otherwise("recorded").alias("kind"),
    )


@query(
    "context_budget",
    """SELECT doc_id, source, running FROM (
  SELECT doc_id, source, sum(length(text) + 2) OVER (PARTITION BY source ORDER BY n_chars, doc_id)::BIGINT AS running
  FROM documents WHERE text IS NOT NULL) WHERE running <= 4 * 2000""",
)
def context_budget(spark, sf_dir):
    """Shortest documents first, per source, within 2,000 tokens of four characters."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    size = (F.length("text") + 2).cast("long")
    out = tables.within_budget(docs, "source", size, 4 * 2000, F.col("n_chars"), F.col("doc_id"))
    return out.select("doc_id", "source", "running")


@query(
    "module_budget_split",
    """SELECT doc_id, source, row_number() OVER w AS place, row_number() OVER w <= 12 AS selected
FROM documents WINDOW w AS (PARTITION BY source ORDER BY n_chars DESC, doc_id)""",
)
def module_budget_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    piece = -F.floor(F.col("n_chars") / 64)  # longer texts come first
    out = ordered.numbered(docs, ["source"], piece, F.col("n_chars").desc(), "doc_id")
    return out.select("doc_id", "source", "place", (F.col("place") <= 12).alias("selected"))


def route(spark, sf_dir, gate: fusion.Gate = GATE, hops: int = 2, ready: Prepared | None = None):
    """query_id, id, how, value for all questions in one job: gate verdicts and the graph's activated terms."""
    ready = ready or prepared(spark, sf_dir)
    decided = written(fusion.seed_gate(*gate_inputs(spark, sf_dir, ready.index), gate), "verdicts")
    documents = decided.select(
        "query_id", F.col("id").cast("string").alias("id"), F.col("verdict").alias("how"), F.col("rrf").alias("value")
    )
    routed = decided.where("verdict = 'SEED'").select("query_id").distinct()
    seeds = seeds_of(spark, sf_dir, ready.names).join(routed, "query_id", "left_semi")
    state, _ = graph.spread_activation(seeds, ready.edges, hops)
    terms = state.where("activation >= 0.5").select(
        "query_id", "id", F.concat(F.lit("HOP_"), F.col("hop").cast("string")).alias("how"), F.col("activation").alias("value")
    )
    return documents.unionByName(terms).withColumn("value", F.round("value", 6))


@query(
    "route_documents",
    f"""WITH {GRAPH}, {HYBRID}
SELECT query_id, id::VARCHAR AS id, verdict AS how, round(rrf, 6) AS value FROM decided
UNION ALL
SELECT query_id, id, 'HOP_' || hop, round(activation, 6) FROM s2
WHERE activation >= 0.5 AND query_id IN (SELECT query_id FROM decided WHERE verdict = 'SEED')""",
)
def route_documents(spark, sf_dir):
    """Documents instead of modules, and the lexicon terms of the question as seeds."""
    return route(spark, sf_dir)


@query("lexicon_terms", f"WITH {GRAPH} SELECT term, df FROM lexicon")
def lexicon_terms(spark, sf_dir):
    index = document_index(spark, sf_dir)
    return index.frequency().where(F.col("term").isin(*graph.lexicon(index)))


@query("seed_terms", f"WITH {GRAPH} SELECT query_id, id FROM seeds")
def seed_terms(spark, sf_dir):
    return seeds_of(spark, sf_dir)

