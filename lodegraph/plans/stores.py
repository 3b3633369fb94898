"""Queries of scans, lookups, merges and settings over the stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores
from ..operators import profiles, tables
from ..sources.tables import dealt
from .checks import LINEAR, LUM
from .registry import query, table


@query("scan_sorted", "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey")
def scan_sorted(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").orderBy("p_name", "p_partkey")


@query("point_lookup", "SELECT c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000042' OR c_custkey = 7")
def point_lookup(spark, sf_dir):
    found = (F.col("c_name") == "Customer#000000042") | (F.col("c_custkey") == 7)
    return table(spark, sf_dir, "customer").where(found).select("c_custkey", "c_name")


@query("multi_get", "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE label = 3)")
def multi_get(spark, sf_dir):
    ids = table(spark, sf_dir, "embeddings").where("label = 3").select(F.col("vec_id").alias("doc_id"))
    return table(spark, sf_dir, "documents").join(ids, "doc_id", "left_semi").select("doc_id", "lang", "source")


@query("missing_embeddings", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL)")
def missing_embeddings(spark, sf_dir):
    have = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select(F.col("vec_id").alias("doc_id"))
    return table(spark, sf_dir, "documents").join(have, "doc_id", "left_anti").select("doc_id")


@query("embedding_scan", "SELECT vec_id, len(embedding) AS width FROM embeddings WHERE embedding IS NOT NULL")
def embedding_scan(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    return rows.select("vec_id", F.size("embedding").cast("long").alias("width"))


@query(
    "store_counts",
    """SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM pages) AS pages,
(SELECT count(DISTINCT source) FROM documents) AS domains, (SELECT coalesce(max(n_chars), 0) FROM documents) AS longest""",
)
def store_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").agg(
        F.count("*").alias("documents"),
        F.count_distinct("source").alias("domains"),
        F.coalesce(F.max("n_chars"), F.lit(0)).alias("longest"),
    )
    pages = table(spark, sf_dir, "pages").agg(F.count("*")).scalar()
    return docs.select("documents", pages.alias("pages"), "domains", "longest")


@query(
    "ensure_edges",
    """WITH e AS (
  SELECT l_partkey AS src, l_suppkey AS dst, l_returnflag AS relation, 0 AS seeded FROM lineitem
  UNION ALL SELECT l_partkey, l_suppkey, 'R', 1 FROM lineitem WHERE l_linenumber = 1)
SELECT src, dst, relation, max(seeded) AS seeded FROM e GROUP BY ALL""",
)
def ensure_edges(spark, sf_dir):
    """Get-or-create: one edge per source, destination and relation, seeded if any row says so."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), "l_returnflag", "l_linenumber"
    )
    plain = rows.select("src", "dst", F.col("l_returnflag").alias("relation"), F.lit(0).alias("seeded"))
    seeded = rows.where("l_linenumber = 1").select("src", "dst", F.lit("R").alias("relation"), F.lit(1).alias("seeded"))
    return plain.unionByName(seeded).groupBy("src", "dst", "relation").agg(F.max("seeded").alias("seeded"))


@query("latest_log_row", "SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 1")
def latest_log_row(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy(F.col("event_id").desc()).limit(1).select("event_id", "user_id", "event_type")


@query("name_filter", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a')")
def name_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.lower("p_name").contains("a")).select("p_partkey", "p_name")


@query(
    "first_result_wins",
    """SELECT url, page_id FROM pages QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id % 3, page_id) = 1""",
)
def first_result_wins(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return tables.first_wins(pages, ["url"], F.col("page_id") % 3, F.col("page_id")).select("url", "page_id")


@query(
    "alias_fold",
    """WITH a AS (SELECT DISTINCT lower(p_type) AS surface, lower(p_brand) AS canon FROM part QUALIFY row_number() OVER (PARTITION BY lower(p_type) ORDER BY lower(p_brand)) = 1)
SELECT p_partkey, coalesce(canon, lower(p_type)) AS canonical FROM part LEFT JOIN a ON surface = lower(p_type) AND p_partkey % 2 = 0""",
)
def alias_fold(spark, sf_dir):
    """Surfaces replaced by their canonical name where there is one (even keys only, so both cases occur)."""
    part = table(spark, sf_dir, "part")
    pairs = part.select(F.lower("p_type").alias("surface"), F.lower("p_brand").alias("canon")).distinct()
    names = tables.first_wins(pairs, ["surface"], F.col("canon"))
    rows = part.select("p_partkey", F.lower("p_type").alias("low"))
    hit = (rows["low"] == names["surface"]) & (rows["p_partkey"] % 2 == 0)
    return rows.join(names, hit, "left").select("p_partkey", F.coalesce("canon", "low").alias("canonical"))


@query("caller_ip", """SELECT event_id, trim(split_part(' 10.0.' || (user_id % 256) || '.1 , 10.9.9.9', ',', 1)) AS ip FROM events""")
def caller_ip(spark, sf_dir):
    header = F.concat(F.lit(" 10.0."), (F.col("user_id") % 256).cast("string"), F.lit(".1 , 10.9.9.9"))
    return table(spark, sf_dir, "events").select(
        "event_id", F.trim(F.split_part(header, F.lit(","), F.lit(1))).alias("ip")
    )


@query(
    "digest_match",
    """SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON sha256(c_custkey::VARCHAR) = sha256((s_suppkey * 3)::VARCHAR)""",
)
def digest_match(spark, sf_dir):
    """Keys meet by the digest of their secret, never by the secret."""
    ours = table(spark, sf_dir, "customer").select("c_custkey", F.sha2(F.col("c_custkey").cast("string"), 256).alias("d"))
    theirs = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.sha2((F.col("s_suppkey") * 3).cast("string"), 256).alias("d")
    )
    return ours.join(theirs, "d").select("c_custkey", "s_suppkey")


@query(
    "effort_profiles",
    """WITH e(effort, hops, max_seeds) AS (VALUES ('low', 1, 3), ('medium', 2, 4), ('high', 2, 6), ('xhigh', 3, 8), ('max', 4, 10)),
r AS (SELECT o_orderkey, CASE lower(substr(o_orderpriority, 3)) WHEN 'high' THEN 'high' WHEN 'low' THEN 'low' ELSE 'medium' END AS effort FROM orders)
SELECT o_orderkey, effort, hops, max_seeds FROM r JOIN e USING (effort)""",
)
def effort_profiles(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select(
        "o_orderkey", profiles.parse_effort(F.expr("substr(o_orderpriority, 3)")).alias("effort")
    )
    known = profiles.effort_table(spark)
    return asked.join(known, "effort").select("o_orderkey", "effort", "hops", "max_seeds")


@query(
    "context_text",
    """WITH r AS (
  SELECT doc_id, source, text, sum(length(text)) OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS running, n_chars FROM documents)
SELECT source, string_agg('## ' || doc_id || chr(10) || text, chr(10) || chr(10) ORDER BY n_chars, doc_id) AS context
FROM r WHERE running <= 4000 GROUP BY source""",
)
def context_text(spark, sf_dir):
    """The context of each source: its shortest documents within 1,000 tokens, as headed blocks."""
    docs = table(spark, sf_dir, "documents")
    held = tables.within_budget(docs, "source", F.length("text"), 4000, F.col("n_chars"), F.col("doc_id"))
    return profiles.context_block(held, "source", F.col("doc_id").cast("string"), F.col("text"), "n_chars", "doc_id")


def _lum(*values: str) -> str:
    return LUM.format(**{c: LINEAR.format(v=v) for c, v in zip("rgb", values, strict=True)})


def _moved(c: str) -> str:
    return f"round({c} + (goal - {c}) * i / 20.0::DOUBLE)"


SHADE = _lum(_moved("r"), _moved("g"), _moved("b"))


@query(
    "accessible_shade",
    f"""WITH c AS (
  SELECT p_partkey, (p_partkey * 7 % 256)::DOUBLE AS r, (p_partkey * 13 % 256)::DOUBLE AS g, (p_size * 5 % 256)::DOUBLE AS b,
         p_size * 3 % 256 AS s, p_partkey % 256 AS t, p_partkey * 31 % 256 AS u FROM part),
d AS (SELECT *, {_lum("s", "t", "u")} AS back FROM c),
e AS (SELECT *, CASE WHEN back > 0.35 THEN 0.0 ELSE 255.0 END::DOUBLE AS goal FROM d),
f AS (SELECT p_partkey, i, back, {SHADE} AS lum FROM e, unnest(range(1, 21)) AS v(i)),
g AS (SELECT p_partkey, min(i)::INT AS step FROM f WHERE (greatest(lum, back) + 0.05) / (least(lum, back) + 0.05) >= 4.5 GROUP BY p_partkey)
SELECT p_partkey, step FROM part LEFT JOIN g USING (p_partkey)""",
)
def accessible_shade(spark, sf_dir):
    """How far a colour must move to be readable on the part's ground, in twentieths; null if it never is."""
    k, s = F.col("p_partkey"), F.col("p_size")
    front = [(k * 7 % 256).cast("double"), (k * 13 % 256).cast("double"), (s * 5 % 256).cast("double")]
    back = scores.luminance(s * 3 % 256, k % 256, k * 31 % 256)
    parts = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size"))
    return parts.select("p_partkey", profiles.accessible_shade(*front, back, 4.5).alias("step"))
