"""Queries of quality checks, penalties, palettes and audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores
from ..functions import text as tx
from ..operators import tables
from .registry import query, table

# Costs of rendered findings by severity.
COSTS = {"error": 10, "warn": 3, "info": 0}

FINDINGS = """
findings AS (
  SELECT doc_id, 'long-lines' AS "check", 3 AS cost FROM documents WHERE list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) >= 900
  UNION ALL SELECT doc_id, 'symbols', 10 FROM documents WHERE regexp_matches(text, '[#$%&*]{3}')
  UNION ALL SELECT doc_id, 'shouting', 10 FROM documents WHERE regexp_matches(text, '[A-Z]{4,}!!')
  UNION ALL SELECT doc_id, 'table', 3 FROM documents WHERE contains(text, ' | ')
  UNION ALL SELECT doc_id, 'secret', 10 FROM documents WHERE regexp_matches(text, '[0-9a-f]{24,}'))"""


def findings_of(spark, sf_dir):
    """doc_id, check, cost: one row per document and failed check."""
    text = F.col("text")
    checks = {
        "long-lines": (text.rlike(r"[^\n]{900}"), "warn"),
        "symbols": (text.rlike(r"[#$%&*]{3}"), "error"),
        "shouting": (text.rlike(r"[A-Z]{4,}!!"), "error"),
        "table": (text.contains(" | "), "warn"),
        "secret": (text.rlike(r"[0-9a-f]{24,}"), "error"),
    }
    found = F.array(
        *[F.when(hit, F.struct(F.lit(n).alias("check"), F.lit(COSTS[s]).alias("cost"))) for n, (hit, s) in checks.items()]
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_compact(found)).alias("f"))
    return rows.select("doc_id", "f.check", "f.cost")


@query(
    "penalty_score",
    f"""WITH {FINDINGS} SELECT doc_id, count(f.doc_id) AS n_findings, greatest(0, 100 - coalesce(sum(cost), 0))::BIGINT AS score
FROM documents d LEFT JOIN findings f USING (doc_id) GROUP BY doc_id""",
)
def penalty_score(spark, sf_dir):
    sums = findings_of(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))
    docs = table(spark, sf_dir, "documents").select("doc_id").join(sums, "doc_id", "left")
    return docs.select(
        "doc_id",
        F.coalesce("n", F.lit(0)).alias("n_findings"),
        scores.penalty(F.coalesce("cost", F.lit(0))).cast("long").alias("score"),
    )


@query(
    "worst_category",
    f"""WITH {FINDINGS}, s AS (SELECT doc_id, "check", sum(cost)::BIGINT AS cost FROM findings GROUP BY ALL)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cost DESC, "check") = 1""",
)
def worst_category(spark, sf_dir):
    return tables.worst_category(findings_of(spark, sf_dir), "doc_id").select("doc_id", "check", "cost")


@query("findings_by_check", f"""WITH {FINDINGS} SELECT "check", count(*) AS n FROM findings GROUP BY ALL""")
def findings_by_check(spark, sf_dir):
    return findings_of(spark, sf_dir).groupBy("check").agg(F.count("*").alias("n"))


@query("value_histogram_off_scale", "SELECT p_size, count(*) AS n, p_size % 4 <> 0 AS off_scale FROM part GROUP BY p_size")
def value_histogram_off_scale(spark, sf_dir):
    counts = table(spark, sf_dir, "part").groupBy("p_size").agg(F.count("*").alias("n"))
    return counts.withColumn("off_scale", F.col("p_size") % 4 != 0)


LUM = "(0.2126::DOUBLE * {r} + 0.7152::DOUBLE * {g} + 0.0722::DOUBLE * {b})"
LINEAR = "CASE WHEN {v} / 255.0::DOUBLE <= 0.03928 THEN {v} / 255.0::DOUBLE / 12.92 ELSE pow(({v} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"


def _lum_sql(*names: str) -> str:
    return LUM.format(**{c: LINEAR.format(v=n) for c, n in zip("rgb", names, strict=True)})


@query(
    "contrast_ratio",
    f"""WITH c AS (SELECT p_partkey, p_partkey * 7 % 256 AS r, p_partkey * 13 % 256 AS g, p_size * 5 % 256 AS b,
  p_size * 3 % 256 AS s, p_partkey % 256 AS t, p_partkey * 31 % 256 AS u FROM part),
l AS (SELECT p_partkey, {_lum_sql('r', 'g', 'b')} AS x, {_lum_sql('s', 't', 'u')} AS y FROM c)
SELECT p_partkey, round((greatest(x, y) + 0.05) / (least(x, y) + 0.05), 6) AS ratio,
       (greatest(x, y) + 0.05) / (least(x, y) + 0.05) >= 4.5 AS readable FROM l""",
)
def contrast_ratio(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    front = scores.luminance(k * 7 % 256, k * 13 % 256, s * 5 % 256)
    back = scores.luminance(s * 3 % 256, k % 256, k * 31 % 256)
    ratio = scores.contrast(front, back)
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.round(ratio, 6).alias("ratio"), (ratio >= 4.5).alias("readable")
    )


def _placeholder_sql(c: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, '{p}')" for p in tx.PLACEHOLDERS) + ")"


@query(
    "source_checks",
    f"""SELECT page_id, {_placeholder_sql('html')} AS placeholder, regexp_matches(html, '[‘’“”]') AS typographic,
len(regexp_extract_all(html, '(?i)<script')) AS opened, len(regexp_extract_all(html, '(?i)</script>')) AS closed,
length(substr(html, 1, strpos(html, '<h1') - 1)) - length(replace(substr(html, 1, strpos(html, '<h1') - 1), chr(10), '')) + 1 AS h1_line
FROM pages""",
)
def source_checks(spark, sf_dir):
    html = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        tx.has_placeholder(html).alias("placeholder"),
        html.rlike("[‘’“”]").alias("typographic"),
        F.regexp_count(html, F.lit("(?i)<script")).cast("long").alias("opened"),
        F.regexp_count(html, F.lit("(?i)</script>")).cast("long").alias("closed"),
        tx.line_of(html, F.instr(html, "<h1") - 1).cast("long").alias("h1_line"),
    )


@query(
    "static_a11y_checks",
    """SELECT page_id, NOT regexp_matches(html, '(?i)<html[^>]*\\blang=') AS no_lang, len(regexp_extract_all(html, '(?i)<h1[\\s>]')) AS h1,
NOT regexp_matches(html, '(?i)<meta[^>]*name="viewport"') AS no_viewport,
len(list_filter(regexp_extract_all(html, '(?i)<img\\b[^>]*>'), lambda x: NOT regexp_matches(x, '(?i)\\balt='))) AS img_without_alt FROM pages""",
)
def static_a11y_checks(spark, sf_dir):
    html = F.col("html")
    images = F.regexp_extract_all(html, F.lit(r"(?i)<img\b[^>]*>"), 0)
    return table(spark, sf_dir, "pages").select(
        "page_id",
        (~html.rlike(r"(?i)<html[^>]*\blang=")).alias("no_lang"),
        F.regexp_count(html, F.lit(r"(?i)<h1[\s>]")).cast("long").alias("h1"),
        (~html.rlike(r'(?i)<meta[^>]*name="viewport"')).alias("no_viewport"),
        F.size(F.filter(images, lambda x: ~x.rlike(r"(?i)\balt="))).cast("long").alias("img_without_alt"),
    )


@query(
    "tiered_command_rank",
    """WITH q AS (SELECT * FROM (VALUES ('s'), ('st'), ('part'), ('alpha')) AS t(q)),
n AS (SELECT p_partkey, lower(p_name) AS name, lower(p_type) AS alias FROM part),
t AS (
  SELECT q, p_partkey, CASE WHEN name = q THEN 0 WHEN starts_with(name, q) THEN 1 WHEN contains(name, q) THEN 2 WHEN starts_with(alias, q) THEN 3 END AS tier
  FROM n, q)
SELECT q, p_partkey, tier, count(*) OVER (PARTITION BY q) AS total FROM t WHERE tier IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY q ORDER BY tier, p_partkey) <= 8""",
)
def tiered_command_rank(spark, sf_dir):
    """A palette of eight entries per typed prefix, with the number of all matches."""
    typed = F.explode(F.array(*[F.lit(x) for x in ("s", "st", "part", "alpha")])).alias("q")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.lower("p_name").alias("name"), F.lower("p_type").alias("alias"), typed
    )
    hit = rows.withColumn("tier", tables.tiered(F.col("name"), F.col("alias"), F.col("q"))).where("tier IS NOT NULL")
    total = hit.groupBy("q").agg(F.count("*").alias("total"))
    order = Window.partitionBy("q").orderBy("tier", "p_partkey")
    best = hit.withColumn("n", F.row_number().over(order)).where("n <= 8")
    return best.join(total, "q").select("q", "p_partkey", "tier", "total")


def _medium_sql(c: str) -> str:
    cases = " ".join(
        "WHEN " + " OR ".join(f"contains({c}, '{w}')" for w in words) + f" THEN '{m}'" for m, words in tx.MEDIUM_WORDS
    )
    return f"CASE {cases} ELSE 'generic' END"


@query("medium_detect", f"SELECT doc_id, {_medium_sql('lower(text)')} AS medium FROM documents")
def medium_detect(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.medium_of(F.col("text")).alias("medium"))


@query(
    "size_hint",
    """WITH n AS (SELECT p_partkey, 'model-' || p_size || CASE WHEN p_partkey % 3 = 0 THEN '.5b-q4' WHEN p_partkey % 3 = 1 THEN 'b' ELSE 'x' END AS name FROM part),
h AS (SELECT *, regexp_extract(name, '(?i)(\\d+(?:\\.\\d+)?)\\s*b\\b', 1) AS f FROM n)
SELECT p_partkey, CASE WHEN f <> '' THEN f || 'B' END AS size,
       CASE WHEN f = '' THEN 'standard' WHEN f::DOUBLE < 8 THEN 'compact' WHEN f::DOUBLE < 30 THEN 'standard' ELSE 'max' END AS tier FROM h""",
)
def size_hint(spark, sf_dir):
    ending = F.when(F.col("p_partkey") % 3 == 0, ".5b-q4").when(F.col("p_partkey") % 3 == 1, "b").otherwise("x")
    named = table(spark, sf_dir, "part").select(
        "p_partkey", tx.size_hint(F.concat(F.lit("model-"), F.col("p_size").cast("string"), ending)).alias("size")
    )
    return named.select("p_partkey", "size", tx.prompt_tier(F.col("size"), F.lit(False)).alias("tier"))


@query(
    "route_audit",
    """WITH p AS (
  SELECT l.doc_id, quality, toxic, CASE WHEN regexp_matches(text, '[#$%&*]{3}|[A-Z]{4,}!!| \\| ') THEN 0 ELSE 1 END AS guess
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
SELECT toxic, count(*) AS cases, count(*) FILTER (guess = quality) AS hit, round(avg((guess = quality)::INT), 6) AS accuracy FROM p GROUP BY toxic""",
)
def route_audit(spark, sf_dir):
    """Graded accuracy of a rule against the labels, by toxicity."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    guess = F.when(F.col("text").rlike(r"[#$%&*]{3}|[A-Z]{4,}!!| \| "), 0).otherwise(1)
    graded = table(spark, sf_dir, "labels").join(docs, "doc_id").select("toxic", (guess == F.col("quality")).alias("hit"))
    return graded.groupBy("toxic").agg(
        F.count("*").alias("cases"),
        F.count_if("hit").alias("hit"),
        F.round(F.avg(F.col("hit").cast("int")), 6).alias("accuracy"),
    )


@query(
    "prose_safe",
    f"""SELECT DISTINCT w AS surface, CASE WHEN contains(w, ' ') OR contains(w, '-') THEN true WHEN w IN ({", ".join(f"'{x}'" for x in tx.PROSE_UNSAFE)}) THEN false
WHEN w IN ({", ".join(f"'{x}'" for x in tx.PROSE_SAFE_SHORT)}) THEN true ELSE length(w) >= 4 END AS safe
FROM (SELECT lower(trim(unnest(string_split(p_name || ' ' || p_type, ' ')))) AS w FROM part)""",
)
def prose_safe(spark, sf_dir):
    words = F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("surface")
    rows = table(spark, sf_dir, "part").select(words).select(F.trim("surface").alias("surface")).distinct()
    return rows.withColumn("safe", tx.prose_safe(F.col("surface")))
