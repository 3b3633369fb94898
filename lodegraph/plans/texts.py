"""Queries of pages, URLs, sentences, extraction and question shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import web
from ..operators import corpus, extraction, fusion, graph, ordered, tables
from .graphs import GRAPH, docs_of, names_of, prepared, seeds_of
from .lexical import TERMS, benchmark_queries, distinctive_of
from .registry import first_distinct, query, table, tok

DOMAIN = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '')"

NORMAL = r"""
u AS (
  SELECT page_id, url, html, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*://)', 1)) AS head,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^#]*)', 1) AS rest FROM pages),
v AS (
  SELECT *, regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\.', '') AS host,
         regexp_extract(rest, '^[^/?]*([^?]*)', 1) AS p0,
         list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
           lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(utm_|ref|referrer|source|fbclid|gclid|mc_|_ga)')) AS left_over FROM u),
w AS (SELECT *, CASE WHEN length(p0) > 1 THEN regexp_replace(p0, '/+$', '') ELSE p0 END AS p1 FROM v),
norm AS (
  SELECT page_id, url, html, CASE WHEN head = '' THEN regexp_replace(trim(url), '/$', '') ELSE
    head || host || CASE WHEN p1 = '' THEN '/' ELSE p1 END
    || CASE WHEN len(left_over) > 0 THEN '?' || array_to_string(left_over, '&') ELSE '' END END AS norm FROM w)"""

CONTENT = "html"
for _pattern in (r"(?s)<!--.*?-->", *(rf"(?is)<{t}.*?</{t}>" for t in ("script", "style", "noscript", "svg"))):
    CONTENT = f"regexp_replace({CONTENT}, '{_pattern}', ' ', 'g')"


def decoded(c: str) -> str:
    """DuckDB: character references decoded piece by piece, like ``web.decode_entities``."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    named = "map([" + ", ".join(map(q, web.ENTITIES)) + "], [" + ", ".join(map(q, web.ENTITIES.values())) + "])"
    name = f"regexp_extract(x, '{web.REFERENCE}', 1)"
    point = f"(CASE WHEN lower({name}[2:2]) = 'x' THEN ('0x' || {name}[3:])::INT ELSE {name}[2:]::INT END)"
    fine = f"({point} BETWEEN 1 AND 1114111 AND {point} NOT BETWEEN 55296 AND 57343)"
    number = f"CASE WHEN {point} = 160 THEN ' ' WHEN {fine} THEN chr({point}) END"
    plain = f"(CASE WHEN {name} = '' THEN NULL WHEN {name}[1:1] = '#' THEN {number} ELSE {named}[{name}] END)"
    piece = f"CASE WHEN {plain} IS NOT NULL THEN {plain} || x[length({name}) + 2:] ELSE '&' || x END"
    cut = f"string_split({c}, '&')"
    return f"({cut}[1] || array_to_string(list_transform({cut}[2:], lambda x: {piece}), ''))"


def stripped(c: str) -> str:
    return f"regexp_replace({c}, '<[^>]+>', ' ', 'g')"


BLOCKS = r"(?i)</?(?:p|div|br|li|tr|h[1-6]|section|article|header|footer|blockquote|pre)\b[^>]*>"
TITLE = f"trim({decoded(stripped(f'''regexp_extract({CONTENT}, '(?is)<title[^>]*>(.*?)</title>', 1)'''))})"
FLAT = decoded(stripped(f"regexp_replace({CONTENT}, '{BLOCKS}', chr(10), 'g')"))
PLAIN = (
    rf"regexp_replace(regexp_replace(regexp_replace({FLAT}, '[ \t ]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), "
    r"'^\s+|\s+$', '', 'g')"
)
HEADS = stripped(
    "array_to_string(list_concat(regexp_extract_all(html, '(?is)<title[^>]*>(.*?)</title>', 1), "
    "regexp_extract_all(html, '(?is)<h[12][^>]*>(.*?)</h[12]>', 1)), ' ')"
)
BODY = stripped(
    "regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g')"
)
SENTENCES = (
    "string_split(regexp_replace(regexp_replace(text, '([.!?;:])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1))"
)
ZONES = f"""
z AS (SELECT page_id, list_distinct({tok(HEADS)}) AS h, list_distinct({tok(BODY)}) AS b FROM pages),
page_df AS (SELECT term, count(*) AS page_df FROM (SELECT unnest(b) AS term FROM z) GROUP BY term),
title_df AS (SELECT term, count(*) AS title_df FROM (SELECT unnest(h) AS term FROM z) GROUP BY term)"""
#: Fixed values of the question words, as an SQL list.
QUESTION = "(" + ", ".join(f"'{w}'" for w in dict.fromkeys(tx.QUESTION_WORDS)) + ")"
STRIP = f"""
qt AS (
  SELECT item_id AS query_id, text,
         list_filter(string_split_regex(regexp_replace(lower(text), '[?!.,;:"“”''’()\\[\\]{{}}]', ' ', 'g'), '\\s+'), lambda x: length(x) > 0) AS t
  FROM benchmark),
qc AS (SELECT *, list_filter(t, lambda x: x NOT IN {QUESTION}) AS c0 FROM qt),
qs AS (SELECT query_id, text, t, CASE WHEN len(c0) > 0 THEN c0 ELSE t END AS c FROM qc)"""


def pages_of(spark, sf_dir):
    return table(spark, sf_dir, "pages")


@query("parse_html_text", f"""SELECT page_id, {TITLE} AS title, length({PLAIN}) AS n_text,
CASE WHEN length({PLAIN}) = 0 THEN 0 ELSE len(string_split_regex({PLAIN}, '\\s+')) END AS words FROM pages""")
def parse_html_text(spark, sf_dir):
    parsed = pages_of(spark, sf_dir).select(
        "page_id", web.title_of(F.col("html")).alias("title"), web.text_of(F.col("html")).alias("t")
    )
    return parsed.select(
        "page_id",
        "title",
        F.length("t").cast("long").alias("n_text"),
        F.when(F.length("t") == 0, 0).otherwise(F.size(F.split("t", r"\s+"))).cast("long").alias("words"),
    )


def zone_frequency(spark, sf_dir):
    """term, page_df, title_df over the pages' bodies and heading zones."""
    pages = pages_of(spark, sf_dir)
    body = corpus.doc_frequency(pages.select(web.body_zone(F.col("html")).alias("z")), "z")
    head = corpus.doc_frequency(pages.select(web.heading_zone(F.col("html")).alias("z")), "z")
    both = body.withColumnRenamed("df", "page_df").join(head.withColumnRenamed("df", "title_df"), "term", "full")
    return both.select("term", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("page_df", "title_df")])


@query("html_zone_terms", f"""WITH {ZONES} SELECT coalesce(p.term, t.term) AS term, coalesce(page_df, 0) AS page_df,
coalesce(title_df, 0) AS title_df FROM page_df p FULL JOIN title_df t ON t.term = p.term""")
def html_zone_terms(spark, sf_dir):
    return zone_frequency(spark, sf_dir)


@query("domain_of", f"SELECT page_id, {DOMAIN} AS domain FROM pages")
def domain_of(spark, sf_dir):
    return pages_of(spark, sf_dir).select("page_id", web.domain_of(F.col("url")).alias("domain"))


@query("normalise_url_dedup", f"WITH {NORMAL} SELECT norm, min(page_id) AS page_id, count(*) AS n FROM norm GROUP BY norm")
def normalise_url_dedup(spark, sf_dir):
    rows = pages_of(spark, sf_dir).select("page_id", web.normalise_url(F.col("url")).alias("norm"))
    return rows.groupBy("norm").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


JUNK = r"""(NOT regexp_matches(url, '(?i)^https?://')
  OR regexp_matches(url, '(?i)\.(css|js|ico|png|jpe?g|gif|svg|woff2?)($|\?)')
  OR regexp_matches(url, '(?i)(^|//)(www\.)?(google|bing|duckduckgo|mojeek|yandex|baidu)\.[a-z.]+/')
  OR regexp_matches(url, '(?i)blocksurvey\.io|buttondown\.email|creativecommons\.org/licenses')
  OR regexp_matches(url, '(?i)/(privacy|terms|about|contact|preferences|settings|login|signup)(/|$|\?)'))"""


@query("junk_url_filter", f"SELECT page_id, url, {JUNK} AS junk FROM pages")
def junk_url_filter(spark, sf_dir):
    return pages_of(spark, sf_dir).select("page_id", "url", web.is_junk(F.col("url")).alias("junk"))


@query("robots_filter", "SELECT page_id, url FROM pages WHERE NOT (regexp_matches(url, '^[^:]*://[^/]*/es/') AND contains(url, '.net/'))")
def robots_filter(spark, sf_dir):
    """Pages that no path-prefix rule of their host forbids; here ``/es/`` on hosts under ``.net``."""
    rules = spark.createDataFrame([("net", "/es/")], "zone string, prefix string")
    rows = pages_of(spark, sf_dir).select(
        "page_id",
        "url",
        F.substring_index(web.domain_of(F.col("url")), ".", -1).alias("zone"),
        F.regexp_extract("url", r"^[^:]*://[^/?#]*([^?#]*)", 1).alias("path"),
    )
    barred = (rows["zone"] == rules["zone"]) & rows["path"].startswith(rules["prefix"])
    return rows.join(rules, barred, "left_anti").select("page_id", "url")


@query(
    "fuse_search_results",
    f"""WITH {NORMAL}, r AS (
  SELECT norm AS url, {TITLE} AS title, page_id % 3 AS engine, row_number() OVER (PARTITION BY page_id % 3 ORDER BY page_id) AS rank FROM norm),
e AS (SELECT url, engine, min(rank) AS rank, arg_max(title, (length(title), title)) AS title FROM r GROUP BY ALL),
f AS (
  SELECT url, sum(1.0::DOUBLE / (60 + rank)) AS score, min(rank) AS best_rank, arg_max(title, (length(title), title)) AS title,
         array_to_string(list_sort(list(DISTINCT engine::VARCHAR)), ',') AS engines FROM e GROUP BY url)
SELECT url, title, engines, round(score, 9) AS score, best_rank FROM f ORDER BY round(score, 9) DESC, best_rank, url LIMIT 50""",
)
def fuse_search_results(spark, sf_dir):
    """Three synthetic engines list the pages in turn; the report is the first 50 fused results."""
    rows = pages_of(spark, sf_dir).select(
        web.normalise_url(F.col("url")).alias("url"),
        web.title_of(F.col("html")).alias("title"),
        (F.col("page_id") % 3).cast("string").alias("engine"),
        "page_id",
    )
    ranked = ordered.numbered(rows, ["engine"], F.floor(F.col("page_id") / 10_000), "page_id").withColumnRenamed("place", "rank")
    out = fusion.fuse_search_results(ranked, 50)
    return out.select("url", "title", "engines", F.round("score", 9).alias("score"), "best_rank")


@query(
    "engine_health",
    """SELECT page_id % 3 AS engine, count(*) AS pages, count(*) FILTER (length(html) < 8000) AS throttled,
sum(length(html))::BIGINT AS characters FROM pages GROUP BY 1""",
)
def engine_health(spark, sf_dir):
    """Answers below 8,000 characters count as throttled."""
    return pages_of(spark, sf_dir).groupBy((F.col("page_id") % 3).alias("engine")).agg(
        F.count("*").alias("pages"),
        F.count_if(F.length("html") < 8000).alias("throttled"),
        F.sum(F.length("html")).alias("characters"),
    )


@query(
    "sentence_split",
    f"""SELECT doc_id, i - 1 AS sentence, length(s[i]) AS length
FROM (SELECT doc_id, {SENTENCES} AS s FROM documents), unnest(range(1, len(s) + 1)) AS u(i) WHERE length(s[i]) BETWEEN 8 AND 600""",
)
def sentence_split(spark, sf_dir):
    cut = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("sentence", "s"))
    return cut.where(F.length("s").between(8, 600)).select("doc_id", "sentence", F.length("s").alias("length"))


REQUIREMENT = tx.REQUIREMENT_CUES.replace("'", "''")
MENTIONS = f"""
cut AS (
  SELECT doc_id, i - 1 AS sentence, s[i] AS s
  FROM (SELECT doc_id, {SENTENCES} AS s FROM documents), unnest(range(1, len(s) + 1)) AS u(i) WHERE length(s[i]) BETWEEN 8 AND 600),
said AS (
  SELECT DISTINCT doc_id, sentence, term, CASE WHEN cue THEN 0.6 ELSE 0.25 END::DOUBLE AS confidence,
         CASE WHEN cue THEN 'requirements-list' ELSE 'prose' END AS context
  FROM (SELECT doc_id, sentence, unnest({tok('s')}) AS term, regexp_matches(s, '{REQUIREMENT}') AS cue FROM cut)
  WHERE term IN (SELECT term FROM lexicon))"""


@query("prose_mentions", f"WITH {GRAPH}, {MENTIONS} SELECT * FROM said")
def prose_mentions(spark, sf_dir):
    return mentions_of(spark, sf_dir)


def mentions_of(spark, sf_dir):
    return extraction.from_prose(docs_of(spark, sf_dir), "doc_id", F.col("text"), names_of(spark, sf_dir))


@query(
    "term_merge_best",
    f"""WITH {GRAPH}, {MENTIONS} SELECT doc_id, term, confidence, context, sentence FROM said
QUALIFY row_number() OVER (PARTITION BY doc_id, term ORDER BY confidence DESC, sentence) = 1""",
)
def term_merge_best(spark, sf_dir):
    best = extraction.best_mention(mentions_of(spark, sf_dir), "doc_id", "sentence")
    return best.select("doc_id", "term", "confidence", "context", "sentence")


ALTERNATIVES = f"""
cut AS (
  SELECT doc_id, i - 1 AS sentence, s[i] AS s
  FROM (SELECT doc_id, {SENTENCES} AS s FROM documents), unnest(range(1, len(s) + 1)) AS u(i) WHERE length(s[i]) BETWEEN 8 AND 400),
held AS (
  SELECT DISTINCT doc_id, sentence, term FROM (
    SELECT doc_id, sentence, unnest({tok('s')}) AS term FROM cut WHERE regexp_matches(s, '{tx.ALTERNATIVE_CUES}'))
  WHERE term IN (SELECT term FROM lexicon)),
few AS (SELECT doc_id, sentence FROM held GROUP BY ALL HAVING count(*) BETWEEN 2 AND 4),
alt AS (
  SELECT x.doc_id, x.sentence, x.term AS a, y.term AS b FROM few f
  JOIN held x ON x.doc_id = f.doc_id AND x.sentence = f.sentence
  JOIN held y ON y.doc_id = x.doc_id AND y.sentence = x.sentence AND x.term < y.term)"""


@query(
    "alternative_pairs",
    f"""WITH {GRAPH}, {ALTERNATIVES} SELECT * FROM alt""",
)
def alternative_pairs(spark, sf_dir):
    return extraction.alternatives(docs_of(spark, sf_dir), "doc_id", F.col("text"), names_of(spark, sf_dir))


@query(
    "resolve_alternatives",
    f"""WITH RECURSIVE {GRAPH}, {ALTERNATIVES},
ways_out AS (SELECT a, b FROM alt UNION SELECT b, a FROM alt),
nodes AS (
  SELECT query_id, id, activation, row_number() OVER (PARTITION BY query_id ORDER BY round(activation, 12) DESC, id) AS place FROM s2),
links AS (
  SELECT n.query_id, n.place, m.id AS other FROM nodes n JOIN ways_out ON a = n.id JOIN nodes m ON m.query_id = n.query_id AND m.id = b),
lists AS (SELECT query_id, place, list(other) AS others FROM links GROUP BY ALL),
fold AS (
  SELECT DISTINCT query_id, 0::BIGINT AS place, []::VARCHAR[] AS lost FROM nodes
  UNION ALL
  SELECT f.query_id, n.place, CASE WHEN list_contains(lost, n.id) THEN lost ELSE list_concat(lost, coalesce(others, [])) END
  FROM fold f JOIN nodes n ON n.query_id = f.query_id AND n.place = f.place + 1
  LEFT JOIN lists l ON l.query_id = n.query_id AND l.place = n.place),
gone AS (SELECT query_id, arg_max(lost, place) AS lost FROM fold GROUP BY query_id),
won AS (SELECT n.query_id, n.place, n.id FROM nodes n JOIN gone g ON g.query_id = n.query_id WHERE NOT list_contains(lost, n.id)),
favour AS (
  SELECT w.query_id, other AS id, arg_min(w.id, w.place) AS in_favour_of
  FROM won w JOIN links l ON l.query_id = w.query_id AND l.place = w.place GROUP BY ALL)
SELECT n.query_id, n.id, round(activation, 6) AS activation, in_favour_of
FROM nodes n LEFT JOIN favour f ON f.query_id = n.query_id AND f.id = n.id""",
)
def resolve_alternatives(spark, sf_dir):
    """Alternatives: terms that stand in one sentence with a cue of choice."""
    ready = prepared(spark, sf_dir)
    state, _ = graph.spread_activation(seeds_of(spark, sf_dir, ready.names), ready.edges, 2)
    found = extraction.alternatives(docs_of(spark, sf_dir), "doc_id", F.col("text"), ready.names)
    out = graph.resolve_alternatives(state.select("query_id", "id", "activation"), found.select("a", "b").distinct())
    return out.withColumn("activation", F.round("activation", 6))


STOPS = ", ".join(f"'{x}'" for x in tx.STOP_TOKENS)
#: What commands over a part's words (a, b) and size name: form, extractor, context, confidence, the name as SQL.
NAMED_BY_FORM = (
    (0, "apt-install", "install-cmd", 0.95, "a"),
    (0, "apt-install", "install-cmd", 0.95, "b"),
    (1, "apk-add", "install-cmd", 0.95, "a"),
    (1, "apk-add", "install-cmd", 0.95, "b"),
    (2, "dnf-yum-install", "install-cmd", 0.95, "a"),
    (2, "systemctl-unit", "install-cmd", 0.95, "b || '.service'"),
    (3, "docker-run", "install-cmd", 0.95, "a"),
    (4, "composer-require", "install-cmd", 0.95, "a || b"),
    (5, "configure-with", "package-list", 0.85, "a"),
    (5, "configure-enable", "package-list", 0.85, "b"),
    (5, "ext-directive", "package-list", 0.85, "a"),
    (6, "docker-compose-image", "install-cmd", 0.95, "a"),
    (8, "pip-install", "install-cmd", 0.95, "a"),
    (9, "pacman-install", "install-cmd", 0.95, "a"),
    (9, "pacman-install", "install-cmd", 0.95, "'php-' || b"),
    (9, "php-ext-dash", "package-list", 0.85, "b"),
)


@query(
    "install_commands",
    f"""WITH p AS (
  SELECT p_partkey AS id, p_partkey % 10 AS form, lower(string_split(p_name, ' ')[1]) AS a, lower(string_split(p_name, ' ')[2]) AS b FROM part),
named AS ({" UNION ALL ".join(
    f"SELECT id, '{x}' AS extractor, '{c}' AS context, {v}::DOUBLE AS confidence, {t} AS term FROM p WHERE form = {f}"
    for f, x, c, v, t in NAMED_BY_FORM)})
SELECT * FROM named WHERE length(term) BETWEEN 2 AND 40 AND term NOT IN ({STOPS})""",
)
def install_commands(spark, sf_dir):
    """Commands and declarations over the parts' words: with versions, options, several names, prefixes, and one sentence of prose."""
    part = table(spark, sf_dir, "part")
    words, size = F.split("p_name", " "), F.col("p_size").cast("string")
    a, b = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    forms = (
        text("sudo apt-get install -y ", a, " ", b, "-server=", size),
        text("apk add --no-cache lib", a, " ", b, size),
        text("dnf install ", a, " && systemctl enable --now ", b, ".service"),
        text("docker pull ", a, ":", size),
        text("composer require ", a, "/", b),
        text("./configure --with-", a, " --enable-", b, "\nextension=", a),
        text("  image: \"", a, ":", size, "\"\n  ports: [80]"),
        text("They like ", a, " and ", b, " and never install them."),
        text("pip3 install --user ", a, "==", size, " && echo done"),
        text("pacman -Syu ", a, " php8.3-", b),
    )
    code = F.element_at(F.array(*forms), (F.col("p_partkey") % 10 + 1).cast("int"))
    return extraction.from_code(part.select(F.col("p_partkey").alias("id"), code.alias("code")), "id", F.col("code"))


@query(
    "canon_tokens",
    f"""WITH w AS (SELECT DISTINCT unnest({tok('text')}) AS term FROM documents),
a AS (SELECT term, regexp_replace(regexp_replace(lower(trim(term)), '[=:@].*$', ''), '\\d+(\\.\\d+)*', '', 'g') AS t FROM w),
b AS (SELECT term, regexp_replace(regexp_replace(t, '-(server|client|common|core|dev|devel|bin|doc|docs|data|utils?|tools?)$', ''), '^lib', '') AS t FROM a),
c AS (SELECT term, regexp_replace(regexp_replace(regexp_replace(t, '[^a-z0-9+#._\\-]', '', 'g'), '^[-._]+|[-._]+$', '', 'g'), '--+', '-', 'g') AS t FROM b)
SELECT term, t AS canonical FROM c WHERE length(t) BETWEEN 2 AND 40 AND NOT regexp_matches(t, '^\\d+$')
AND t NOT IN ({", ".join(f"'{x}'" for x in tx.STOP_TOKENS)})""",
)
def canon_tokens(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term"))
    # an outer explode keeps the filter above: below, each occurrence of a word would be made canonical, not each word
    out = words.distinct().select("term", F.explode_outer(F.array(tx.canon_token(F.col("term")))).alias("canonical"))
    return out.where(F.col("canonical").isNotNull())


@query(
    "canon_concepts",
    f"""WITH a AS (
  SELECT item_id, regexp_replace(lower(trim(text)), '^(the|a|an|your|my|how to|what is)\\s+', '') AS t
  FROM (SELECT item_id, unnest({SENTENCES}) AS text FROM benchmark)),
b AS (SELECT item_id, regexp_replace(regexp_replace(regexp_replace(t, '[^a-z0-9+#\\s._\\-]', '', 'g'), '\\s+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g') AS t FROM a)
SELECT DISTINCT item_id, t AS concept FROM b WHERE length(t) BETWEEN 3 AND 40 AND len(string_split(t, '-')) <= 2
AND NOT regexp_matches(t, '^\\d+$') AND t NOT IN ({", ".join(f"'{x}'" for x in tx.GENERIC_CONCEPTS)})""",
)
def canon_concepts(spark, sf_dir):
    parts = table(spark, sf_dir, "benchmark").select("item_id", F.explode(tx.sentences(F.col("text"))).alias("raw"))
    out = parts.select("item_id", tx.canon_concept(F.col("raw")).alias("concept"))
    return out.where(F.col("concept").isNotNull()).distinct()


@query(
    "grounding_check",
    rf"""WITH p AS (
  SELECT item_id, unnest({first_distinct('t', 24)}) AS proposal FROM (SELECT item_id, {tok('text')} AS t FROM benchmark)),
s AS (SELECT item_id, regexp_replace(lower(text), '[\s._/\-]+', '', 'g') AS s FROM benchmark),
n AS (SELECT item_id, lead(s, 1, s) OVER (ORDER BY item_id) AS s FROM s)
SELECT item_id, proposal, length(regexp_replace(proposal, '[\s._/\-]+', '', 'g')) >= 2
       AND contains(s, regexp_replace(proposal, '[\s._/\-]+', '', 'g')) AS grounded
FROM p JOIN n USING (item_id)""",
)
def grounding_check(spark, sf_dir):
    """An item's words proposed for the next item's text: grounded where they occur in it."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text", F.lit(1).alias("all"))
    items = ordered.numbered(items, ["all"], F.floor(F.col("item_id") / 10_000), "item_id")
    after = items.select((F.col("place") - 1).alias("place"), F.col("text").alias("following"))
    rows = items.join(after, "place", "left").select("item_id", F.coalesce("following", "text").alias("next"), "text")
    asked = rows.select("item_id", "next", F.explode(tx.query_tokens(F.col("text"))).alias("proposal"))
    return asked.select("item_id", "proposal", tx.occurs_in(F.col("next"), F.col("proposal")).alias("grounded"))


STOPPED = "(" + ", ".join(f"'{w}'" for w in dict.fromkeys(tx.ENTITY_STOPWORDS)) + ")"


@query(
    "entities_deterministic",
    f"""WITH a AS (
  SELECT item_id, list_transform(regexp_extract_all(text, '["''`]([^"''`]{{2,40}})["''`]', 1), lambda x: lower(trim(x))) AS quoted,
         list_transform(list_filter(regexp_extract_all(text, '\\b([A-Za-z][A-Za-z0-9_.+#/\\-]{{2,30}})\\b', 1),
           lambda w: regexp_matches(w, '[0-9./\\-]|^[a-z]+[A-Z]')), lambda w: lower(w)) AS tech,
         list_filter(string_split_regex(lower(text), '[^a-z0-9+#._\\-]+'), lambda w: length(w) >= 4 AND w NOT IN {STOPPED}) AS rest
  FROM benchmark),
b AS (SELECT item_id, list_filter(list_concat(quoted, tech), lambda x: length(x) > 0) AS found, rest FROM a),
c AS (SELECT item_id, CASE WHEN len(found) > 0 THEN found ELSE rest END AS picked FROM b)
SELECT item_id, array_to_string({first_distinct('picked', 12)}, ',') AS entities FROM c""",
)
def entities_deterministic(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(tx.entities(F.col("text")), ",").alias("entities"))


def stripped_queries(spark, sf_dir):
    """query_id, original, content, head: the head is the rarest content word that the corpus knows."""
    rows = benchmark_queries(spark, sf_dir).select(
        "query_id", "text", tx.question_tokens(F.col("text")).alias("t"), tx.content_tokens(F.col("text")).alias("c")
    )
    spread = corpus.breadth(table(spark, sf_dir, "documents"), "text", "source")
    each = rows.where(F.size("c") >= 2).select("query_id", F.posexplode("c").alias("place", "term"))
    fit = each.where((F.length("term") >= 3) & F.col("term").rlike("[a-zä-ü]"))
    head = (
        fit.join(spread, "term")
        .groupBy("query_id")
        .agg(F.min(F.struct("n_domains", "place", "term"))["term"].alias("head"))
    )
    return rows.join(head, "query_id", "left").select(
        "query_id",
        "text",
        F.array_join("t", " ").alias("original"),
        F.array_join("c", " ").alias("content"),
        "head",
    )


HEAD = """
hp AS (SELECT query_id, unnest(c) AS term, generate_subscripts(c, 1) AS place FROM qs WHERE len(c) >= 2),
hd AS (
  SELECT query_id, arg_min(hp.term, (n_domains, place)) AS head FROM hp JOIN spread s ON s.term = hp.term
  WHERE length(hp.term) >= 3 AND regexp_matches(hp.term, '[a-zä-ü]') GROUP BY query_id),
sq AS (
  SELECT qs.query_id, text, array_to_string(t, ' ') AS original, array_to_string(c, ' ') AS content, head
  FROM qs LEFT JOIN hd ON hd.query_id = qs.query_id)"""


@query("strip_query", f"WITH {TERMS}, {STRIP}, {HEAD} SELECT query_id, original, content, head FROM sq")
def strip_query(spark, sf_dir):
    return stripped_queries(spark, sf_dir).drop("text")


@query(
    "expand_queries",
    f"""WITH {TERMS}, {STRIP}, {HEAD},
e AS (
  SELECT query_id, list_filter([original, content, head,
    content || CASE WHEN regexp_matches(text, '{tx.TECHNICAL_HINT}') THEN ' dependencies' ELSE ' explained' END,
    content || CASE WHEN regexp_matches(text, '{tx.TECHNICAL_HINT}') THEN ' install requirements' ELSE ' guide basics' END],
    lambda x: x IS NOT NULL AND trim(x) <> '') AS v FROM sq)
SELECT query_id, array_to_string({first_distinct('v', 3)}, '|') AS variants FROM e""",
)
def expand_queries(spark, sf_dir):
    hint = F.col("text").rlike(tx.TECHNICAL_HINT)
    shaped = [
        F.concat("content", F.when(hint, F.lit(a)).otherwise(F.lit(b)))
        for a, b in ((" dependencies", " explained"), (" install requirements", " guide basics"))
    ]
    all_variants = F.filter(
        F.array("original", "content", "head", *shaped), lambda x: x.isNotNull() & (F.trim(x) != "")
    )
    return stripped_queries(spark, sf_dir).select(
        "query_id", F.array_join(F.slice(F.array_distinct(all_variants), 1, 3), "|").alias("variants")
    )


@query(
    "glue_terms",
    f"""WITH {TERMS} SELECT term, round(breadth, 6) AS breadth FROM spread
WHERE breadth > 0.10 AND NOT contains(term, '-') AND NOT contains(term, '.')""",
)
def glue_terms(spark, sf_dir):
    """Prose-only terms on more than a tenth of all domains are glue, unless they look like package names."""
    out = corpus.breadth(table(spark, sf_dir, "documents"), "text", "source")
    glue = (F.col("breadth") > 0.10) & ~F.col("term").contains("-") & ~F.col("term").contains(".")
    return out.where(glue).select("term", F.round("breadth", 6).alias("breadth"))


@query(
    "topic_subjects",
    f"""WITH {TERMS}, p AS (
  SELECT item_id AS query_id, unnest(d) AS term, generate_subscripts(d, 1) AS place
  FROM (SELECT item_id, {first_distinct('t', 1000)} AS d FROM bt))
SELECT query_id, p.term, round(coalesce(breadth, 0), 6) AS breadth FROM p LEFT JOIN spread s ON s.term = p.term
WHERE length(p.term) >= 3 AND coalesce(breadth, 0) <= 0.06
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY coalesce(breadth, 0), place) <= 2""",
)
def topic_subjects(spark, sf_dir):
    spread = corpus.breadth(table(spark, sf_dir, "documents"), "text", "source").select("term", "breadth")
    asked = benchmark_queries(spark, sf_dir).select(
        "query_id", F.posexplode(F.array_distinct(tx.tokens(F.col("text")))).alias("place", "term")
    )
    known = asked.where(F.length("term") >= 3).join(spread, "term", "left")
    known = known.withColumn("breadth", F.coalesce("breadth", F.lit(0.0))).where("breadth <= 0.06")
    best = known.transform(lambda d: tables.first_wins(d, ["query_id", "term"], F.col("place")))
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy("breadth", "place")
    out = best.withColumn("n", F.row_number().over(order)).where("n <= 2")
    return out.select("query_id", "term", F.round("breadth", 6).alias("breadth"))


VOTES = f"""
{TERMS}, {ZONES},
asked AS (SELECT query_id, term FROM (SELECT query_id, term FROM q)),
sg AS (
  SELECT query_id, a.term, coalesce(df, 0) AS module_df, coalesce(page_df, 0) AS page_df, coalesce(title_df, 0) AS title_df
  FROM asked a LEFT JOIN df ON df.term = a.term LEFT JOIN page_df p ON p.term = a.term LEFT JOIN title_df t ON t.term = a.term),
vt AS (
  SELECT *, (module_df = 0 AND page_df = 0)::INT + (title_df > 0)::INT AS yes,
         (title_df = 0 AND page_df >= greatest(3, (SELECT count(*) FROM pages) * 0.3))::INT AS no FROM sg),
judged AS (
  SELECT query_id, term, CASE WHEN yes + no = 0 THEN 'unknown' WHEN yes * 2 >= yes + no THEN 'subject' ELSE 'generic' END AS cls,
         round(CASE WHEN yes + no = 0 THEN 0 ELSE greatest(yes, no) / (yes + no)::DOUBLE END, 6) AS confidence FROM vt)"""


def judged_words(spark, sf_dir):
    """query_id, term, cls, confidence: votes of unknown words, heading topics and words spread without being topics."""
    pages = pages_of(spark, sf_dir)
    asked = corpus.asked_terms(benchmark_queries(spark, sf_dir))
    frequency = corpus.doc_frequency(table(spark, sf_dir, "documents"), "text")
    known = asked.join(frequency, "term", "left").join(zone_frequency(spark, sf_dir), "term", "left")
    df, page, title = (F.coalesce(c, F.lit(0)) for c in ("df", "page_df", "title_df"))
    spread = F.greatest(F.lit(3.0), F.lit(pages.count() * 0.3))
    yes = ((df == 0) & (page == 0)).cast("int") + (title > 0).cast("int")
    no = ((title == 0) & (page >= spread)).cast("int")
    voted = known.select("query_id", "term", yes.alias("yes"), no.alias("no"), (yes + no).alias("votes"))
    cls = F.when(F.col("votes") == 0, "unknown").when(F.col("yes") * 2 >= F.col("votes"), "subject").otherwise("generic")
    share = F.when(F.col("votes") == 0, 0.0).otherwise(F.greatest("yes", "no") / F.greatest("votes", F.lit(1)))
    return voted.select("query_id", "term", cls.alias("cls"), F.round(share, 6).alias("confidence"))


@query("word_judge", f"WITH {VOTES} SELECT * FROM judged")
def word_judge(spark, sf_dir):
    return judged_words(spark, sf_dir)


@query("any_subject", f"WITH {VOTES} SELECT query_id, bool_or(cls = 'subject') AS yes FROM judged GROUP BY query_id")
def any_subject(spark, sf_dir):
    return judged_words(spark, sf_dir).groupBy("query_id").agg(F.bool_or(F.col("cls") == "subject").alias("yes"))


#: The graph over the pages' texts and hosts: the same relations as over documents, by other names.
PAGE_GRAPH = GRAPH[: GRAPH.index("ok_edges AS")].replace("documents", "learned")


@query(
    "learn_e2e",
    f"""WITH learned AS (SELECT page_id AS doc_id, {PLAIN} AS text, {DOMAIN} AS source FROM pages),
{PAGE_GRAPH}
capped AS (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(weight, 9) DESC, dst) <= 24)
SELECT src, dst, round(npmi, 6) AS npmi, round(weight, 6) AS weight, n_obs, n_domains FROM capped""",
)
def learn_e2e(spark, sf_dir):
    """Pages to edges: text, lexicon, co-occurrence, association, evidence, out-degree, in one job."""
    pages = pages_of(spark, sf_dir).select(
        "page_id", web.text_of(F.col("html")).alias("text"), web.domain_of(F.col("url")).alias("domain")
    )
    index = corpus.Index.build(pages, "page_id", {"text": 1.0}, "domain")
    built = graph.capped(graph.edges(index, graph.lexicon(index)))
    return built.select("src", "dst", F.round("npmi", 6).alias("npmi"), F.round("weight", 6).alias("weight"), "n_obs", "n_domains")


@query("distinctive_by_query", f"WITH {TERMS} SELECT query_id, count(*) AS n FROM rare GROUP BY query_id")
def distinctive_by_query(spark, sf_dir):
    return distinctive_of(spark, sf_dir).groupBy("query_id").agg(F.count("*").alias("n"))
