"""Queries of line-framed sources, result pages, payloads of models and tools, and curated rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import payloads, web
from ..functions import text as tx
from ..operators import graph
from ..sources import lines, results
from ..sources.tables import scratch
from ..streaming import state
from .registry import first_distinct, query, table, tok
from .texts import JUNK, pages_of

EVENT_LINES = "event_id long, user_id long, event_type string"


def event_lines(spark, sf_dir):
    """Events as JSON lines, each tenth followed by a line that is no JSON."""
    rows = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("event_id", "user_id", "event_type")).alias("j"))
    both = F.when(F.col("event_id") % 10 == 0, F.array("j", F.lit('{"event_id": oops'))).otherwise(F.array("j"))
    return rows.select(F.explode(both).alias("value"))


@query("ndjson_events", "SELECT event_id, user_id, event_type FROM events")
def ndjson_events(spark, sf_dir):
    return lines.ndjson(event_lines(spark, sf_dir), EVENT_LINES)


@query("stream_ndjson_events", "SELECT event_id, user_id, event_type FROM events")
def stream_ndjson_events(spark, sf_dir):
    """Lines written by the text sink, read back as a stream."""
    folder = scratch(spark, "lines")
    event_lines(spark, sf_dir).write.text(f"{folder}/lines")
    return state.run_once(lines.ndjson_stream(spark, f"{folder}/lines", EVENT_LINES), folder)


@query("sse_events", "SELECT conv_id, role AS event, text AS data FROM conversations WHERE text <> ''")
def sse_events(spark, sf_dir):
    """Turns framed as server-sent events with a comment each, and parsed again."""
    data = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("data: "), x))
    framed = F.concat(F.array(F.lit(": turn"), F.concat(F.lit("event: "), F.col("role"))), data, F.array(F.lit("")))
    turns = table(spark, sf_dir, "conversations").where(F.col("text").isNotNull())
    cut = turns.select("conv_id", "turn", F.posexplode(framed).alias("line", "value"))
    return lines.server_events(cut.select("conv_id", F.struct("turn", "line").alias("at"), "value"), "conv_id", "at").drop("n")


def result_html(spark, sf_dir):
    """engine, part, html: ten pages' links per part, in the markup of one of three engines."""
    url, engine = F.col("url"), F.col("page_id") % 3
    title = F.concat(F.lit("Page "), F.col("page_id").cast("string"), F.lit(" &amp; more"))
    address = F.replace(url, F.lit("&"), F.lit("&amp;"))
    # Spark breaks base64 into lines of 76 signs, links have none
    coded = F.rtrim(F.translate(F.base64(url.cast("binary")), "+/\r\n", "-_"), F.lit("="))
    block = (
        F.when(engine == 0, F.concat(F.lit('<a class="result__a" href="//duckduckgo.com/l/?uddg='), F.url_encode(url),
                                     F.lit('&amp;rut=x"><b>'), title, F.lit('</b></a> <a class="result__snippet" href="#">About '), title, F.lit("</a>")))
        .when(engine == 1, F.concat(F.lit('<li class="b_algo"><h2><a href="https://www.bing.com/ck/a?!&amp;u=a1'), coded,
                                    F.lit('">'), title, F.lit('</a></h2><div class="b_caption">About '), title, F.lit("</div></li>")))
        .otherwise(F.concat(F.lit('<li><a class="title" href="'), address, F.lit('">'), title,
                            F.lit('</a><p class="s">About '), title, F.lit("</p></li>")))
    )
    name = F.element_at(F.array(*[F.lit(e.name) for e in results.ENGINES]), (engine + 1).cast("int"))
    rows = pages_of(spark, sf_dir).select(
        name.alias("engine"), F.floor(F.col("page_id") / 30).alias("part"), "page_id", block.alias("block")
    )
    held = F.array_sort(F.collect_list(F.struct("page_id", "block")))
    return rows.groupBy("engine", "part").agg(F.array_join(F.transform(held, lambda x: x["block"]), "\n").alias("html"))


@query(
    "result_pages",
    f"""SELECT ['duckduckgo', 'bing', 'mojeek'][(page_id % 3)::INT + 1] AS engine, page_id // 30 AS part,
row_number() OVER (PARTITION BY page_id % 3, page_id // 30 ORDER BY page_id) AS rank, url,
'Page ' || page_id || ' & more' AS title, 'About Page ' || page_id || ' & more' AS snippet FROM pages WHERE NOT {JUNK}""",
)
def result_pages(spark, sf_dir):
    return results.results(result_html(spark, sf_dir), F.col("engine"), F.col("html"))


@query(
    "loose_json",
    "SELECT event_id, CASE WHEN event_id % 6 < 5 THEN json_extract(props, '$.k')::INT END AS k FROM events",
)
def loose_json(spark, sf_dir):
    """Properties as models write JSON: plain, fenced, in prose, with a trailing comma, in single quotes, cut off."""
    props = F.col("props")
    forms = (
        props,
        F.concat(F.lit("```json\n"), props, F.lit("\n```")),
        F.concat(F.lit("Here it is: "), props, F.lit(" Anything else?")),
        F.regexp_replace(props, r"\}\s*$", ", }"),
        F.concat(F.lit("{'k': "), F.get_json_object(props, "$.k"), F.lit(", 'by': 'x'}")),
        F.regexp_replace(props, r"\}\s*$", ""),
    )
    said = F.element_at(F.array(*forms), (F.col("event_id") % 6 + 1).cast("int"))
    value = F.try_variant_get(payloads.loose_json(said), "$.k", "int")
    return table(spark, sf_dir, "events").select("event_id", value.alias("k"))


@query(
    "masked_keys",
    """WITH k AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'env:KEY_' || c_custkey
  WHEN 2 THEN 'sk-' || c_custkey ELSE 'sk-' || c_name END AS key FROM customer)
SELECT c_custkey, CASE WHEN key IS NULL THEN '(none)' WHEN starts_with(key, 'env:') THEN key
  WHEN length(key) <= 8 THEN '••••' ELSE left(key, 3) || '…' || right(key, 4) END AS shown FROM k""",
)
def masked_keys(spark, sf_dir):
    k = F.col("c_custkey")
    key = (
        F.when(k % 4 == 1, F.concat(F.lit("env:KEY_"), k.cast("string")))
        .when(k % 4 == 2, F.concat(F.lit("sk-"), k.cast("string")))
        .when(k % 4 == 3, F.concat(F.lit("sk-"), F.col("c_name")))
    )
    return table(spark, sf_dir, "customer").select("c_custkey", payloads.masked_key(key).alias("shown"))


@query(
    "prompt_context",
    """SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN NULL
  ELSE nullif(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '') END AS context FROM documents""",
)
def prompt_context(spark, sf_dir):
    """The context that a prompt carries: fenced, under its heading, or not at all."""
    text = F.col("text")
    prompt = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Rules.\n<<<UNTRUSTED\n"), text, F.lit("\nUNTRUSTED>>>\nGo.")))
        .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Rules.\n# CONTEXT (notes)\n"), text))
        .otherwise(F.lit("Rules alone."))
    )
    return table(spark, sf_dir, "documents").select("doc_id", payloads.context_block(prompt).alias("context"))


@query(
    "exposed_names",
    """SELECT p_partkey, regexp_replace(p_brand, '[^a-zA-Z0-9_]', '_', 'g') || '__' || regexp_replace(p_name, '[^a-zA-Z0-9_]', '_', 'g') AS name FROM part""",
)
def exposed_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", payloads.exposed_name(F.col("p_brand"), F.col("p_name")).alias("name"))


@query(
    "reply_flags",
    f"""SELECT doc_id, doc_id % 2 = 0 AND length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 200 AS dumps_code,
regexp_matches(text, '{payloads.PERMISSION_CUES}') AS asks, regexp_matches(text, '{payloads.JSX_CUES}') AS jsx
FROM documents WHERE text IS NOT NULL AND NOT contains(text, '```')""",
)
def reply_flags(spark, sf_dir):
    """Replies that dump code (here: every second text, fenced but not closed), that ask, and that hold markup."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull() & ~F.contains("text", F.lit("```")))
    reply = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("See:\n```html\n"), F.col("text"))).otherwise(F.col("text"))
    return docs.select(
        "doc_id",
        payloads.dumps_code(reply).alias("dumps_code"),
        payloads.asks_permission(reply).alias("asks"),
        payloads.looks_like_jsx(reply).alias("jsx"),
    )


#: A sample dictionary of parts of speech.
PARTS_OF_SPEECH = (
    ("the", "article"), ("and", "conjunction"), ("with", "preposition"), ("they", "pronoun"), ("data", "noun"),
    ("time", "Noun phrase"), ("run", "verb"), ("quick", "adjective"), ("often", "adverb"), ("paris", "proper noun"),
)


@query(
    "pos_votes",
    f"""WITH p(term, pos) AS (VALUES {", ".join(f"('{t}', '{p}')" for t, p in PARTS_OF_SPEECH)}),
w AS (SELECT DISTINCT unnest({tok('text')}) AS term FROM documents)
SELECT term, CASE WHEN starts_with(lower(pos), 'noun') OR lower(pos) IN ('proper noun', 'name') THEN true
  WHEN lower(pos) IN ('article', 'preposition', 'pronoun', 'conjunction', 'adverb') THEN false END AS subject
FROM w LEFT JOIN p USING (term)""",
)
def pos_votes(spark, sf_dir):
    known = spark.createDataFrame(PARTS_OF_SPEECH, "term string, pos string")
    words = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term"))
    return words.distinct().join(known, "term", "left").select("term", payloads.pos_vote(F.col("pos")).alias("subject"))


def _esc(c: str) -> str:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = f"replace({c}, '{plain}', '{entity}')"
    return c


@query(
    "filled_templates",
    f"""SELECT p_partkey, '<h2>' || {_esc("p_name || ' <&> ' || p_brand")} || '</h2><ul>' || array_to_string(list_transform(
string_split(p_type, ' '), lambda w: '<li>' || {_esc("w")} || ' of ' || {_esc("p_brand")} || '</li>'), '') || '</ul>' AS html FROM part""",
)
def filled_templates(spark, sf_dir):
    values = {
        "head": F.concat("p_name", F.lit(" <&> "), "p_brand"),
        "words": F.split("p_type", " "),
        "brand": F.col("p_brand"),
    }
    skeleton = "<h2>{{head}}</h2><ul>{{#each}}<li>{{words}} of {{brand}}</li>{{/each}}</ul>{{missing}}"
    return table(spark, sf_dir, "part").select("p_partkey", payloads.filled(skeleton, values, ("words",)).alias("html"))


@query(
    "usage_labels",
    """WITH n AS (SELECT doc_id, ceil(length(coalesce(text, '')) / 3.6::DOUBLE)::BIGINT AS tokens FROM documents),
s AS (SELECT *, tokens * 37 AS ms, (tokens + 50) // 100 AS tk, (tokens * 37 + 50) // 100 AS ts FROM n)
SELECT doc_id, tokens, CASE WHEN tokens >= 1000 THEN tk // 10 || '.' || tk % 10 || 'k' ELSE tokens::VARCHAR END AS shown,
CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN ts // 10 || '.' || ts % 10 || 's'
  ELSE ms // 60000 || 'm ' || (ms % 60000 + 500) // 1000 || 's' END AS took,
round(least(1.0, tokens / 8192.0::DOUBLE), 6) AS used FROM s""",
)
def usage_labels(spark, sf_dir):
    """Estimated tokens of each text, how they and a duration are shown, and the share of a context window."""
    rows = table(spark, sf_dir, "documents").select("doc_id", tx.session_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    n = F.col("tokens")
    return rows.select(
        "doc_id",
        "tokens",
        payloads.short_count(n).alias("shown"),
        payloads.short_duration(n * 37).alias("took"),
        F.round(F.least(F.lit(1.0), n / F.lit(8192.0)), 6).alias("used"),
    )


BOUNDED = "regexp_replace(lower({c}), '([a-z0-9]+)', chr(1) || '\\1' || chr(1), 'g')"


@query(
    "concept_proposals",
    f"""WITH p AS (
  SELECT d.doc_id, d.text, unnest({first_distinct('e.t', 20)}) AS proposal
  FROM documents d JOIN (SELECT doc_id, {tok('text')} AS t FROM documents) e ON e.doc_id = d.doc_id + 1 WHERE length(d.text) >= 200)
SELECT doc_id, proposal, contains({BOUNDED.format(c='text')}, {BOUNDED.format(c='proposal')}) AS grounded FROM p""",
)
def concept_proposals(spark, sf_dir):
    """The next document's words proposed as concepts: grounded where they stand in the text, else rejected."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    said = docs.select((F.col("doc_id") - 1).alias("doc_id"), tx.query_tokens(F.col("text"), 20).alias("proposals"))
    rows = docs.where(F.length("text") >= 200).join(said, "doc_id")
    # one text each, set apart by a generator, so that it is not marked again for every proposal
    marked = rows.select("doc_id", "proposals", F.explode(F.array(payloads.bounded(F.col("text")))).alias("marked"))
    tested = F.transform(
        "proposals",
        lambda p: F.struct(p.alias("proposal"), F.contains(F.col("marked"), payloads.bounded(p)).alias("grounded")),
    )
    return marked.select("doc_id", F.explode(tested).alias("x")).select("doc_id", "x.*")


@query(
    "term_snippets",
    """WITH p AS (SELECT doc_id, text, strpos(lower(text), 'data') - 1 AS place FROM documents WHERE contains(lower(text), 'data'))
SELECT doc_id, trim(regexp_replace(substr(text, greatest(1, place - 39), 160), '\\s+', ' ', 'g')) AS snippet FROM p""",
)
def term_snippets(spark, sf_dir):
    """What stands around the first ``data`` of a text."""
    from ..operators.extraction import snippet_of

    docs = table(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit("data")))
    return docs.select("doc_id", snippet_of(F.col("text"), F.lit("data")).alias("snippet"))


@query(
    "learn_guards",
    f"""WITH c AS (
  SELECT conv_id, turn, role, text, {first_distinct('t', 12)} AS words,
         lower(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)) AS recent
  FROM (SELECT *, list_filter({tok('text')}, lambda x: length(x) >= 4) AS t FROM conversations))
SELECT conv_id, turn, coalesce(len(list_filter(words, lambda w: contains(recent, w))) > 0, false) AS covered,
       regexp_matches(text, '(?i)\\b({"|".join(payloads.OWN_TOOLS)})\\b') AS own_tool, len(words) > 0 AS substance
FROM c WHERE role = 'user' AND text IS NOT NULL""",
)
def learn_guards(spark, sf_dir):
    """Per user turn: what speaks against a learning cycle (said in the last six turns, own tool, no substance)."""
    past = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-6, -1)
    turns = table(spark, sf_dir, "conversations").withColumn("recent", F.lower(F.array_join(F.collect_list("text").over(past), "\n")))
    words = F.slice(F.array_distinct(F.filter(tx.tokens(F.col("text")), lambda x: F.length(x) >= 4)), 1, 12)
    rows = turns.where((F.col("role") == "user") & F.col("text").isNotNull()).withColumn("words", words)
    return rows.select(
        "conv_id",
        "turn",
        F.exists("words", lambda w: F.contains("recent", w)).alias("covered"),
        F.col("text").rlike(rf"(?i)\b({'|'.join(payloads.OWN_TOOLS)})\b").alias("own_tool"),
        (F.size("words") > 0).alias("substance"),
    )


@query(
    "seed_edges",
    """WITH s AS (SELECT n_name AS src, r_name AS dst, CASE WHEN n_nationkey % 5 = 0 THEN 'alternative' ELSE 'requires' END AS relation
  FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT src, dst, relation, 1.0::DOUBLE AS weight, 99 AS n_obs, 1 AS seeded FROM s
UNION SELECT dst, src, relation, 1.0, 99, 1 FROM s""",
)
def seed_edges(spark, sf_dir):
    """Curated pairs as seeded edges in both directions."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    pairs = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
        F.col("n_name").alias("src"),
        F.col("r_name").alias("dst"),
        F.when(F.col("n_nationkey") % 5 == 0, "alternative").otherwise("requires").alias("relation"),
    )
    return graph.seeded(pairs)


@query(
    "embedding_texts",
    """SELECT p_partkey, concat_ws(' — ', p_name, CASE WHEN p_partkey % 3 > 0 THEN p_type END, p_brand) AS text
FROM part WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL)""",
)
def embedding_texts(spark, sf_dir):
    """What is still to be embedded, and the text it is embedded by (blank fields skipped)."""
    have = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select(F.col("vec_id").alias("p_partkey"))
    kind = F.when(F.col("p_partkey") % 3 > 0, F.col("p_type")).otherwise("  ")
    pending = table(spark, sf_dir, "part").join(have, "p_partkey", "left_anti")
    return pending.select("p_partkey", payloads.embedding_text(F.col("p_name"), kind, F.col("p_brand")).alias("text"))
