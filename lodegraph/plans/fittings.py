"""Queries of endpoints and machines, recovered calls, catalogues, sinks, gates of sources, and shaped questions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import machines
from ..functions import text as tx
from ..operators import calls, corpus, graph, tables
from ..sources import lines
from ..sources.tables import commit, latest, scratch
from .graphs import GRAPH, prepared, seeds_of
from .lexical import benchmark_queries, document_index
from .registry import first_distinct, query, table, tok
from .texts import PAGE_GRAPH, PLAIN, DOMAIN, STOPPED, pages_of


@query(
    "base_urls",
    """WITH s AS (SELECT s_suppkey, ['ollama', 'openai', 'anthropic'][(s_suppkey % 3)::INT + 1] AS kind,
  [11434, 443, 443][(s_suppkey % 3)::INT + 1] AS port, ['', '/v1', ''][(s_suppkey % 3)::INT + 1] AS path,
  [1, 2, 3, 4, 5][(s_suppkey % 5)::INT + 1] AS form, '10.0.' || s_suppkey % 250 || '.2' AS h FROM supplier)
SELECT s_suppkey, CASE form
  WHEN 1 THEN CASE WHEN port = 443 THEN 'https://' || h || path ELSE 'http://' || h || ':' || port || path END
  WHEN 2 THEN 'http://' || h || ':8080' || path
  WHEN 3 THEN 'https://host' || s_suppkey || '.example' || path
  WHEN 4 THEN 'http://host' || s_suppkey || '.example/api' END AS url, form = 4 AS warned FROM s""",
)
def base_urls(spark, sf_dir):
    """Typed addresses of endpoints: bare hosts, with a port, whole, with a path, and of a scheme that is none."""
    n = F.col("s_suppkey")
    address = F.concat(F.lit("10.0."), (n % 250).cast("string"), F.lit(".2"))
    name = F.concat(F.lit("host"), n.cast("string"), F.lit(".example"))
    forms = [address, F.concat(address, F.lit(":8080")), F.concat(F.lit(" HTTPS://"), name, F.lit("/ ")),
             F.concat(F.lit("http://"), name, F.lit("/api/")), F.concat(F.lit("ftp://"), name)]
    kinds = F.array(*[F.lit(k) for k in machines.ENDPOINT_DEFAULTS])
    found = machines.base_url(F.element_at(F.array(*forms), (n % 5 + 1).cast("int")), F.element_at(kinds, (n % 3 + 1).cast("int")))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", found.alias("f"))
    return rows.select("s_suppkey", F.col("f.url").alias("url"), F.col("f.warning").isNotNull().alias("warned"))


@query(
    "placement",
    """WITH s AS (SELECT s_suppkey, s_suppkey % 40 * 0.5 AS model, nullif(s_suppkey % 25, 0)::DOUBLE AS gpu, s_suppkey * 37 % 900 AS pct,
  s_suppkey % 17 AS cores FROM supplier)
SELECT s_suppkey, coalesce(model * 1.2 <= gpu, false) AS fits,
  CASE WHEN pct > 0 THEN CASE WHEN cores > 0 THEN least(greatest(1, floor(pct / 100.0 + 0.5)), cores) ELSE greatest(1, floor(pct / 100.0 + 0.5)) END END::INT AS threads,
  s_suppkey % 3 <> 1 AS matches, CASE s_suppkey % 3 WHEN 0 THEN NULL ELSE CASE WHEN s_suppkey % 2 = 0 THEN 'ROCR' ELSE 'CUDA' END || '_VISIBLE_DEVICES=1,0' END AS variable FROM s""",
)
def placement(spark, sf_dir):
    n = F.col("s_suppkey")
    want = F.when(n % 3 > 0, F.array(F.lit(1), F.lit(0)))
    have = F.when(n % 3 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1), F.lit(0)))
    backend = F.when(n % 2 == 0, "rocm").otherwise("cuda")
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        machines.fits(n % 40 * 0.5, F.nullif(n % 25, F.lit(0)).cast("double")).alias("fits"),
        machines.threads(n * 37 % 900, (n % 17).cast("int")).alias("threads"),
        machines.order_matches(want, have).alias("matches"),
        machines.order_variable(want, backend).alias("variable"),
    )


@query(
    "memory_estimate",
    """WITH s AS (SELECT s_suppkey, 1000.0 * (s_suppkey % 9) AS w, 2048 * (1 + s_suppkey % 8) AS ctx, s_suppkey % 2 = 0 AS b, 500.0 * (s_suppkey % 5) AS free FROM supplier),
m AS (SELECT *, ctx / 1000.0 * 80 + CASE WHEN b THEN 450 ELSE 0 END AS more FROM s)
SELECT s_suppkey, round((w + more)::DOUBLE, 6) AS total, round((w + more)::DOUBLE / 16384, 6) AS fraction, more > free AS over FROM m""",
)
def memory_estimate(spark, sf_dir):
    n = F.col("s_suppkey")
    found = machines.memory((n % 9) * 1000.0, 2048 * (1 + n % 8), n % 2 == 0, F.lit(16384.0), (n % 5) * 500.0)
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", found.alias("m"))
    return rows.select("s_suppkey", F.round("m.total", 6).alias("total"), F.round("m.fraction", 6).alias("fraction"), "m.over")


@query(
    "health_lines",
    """WITH h AS (SELECT s_suppkey, s_name AS engine, s_suppkey % 4 > 0 AS ok, s_suppkey % 120 AS n, s_suppkey * 31 AS ms FROM supplier)
SELECT s_suppkey, rpad(engine, greatest(length(engine), 12)::INT, ' ') || ' ' || CASE WHEN ok THEN 'ok   ' ELSE 'FAIL ' END || ' '
  || lpad(n::VARCHAR, greatest(length(n::VARCHAR), 2)::INT, ' ') || ' results ' || lpad(ms::VARCHAR, greatest(length(ms::VARCHAR), 5)::INT, ' ') || 'ms'
  || CASE WHEN ok THEN '' ELSE ' — HTTP 429' END AS line FROM h""",
)
def health_lines(spark, sf_dir):
    n = F.col("s_suppkey")
    line = machines.health_line(F.col("s_name"), n % 4 > 0, n % 120, n * 31, F.when(n % 4 == 0, "HTTP 429"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", line.alias("line"))


TOOLS = ("write_file", "read_file")


@query(
    "recovered_calls",
    """WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id, 1 AS place, 'write_file' AS name, k AS path FROM e WHERE event_id % 4 <> 3
UNION ALL SELECT event_id, 2, 'read_file', 'f' || event_id FROM e WHERE event_id % 4 < 2""",
)
def recovered_calls(spark, sf_dir):
    """Calls written into prose: several in one text, nested, with raw line ends, of unknown tools, cut off."""
    k, n = F.get_json_object("props", "$.k"), F.col("event_id").cast("string")
    first = F.concat(F.lit('Now {"name": "write_file", "arguments": {"path": "'), k, F.lit('", "text": "a {\n b"}} and '))
    second = F.concat(F.lit('{"function": {"name": "read_file", "arguments": "{\\"file\\": \\"f'), n, F.lit('\\"}"}}.'))
    last = (
        F.when(F.col("event_id") % 4 < 2, second)
        .when(F.col("event_id") % 4 == 2, F.lit('{"name": "no_such", "arguments": {}} {not json} {"name": '))
        .otherwise(F.lit("nothing"))
    )
    said = F.concat(F.when(F.col("event_id") % 4 == 3, F.lit('{"name": "write_file", ')).otherwise(first), last)
    found = calls.recovered(table(spark, sf_dir, "events"), "event_id", said, TOOLS)
    return found.select("event_id", "place", "name", calls.picked(F.col("arguments"), "path", "file").alias("path"))


@query(
    "catalogue_models",
    """SELECT p_name || '-' || p_size || 'b-' || p_partkey AS id, (p_partkey * 7919 % 100003)::BIGINT AS downloads, p_size || 'B' AS size_hint
FROM part WHERE p_partkey % 10 > 0 ORDER BY downloads DESC, id LIMIT 12""",
)
def catalogue_models(spark, sf_dir):
    """A hub's catalogue as JSON (entries without an id are dropped): the twelve most downloaded."""
    entry = F.struct(
        F.when(F.col("p_partkey") % 10 > 0, F.concat("p_name", F.lit("-"), F.col("p_size").cast("string"), F.lit("b-"), F.col("p_partkey").cast("string"))).alias("id"),
        (F.col("p_partkey") * 7919 % 100003).alias("downloads"),
    )
    pages = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 50).alias("page")).agg(F.to_json(F.collect_list(entry)).alias("body"))
    read = pages.select(F.explode(F.from_json("body", "array<struct<id string, downloads long>>")).alias("m")).select("m.*")
    best = read.where("id is not null").orderBy(F.coalesce("downloads", F.lit(0)).desc(), "id").limit(12)
    return best.select("id", F.coalesce("downloads", F.lit(0)).alias("downloads"), tx.size_hint(F.col("id")).alias("size_hint"))


@query("ndjson_sink", "SELECT event_id, user_id, event_type FROM events")
def ndjson_sink(spark, sf_dir):
    """Rows written as JSON lines, and what a reader of the lines finds."""
    folder = scratch(spark, "ndjson")
    lines.write_ndjson(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), folder)
    return lines.ndjson(spark.read.text(folder), "event_id long, user_id long, event_type string")


@query(
    "snapshot_commits",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'changed' ELSE c_name END AS c_name FROM customer
UNION ALL SELECT c_custkey + 10000000, 'new' FROM customer WHERE c_custkey % 7 = 0""",
)
def snapshot_commits(spark, sf_dir):
    """Two versions of a table are committed; a third is written but never committed, and no reader sees it."""
    root, rows = scratch(spark, "snapshots"), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    commit(rows, root)
    changed = rows.where("c_custkey % 3 = 0").withColumn("c_name", F.lit("changed")).unionByName(
        rows.where("c_custkey % 7 = 0").select((F.col("c_custkey") + 10_000_000).alias("c_custkey"), F.lit("new").alias("c_name"))
    )
    commit(tables.upsert(latest(spark, root), changed, "c_custkey", ["c_name"]), root)
    commit(rows.limit(0), root, publish=False)
    return latest(spark, root)


@query(
    "embedding_writes",
    """SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 'new' ELSE 'old' END AS model, CASE WHEN vec_id % 4 = 0 THEN 2 ELSE len(embedding) END AS width
FROM embeddings UNION ALL SELECT vec_id + 10000000, 'new', 2 FROM embeddings WHERE vec_id % 50 = 0""",
)
def embedding_writes(spark, sf_dir):
    """Vectors written over older ones of the same id, as a new snapshot."""
    root = scratch(spark, "vectors")
    have = table(spark, sf_dir, "embeddings").select("vec_id", F.lit("old").alias("model"), "embedding", F.lit(0).alias("at"))
    two = F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>")
    fresh = have.where("vec_id % 4 = 0").select("vec_id").unionByName(have.where("vec_id % 50 = 0").select((F.col("vec_id") + 10_000_000).alias("vec_id")))
    both = have.withColumn("embedding", F.col("embedding").cast("array<float>")).unionByName(
        fresh.select("vec_id", F.lit("new").alias("model"), two.alias("embedding"), F.lit(1).alias("at"))
    )
    commit(tables.latest_per_key(both, "vec_id", F.col("at").desc()), root)
    return latest(spark, root).select("vec_id", "model", F.size("embedding").alias("width"))


@query(
    "search_cache",
    """WITH l AS (SELECT * FROM events WHERE ts <= TIMESTAMP '2024-01-20' AND ts > TIMESTAMP '2024-01-20' - INTERVAL 168 HOURS
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, event_id, CASE WHEN event_id % 10 > 0 THEN json_extract(props, '$.k')::INT END AS k FROM l""",
)
def search_cache(spark, sf_dir):
    """The cached answer of each user, if fresh, decoded; malformed JSON is null."""
    as_of = F.lit("2024-01-20").cast("timestamp_ntz")
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz")).where(F.col("ts") <= as_of)
    body = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{oops "), "props")).otherwise(F.col("props"))
    last = tables.latest_per_key(tables.fresh(rows, "ts", as_of, 168), "user_id", F.col("ts").desc(), F.col("event_id").desc())
    return last.select("user_id", "event_id", F.from_json(body, "k int")["k"].alias("k"))


@query(
    "page_gate",
    """WITH p AS (SELECT *, CASE page_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN NULL WHEN 2 THEN 'Text/HTML; charset=utf-8' WHEN 3 THEN 'text/html' ELSE 'application/xhtml+xml' END AS ct FROM pages)
SELECT page_id, CASE WHEN page_id % 5 < 2 THEN 'not html (' || coalesce(ct, 'unknown') || ')' WHEN page_id % 7 = 0 THEN 'HTTP 404' END AS error,
CASE WHEN page_id % 5 < 2 THEN 0 ELSE least(length(html), 5000) END AS kept FROM p""",
)
def page_gate(spark, sf_dir):
    """What is no HTML is refused; what is too long is cut to the source's limit (here 5,000 characters)."""
    n = F.col("page_id") % 5
    kind = F.when(n == 0, "application/pdf").when(n == 2, "Text/HTML; charset=utf-8").when(n == 3, "text/html").when(n == 4, "application/xhtml+xml")
    html = F.coalesce(kind, F.lit("")).rlike(r"(?i)text/html|application/xhtml")
    refused = F.concat(F.lit("not html ("), F.coalesce(kind, F.lit("unknown")), F.lit(")"))
    error = F.when(~html, refused).when(F.col("page_id") % 7 == 0, "HTTP 404")
    kept = F.when(html, F.length(F.substring("html", 1, 5000))).otherwise(0)
    return pages_of(spark, sf_dir).select("page_id", error.alias("error"), kept.alias("kept"))


KNOWN = f"""
kn AS (
  SELECT item_id, text, list_sort(list_distinct(list_filter({tok('text')}, lambda x: list_contains(l, x)))) AS known,
         list_transform(regexp_extract_all(text, '["''`]([^"''`]{{2,40}})["''`]', 1), lambda x: lower(trim(x))) AS quoted,
         list_transform(list_filter(regexp_extract_all(text, '\\b([A-Za-z][A-Za-z0-9_.+#/\\-]{{2,30}})\\b', 1),
           lambda w: regexp_matches(w, '[0-9./\\-]|^[a-z]+[A-Z]')), lambda w: lower(w)) AS tech,
         list_filter(string_split_regex(lower(text), '[^a-z0-9+#._\\-]+'), lambda w: length(w) >= 4 AND w NOT IN {STOPPED}) AS rest
  FROM benchmark, (SELECT list(term) AS l FROM lexicon)),
kf AS (SELECT item_id, text, list_filter(list_concat(known, quoted, tech), lambda x: length(x) > 0) AS found, rest FROM kn),
ke AS (SELECT item_id, text, {first_distinct('p', 12)} AS e FROM (SELECT item_id, text, CASE WHEN len(found) > 0 THEN found ELSE rest END AS p FROM kf)),
kt AS (
  SELECT item_id, text, list_filter(flatten(list_transform(e, lambda x: [x, regexp_replace(lower(trim(x)), '\\s+', '-', 'g')])), lambda x: length(x) BETWEEN 2 AND 60) AS t FROM ke),
en AS (SELECT item_id, text, {first_distinct('t', 12)} AS entities FROM kt)"""


def question_entities(spark, sf_dir, names):
    """query_id, text, entities: known names, quotes and technical words, else content words; each with its canonical twin."""
    known = F.array_sort(F.array_intersect(F.array_distinct(tx.tokens(F.col("text"))), F.array(*[F.lit(x) for x in names])))
    found = tx.entities(F.col("text"), known=known)
    return benchmark_queries(spark, sf_dir).select("query_id", "text", tx.with_twins(found).alias("entities"))


@query("entities_known", f"WITH {GRAPH}, {KNOWN} SELECT item_id AS query_id, array_to_string(entities, ',') AS entities FROM en")
def entities_known(spark, sf_dir):
    names = graph.lexicon(document_index(spark, sf_dir))
    return question_entities(spark, sf_dir, names).select("query_id", F.array_join("entities", ",").alias("entities"))


@query(
    "question_variants",
    f"""WITH {GRAPH}, {KNOWN}, v AS (SELECT item_id, list_filter(list_concat([text], entities), lambda x: length(trim(x)) > 1) AS v FROM en)
SELECT item_id AS query_id, array_to_string({first_distinct('v', 100)}, '|') AS variants FROM v""",
)
def question_variants(spark, sf_dir):
    """What is asked of the index: the question itself and its entities."""
    names = graph.lexicon(document_index(spark, sf_dir))
    rows = question_entities(spark, sf_dir, names)
    return rows.select("query_id", F.array_join(variants(F.col("text"), F.col("entities")), "|").alias("variants"))


def variants(text, entities):
    return F.array_distinct(F.filter(F.concat(F.array(text), entities), lambda x: F.length(F.trim(x)) > 1))


SAFE = f"(contains(s, ' ') OR contains(s, '-') OR (s NOT IN ({', '.join(repr(x) for x in tx.PROSE_UNSAFE)}) AND (s IN ({', '.join(repr(x) for x in tx.PROSE_SAFE_SHORT)}) OR length(s) >= 4)))"


@query(
    "prose_lexicon",
    f"""WITH {GRAPH}, s AS (SELECT DISTINCT lower(p_name) AS s FROM part UNION SELECT unnest([{', '.join(repr(x) for x in (*tx.PROSE_UNSAFE, *tx.PROSE_SAFE_SHORT))}])
UNION SELECT term FROM lexicon) SELECT s AS surface FROM s WHERE {SAFE}""",
)
def prose_lexicon(spark, sf_dir):
    """Curated surfaces and known names in one lexicon, both without what is ambiguous in prose."""
    curated = table(spark, sf_dir, "part").select(F.lower("p_name").alias("surface"))
    fixed = spark.createDataFrame([(x,) for x in (*tx.PROSE_UNSAFE, *tx.PROSE_SAFE_SHORT)], "surface string")
    known = spark.createDataFrame([(x,) for x in graph.lexicon(document_index(spark, sf_dir))], "surface string")
    return curated.unionByName(fixed).unionByName(known).distinct().where(tx.prose_safe(F.col("surface")))


@query(
    "longest_surface",
    """WITH s AS (SELECT DISTINCT trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS s FROM part
UNION SELECT DISTINCT split_part(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' ', 1) FROM part),
t AS (SELECT DISTINCT p_name || ' ' || p_type AS text FROM part)
SELECT text, s AS surface FROM t JOIN s ON contains(' ' || regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || s || ' ')
QUALIFY row_number() OVER (PARTITION BY text ORDER BY length(s) DESC, s) = 1""",
)
def longest_surface(spark, sf_dir):
    """The longest surface that stands in a text, so that a name of two words wins over its first."""
    part = table(spark, sf_dir, "part")
    whole = part.select(F.trim(tx.padded(F.col("p_name"))).alias("name"))
    names = whole.unionByName(whole.select(F.substring_index("name", " ", 1).alias("name"))).distinct()
    texts = part.select(F.concat_ws(" ", "p_name", "p_type").alias("text")).distinct()
    met = corpus.ngram_hits(texts, "text", tx.padded(F.col("text")), names)
    return tables.first_wins(met, ["text"], F.length("name").desc(), F.col("name")).select("text", F.col("name").alias("surface"))


@query(
    "activation_order",
    f"""WITH {GRAPH} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(activation, 9) DESC, hop, id) AS place FROM s2""",
)
def activation_order(spark, sf_dir):
    """Activated terms by activation, then hop, then name."""
    ready = prepared(spark, sf_dir)
    state, _ = graph.spread_activation(seeds_of(spark, sf_dir, ready.names), ready.edges, 2)
    order = Window.partitionBy("query_id").orderBy(F.round("activation", 9).desc(), "hop", "id")
    return state.select("query_id", "id", F.row_number().over(order).alias("place"))


@query(
    "page_skips",
    f"""WITH learned AS (SELECT page_id AS doc_id, {PLAIN} AS text, {DOMAIN} AS source FROM pages),
{PAGE_GRAPH[: PAGE_GRAPH.index('pr AS (')].rstrip().rstrip(',')},
n AS (SELECT doc_id, count(*) AS n FROM lt GROUP BY doc_id)
SELECT page_id, CASE WHEN html IS NULL OR html = '' THEN 'empty' WHEN coalesce(n, 0) < 2 THEN 'only ' || coalesce(n, 0) || ' terms' END AS reason
FROM pages LEFT JOIN n ON doc_id = page_id""",
)
def page_skips(spark, sf_dir):
    """Why a page is not learned from: empty, or fewer than two terms of the lexicon in it; null where it is."""
    from ..functions import web

    pages = pages_of(spark, sf_dir).select(
        "page_id", web.text_of(F.col("html")).alias("text"), web.domain_of(F.col("url")).alias("domain")
    )
    index = corpus.Index.build(pages, "page_id", {"text": 1.0}, "domain")
    held = graph.held_terms(index, graph.lexicon(index)).select("page_id", F.size("held").alias("n"))
    n = F.coalesce("n", F.lit(0))
    reason = F.when(F.col("html").isNull() | (F.col("html") == ""), "empty").when(
        n < 2, F.concat(F.lit("only "), n.cast("string"), F.lit(" terms"))
    )
    return pages_of(spark, sf_dir).select("page_id", "html").join(held, "page_id", "left").select("page_id", reason.alias("reason"))
