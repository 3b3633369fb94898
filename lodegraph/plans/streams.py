"""Streaming queries: the batch operators' twins, run over everything there is."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import web
from ..operators import corpus, graph
from ..sources.tables import scratch
from ..streaming import state
from .registry import ORACLES, query, table, tok
from .texts import DOMAIN, PLAIN


def event_stream(spark, sf_dir):
    path = f"{sf_dir}/events.parquet*"  # a glob: the table may be one file or a folder
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(path)


PARTS = 4


def event_parts(spark, sf_dir, name):
    """A stream of events in ``PARTS`` micro-batches or more, in the order of time."""
    rows = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    bounds = rows.agg(F.min(F.unix_millis("at")).alias("low"), F.max(F.unix_millis("at")).alias("high")).first()
    width = ((bounds["high"] or 0) - (bounds["low"] or 0)) // PARTS + 1
    part = F.floor((F.unix_millis("at") - F.lit(bounds["low"] or 0)) / F.lit(width)).cast("int")
    folder = state.in_parts(rows, part, PARTS, f"{scratch(spark, name)}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@query("stream_token_bucket", ORACLES["token_bucket"])
def stream_token_bucket(spark, sf_dir):
    """The batch query's twin over four micro-batches; levels live in state between them."""
    rows = event_parts(spark, sf_dir, "bucket").select(
        F.col("user_id").alias("key"),
        F.unix_millis("at").alias("at_ms"),
        F.col("event_id").alias("id"),
        F.when(F.col("event_type") == "purchase", 5).otherwise(1).alias("cost"),
    )
    out = state.run_once(state.token_bucket(rows, 6.0, 0.002), scratch(spark, "bucket"))
    return out.select("key", "id", "allowed")


TTL_HOURS = 6


@query(
    "stream_ttl_cache",
    f"""WITH RECURSIVE e AS (
  SELECT user_id AS key, event_id AS id, epoch_ms(ts) AS "at", row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS i FROM events),
f AS (
  SELECT key, id, i, "at" AS stored, false AS hit FROM e WHERE i = 1
  UNION ALL
  SELECT e.key, e.id, e.i, CASE WHEN e."at" < stored + {TTL_HOURS} * 3600000 THEN stored ELSE e."at" END, e."at" < stored + {TTL_HOURS} * 3600000
  FROM f JOIN e ON e.key = f.key AND e.i = f.i + 1)
SELECT key, id, hit FROM f""",
)
def stream_ttl_cache(spark, sf_dir):
    """Which requests of a user a cached answer serves; answers run out by the stream's own time."""
    rows = event_parts(spark, sf_dir, "cache").select(
        F.col("user_id").alias("key"), "at", F.unix_millis("at").alias("at_ms"), F.col("event_id").alias("id")
    )
    return state.run_once(state.cache(rows, TTL_HOURS * 3_600_000, "1 minute"), scratch(spark, "cache"))


@query(
    "stream_windows",
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""",
)
def stream_windows(spark, sf_dir):
    """Extra: hourly windows in complete mode, one result at the end."""
    rows = event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    name = f"windows_{uuid.uuid4().hex}"
    folder = scratch(spark, "windows")

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/rows")

    stream = state.windowed(rows, "ts", "1 hour", "30 days", "event_type")
    (
        stream.writeStream.queryName(name)
        .outputMode("complete")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(keep)
        .start()
        .awaitTermination()
    )
    out = spark.read.schema(stream.schema).parquet(f"{folder}/rows")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


TERMS_PER_BATCH, BATCHES = 30, 3


@query(
    "stream_learn",
    f"""WITH once AS (SELECT * FROM pages QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1),
learned AS (
  SELECT page_id AS doc_id, {PLAIN} AS text, {DOMAIN} AS source,
         {BATCHES} * (page_id - (SELECT min(page_id) FROM pages)) // ((SELECT max(page_id) - min(page_id) + 1 FROM pages)) AS batch FROM once),
dt AS (SELECT DISTINCT doc_id, source, batch, unnest({tok('text')}) AS term FROM learned),
size AS (SELECT batch, count(*) AS n FROM learned GROUP BY batch),
df AS (SELECT batch, term, count(*) AS df FROM dt GROUP BY ALL),
lexicon AS (
  SELECT df.batch, term FROM df JOIN size ON size.batch = df.batch WHERE length(term) >= 4 AND df >= 0.02 * n AND df <= 0.12 * n
  QUALIFY row_number() OVER (PARTITION BY df.batch ORDER BY df DESC, term) <= {TERMS_PER_BATCH}),
known AS (SELECT DISTINCT s.batch, l.term FROM size s JOIN lexicon l ON l.batch <= s.batch),
lt AS (SELECT doc_id, source, d.term FROM dt d JOIN known k ON k.batch = d.batch AND k.term = d.term)
SELECT x.term AS a, y.term AS b, count(*) AS n_obs, count(DISTINCT x.source) AS n_domains
FROM lt x JOIN lt y ON x.doc_id = y.doc_id AND x.term < y.term GROUP BY ALL""",
)
def stream_learn(spark, sf_dir):
    """Pages learned as a stream of three batches: later pages are read with the terms of earlier ones; evidence is kept by batch."""
    folder = scratch(spark, "learned")
    pages = table(spark, sf_dir, "pages")
    first = pages.groupBy("url").agg(F.min("page_id").alias("page_id"))
    rows = pages.join(first, ["url", "page_id"], "left_semi").select("page_id", "url", "html")
    bounds = pages.agg(F.min("page_id").alias("low"), F.max("page_id").alias("high")).first()
    low, width = bounds["low"] or 0, (bounds["high"] or 0) - (bounds["low"] or 0) + 1
    part = F.floor(F.lit(BATCHES) * (F.col("page_id") - low) / F.lit(width)).cast("int")
    state.in_parts(rows, part, BATCHES, f"{folder}/in")
    stream = spark.readStream.schema("page_id long, url string, html string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")

    def index(batch):
        cut = batch.select("page_id", web.text_of(F.col("html")).alias("text"), web.domain_of(F.col("url")).alias("domain"))
        return corpus.Index.build(cut, "page_id", {"text": 1.0}, "domain")

    def observe(batch, terms):
        return graph.pairs(graph.held_of_table(index(batch), terms), F.col("held"), "page_id", "domain")

    writer = state.learn_stream(stream, folder, lambda batch: graph.lexicon_table(index(batch), size=TERMS_PER_BATCH), observe)
    writer.trigger(availableNow=True).start().awaitTermination()
    seen = spark.read.parquet(f"{folder}/evidence").groupBy("a", "b", "domain").agg(F.count("*").alias("n"))
    return seen.groupBy("a", "b").agg(F.sum("n").alias("n_obs"), F.count("domain").alias("n_domains"))
