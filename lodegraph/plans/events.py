"""Queries of snapshots, caches, limits, meters and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import tables
from .registry import query, table

AS_OF = "2024-01-20 00:00:00"


def events_of(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query(
    "upsert_merge",
    """WITH delta AS (
  SELECT c_custkey + 700 AS k, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'new ' || c_name END AS name,
         CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_mktsegment END AS seg, (c_custkey % 5 = 0)::INT AS seeded FROM customer)
SELECT coalesce(c_custkey, k) AS c_custkey, coalesce(nullif(trim(name), ''), c_name) AS c_name,
       coalesce(nullif(trim(seg), ''), c_mktsegment) AS c_mktsegment,
       greatest((coalesce(c_custkey, 1) % 7 = 0)::INT * (c_custkey IS NOT NULL)::INT, coalesce(seeded, 0)) AS seeded
FROM customer FULL JOIN delta ON k = c_custkey""",
)
def upsert_merge(spark, sf_dir):
    """Customers merged with a shifted delta whose blanks erase nothing."""
    base = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_mktsegment", (F.col("c_custkey") % 7 == 0).cast("int").alias("seeded")
    )
    delta = table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") + 700).alias("c_custkey"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("new "), "c_name")).alias("c_name"),
        F.when(F.col("c_custkey") % 2 != 0, F.col("c_mktsegment")).alias("c_mktsegment"),
        (F.col("c_custkey") % 5 == 0).cast("int").alias("seeded"),
    )
    return tables.upsert(base, delta, "c_custkey", ["c_name", "c_mktsegment"], ["seeded"])


@query(
    "latest_per_key",
    """SELECT user_id, event_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def latest_per_key(spark, sf_dir):
    out = tables.latest_per_key(events_of(spark, sf_dir), "user_id", F.col("ts").desc(), F.col("event_id").desc())
    return out.select("user_id", "event_id", "event_type", "value")


@query(
    "ttl_cache_hits",
    f"""WITH l AS (SELECT * FROM events WHERE ts <= TIMESTAMP '{AS_OF}'
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, event_id FROM l WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 168 HOURS""",
)
def ttl_cache_hits(spark, sf_dir):
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    rows = events_of(spark, sf_dir).where(F.col("ts") <= as_of)
    latest = tables.latest_per_key(rows, "user_id", F.col("ts").desc(), F.col("event_id").desc())
    return tables.fresh(latest, "ts", as_of, 168).select("user_id", "event_id")


@query(
    "evidence_dedup",
    """SELECT user_id, event_type, event_id, substr(props, 1, 400) AS snippet FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""",
)
def evidence_dedup(spark, sf_dir):
    """Insert-or-ignore: the first row per key stays, its snippet is cut to 400 characters."""
    first = tables.first_wins(events_of(spark, sf_dir), ["user_id", "event_type"], F.col("ts"), F.col("event_id"))
    return first.select("user_id", "event_type", "event_id", F.substring("props", 1, 400).alias("snippet"))


def requests_of(spark, sf_dir):
    """Requests of users: purchases cost five, everything else one."""
    return events_of(spark, sf_dir).select(
        F.col("user_id").alias("key"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"),
        F.col("event_id").alias("id"),
        F.when(F.col("event_type") == "purchase", 5).otherwise(1).alias("cost"),
    )


@query(
    "token_bucket",
    """WITH RECURSIVE r AS (
  SELECT user_id AS key, epoch_us(ts) // 1000 AS at_ms, event_id AS id, CASE WHEN event_type = 'purchase' THEN 5 ELSE 1 END AS cost,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (
  SELECT key, at_ms, id, cost, n, 6.0::DOUBLE AS held FROM r WHERE n = 1
  UNION ALL
  SELECT r.key, r.at_ms, r.id, r.cost, r.n,
         least(6.0::DOUBLE, f.held - CASE WHEN f.held >= f.cost THEN f.cost ELSE 0 END + (r.at_ms - f.at_ms) * (0.002::DOUBLE / 60000.0))
  FROM f JOIN r ON r.key = f.key AND r.n = f.n + 1)
SELECT key, id, held >= cost AS allowed FROM f""",
)
def token_bucket(spark, sf_dir):
    return tables.token_bucket(requests_of(spark, sf_dir), 6.0, 0.002).select("key", "id", "allowed")


@query(
    "min_interval_pacing",
    """WITH r AS (
  SELECT event_type AS key, epoch_us(ts) // 1000000 AS "at", event_id AS id,
         row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000000, event_id) - 1 AS i FROM events)
SELECT key, id, "at", (max("at" - 900 * i) OVER (PARTITION BY key ORDER BY "at", id) + 900 * i)::BIGINT AS release FROM r""",
)
def min_interval_pacing(spark, sf_dir):
    at = (F.unix_millis(F.col("ts").cast("timestamp")) / 1000).cast("long")
    keyed = events_of(spark, sf_dir).select(F.col("event_type").alias("key"), at.alias("at"), F.col("event_id").alias("id"))
    return tables.paced(keyed, 900)


@query(
    "concurrency_peak",
    """WITH s AS (SELECT event_type, epoch_us(ts) // 1000000 AS b, epoch_us(ts) // 1000000 + 600 + floor(value)::BIGINT AS e FROM events),
c AS (SELECT event_type, "at", sum(d) AS d FROM (SELECT event_type, b AS "at", 1 AS d FROM s UNION ALL SELECT event_type, e, -1 FROM s) GROUP BY ALL)
SELECT event_type, max(l)::BIGINT AS peak FROM (SELECT event_type, sum(d) OVER (PARTITION BY event_type ORDER BY "at") AS l FROM c) GROUP BY event_type""",
)
def concurrency_peak(spark, sf_dir):
    at = (F.unix_millis(F.col("ts").cast("timestamp")) / 1000).cast("long")
    spans = events_of(spark, sf_dir).select(
        "event_type", at.alias("begin"), (at + 600 + F.floor("value").cast("long")).alias("end")
    )
    return tables.concurrency_peak(spans, "event_type")


STEPS = "SELECT user_id, event_id, ts, (event_type <> 'error')::INT AS ok, event_type, value FROM events"


@query(
    "stall_detection",
    f"""SELECT user_id, event_id, count(*) OVER w = 4 AND sum(ok) OVER w = 0 AS stalled FROM ({STEPS})
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""",
)
def stall_detection(spark, sf_dir):
    steps = events_of(spark, sf_dir).withColumn("ok", (F.col("event_type") != "error").cast("int"))
    return tables.stalled(steps, "user_id", "ts", "event_id").select("user_id", "event_id", "stalled")


@query(
    "repeat_calls",
    """SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY ts, event_id) > 1 AS repeated FROM events""",
)
def repeat_calls(spark, sf_dir):
    order = Window.partitionBy("user_id", "event_type", "props").orderBy("ts", "event_id")
    return events_of(spark, sf_dir).select("event_id", (F.row_number().over(order) > 1).alias("repeated"))


@query(
    "usage_ledger",
    """SELECT user_id, event_type, count(*) AS calls, sum((props->>'k')::BIGINT)::BIGINT AS tokens,
round(max(value), 6) AS most, round(avg(value), 6) AS mean FROM events GROUP BY ALL""",
)
def usage_ledger(spark, sf_dir):
    tokens = F.get_json_object("props", "$.k").cast("long")
    return events_of(spark, sf_dir).groupBy("user_id", "event_type").agg(
        F.count("*").alias("calls"),
        F.sum(tokens).alias("tokens"),
        F.round(F.max("value"), 6).alias("most"),
        F.round(F.avg("value"), 6).alias("mean"),
    )


@query(
    "best_so_far",
    """WITH a AS (
  SELECT user_id, event_id, ts, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events),
b AS (SELECT *, best_before IS NULL OR value > best_before AS accepted FROM a)
SELECT user_id, event_id, best_before, accepted,
       place - max(CASE WHEN accepted THEN place END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS since FROM b""",
)
def best_so_far(spark, sf_dir):
    out = tables.best_so_far(events_of(spark, sf_dir), "user_id", "value", "ts", "event_id")
    return out.select("user_id", "event_id", "best_before", "accepted", "since")


@query(
    "counter_delta",
    """SELECT user_id, event_id, CASE WHEN d < 0 THEN 0 ELSE d END AS delta
FROM (SELECT user_id, event_id, (props->>'k')::BIGINT - lag((props->>'k')::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events)""",
)
def counter_delta(spark, sf_dir):
    rows = events_of(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return tables.counter_delta(rows, "user_id", "k", "ts", "event_id").select("user_id", "event_id", "delta")


@query(
    "transcript_trim",
    """WITH c AS (
  SELECT conv_id, turn, sum(ceil(length(text) / 3.6::DOUBLE)) OVER w AS used, row_number() OVER w AS back
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC))
SELECT conv_id, turn, used::BIGINT AS used FROM c WHERE used <= 100 AND back <= 24""",
)
def transcript_trim(spark, sf_dir):
    """The newest turns within 24 entries and 100 tokens."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.sum(tx.session_tokens(F.col("text"))).over(order).alias("used"),
        F.row_number().over(order).alias("back"),
    )
    return rows.where("used <= 100 AND back <= 24").select("conv_id", "turn", "used")


@query(
    "last_turns_concat",
    """SELECT conv_id, turn, string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS recent FROM conversations""",
)
def last_turns_concat(spark, sf_dir):
    frame = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-5, 0)
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.array_join(F.collect_list("text").over(frame), " ").alias("recent")
    )


@query(
    "last_user_turn",
    "SELECT conv_id, arg_max(text, turn) AS query, max(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id",
)
def last_user_turn(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    return rows.groupBy("conv_id").agg(F.max_by("text", "turn").alias("query"), F.max("turn").alias("turn"))


@query(
    "event_windows",
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""",
)
def event_windows(spark, sf_dir):
    """Extra: hourly tumbling windows."""
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    return events_of(spark, sf_dir).groupBy(hour.alias("start"), "event_type").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


@query(
    "event_rollup",
    """SELECT event_type, user_id % 10 AS shard, count(*) AS n FROM events GROUP BY ROLLUP (event_type, user_id % 10)""",
)
def event_rollup(spark, sf_dir):
    """Extra: rollup."""
    rows = events_of(spark, sf_dir).select("event_type", (F.col("user_id") % 10).alias("shard"))
    return rows.rollup("event_type", "shard").agg(F.count("*").alias("n"))
