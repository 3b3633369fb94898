"""Structured Streaming twins of the keyed, stateful operators."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started inside keep their state in a store that knows time to live; the session's own choice comes back after."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _in_order(rows: Iterator[pd.DataFrame], *columns: str) -> zip:
    """A key's rows of one micro-batch by time and id; only the named columns are held, and the source bounds a micro-batch."""
    parts = [[x[c].to_numpy() for c in columns] for x in rows]
    narrow = parts[0] if len(parts) == 1 else [np.concatenate(x) for x in zip(*parts)]
    order = np.lexsort((narrow[1], narrow[0]))  # arrays: keys are many, a table for each costs more than its rows
    return zip(*[x[order].tolist() for x in narrow])


class Bucket(StatefulProcessor):
    """A token bucket per key: its level and the time of its last request, forgotten after ``idle_ms`` without one."""

    def __init__(self, capacity: float, per_minute: float, idle_ms: int | None):
        self.capacity, self.rate, self.idle_ms = capacity, per_minute / 60000.0, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.level = handle.getValueState("level", "held double, last long", self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.level.get()  # null at first
        left, last = held if held is not None else (self.capacity, None)
        out = []
        for at, number, cost in _in_order(rows, "at_ms", "id", "cost"):
            left, last = min(self.capacity, left + (at - (at if last is None else last)) * self.rate), at
            fine = left >= cost
            out.append((key[0], number, fine, 0 if fine else max(1, math.ceil((cost - left) / self.rate / 1000.0))))
            left -= cost if fine else 0
        self.level.update((float(left), int(last)))
        yield pd.DataFrame(out, columns=["key", "id", "allowed", "retry_after"])

    def close(self) -> None:
        pass


def token_bucket(requests: DataFrame, capacity: float, per_minute: float, idle_ms: int | None = None) -> DataFrame:
    """key, id, allowed, retry_after for a stream of (key, at_ms, id, cost); start it within ``keyed_state``.

    Micro-batches must come in the order of time, as files of a log do.  With
    ``idle_ms`` a bucket is forgotten that long (of the cluster's time) after its last
    request; from ``capacity / per_minute`` minutes on, forgetting changes nothing.  (A stream
    that runs once over what there is must not set it: Spark would go on for as long as
    there is time to live.)
    """
    kind = dict(requests.dtypes)
    return requests.groupBy("key").transformWithStateInPandas(
        Bucket(capacity, per_minute, idle_ms),
        f"key {kind['key']}, id {kind['id']}, allowed boolean, retry_after long",
        "Append",
        "ProcessingTime" if idle_ms else "None",
    )


class Cache(StatefulProcessor):
    """What a key's last answer is good for: requests within ``ttl_ms`` of it are hits, later ones make a new answer.

    A timer in the stream's own time removes an answer that has run out, so state holds live answers only.
    """

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stored = handle.getValueState("stored", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = (self.stored.get() or (None,))[0]
        before, out = kept, []
        for at, number in _in_order(rows, "at_ms", "id"):
            hit = kept is not None and at < kept + self.ttl_ms
            kept = kept if hit else at
            out.append((key[0], number, hit))
        if kept != before:
            if before is not None:
                self.handle.deleteTimer(int(before + self.ttl_ms))
            self.stored.update((int(kept),))
            self.handle.registerTimer(int(kept + self.ttl_ms))
        yield pd.DataFrame(out, columns=["key", "id", "hit"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.stored.clear()
        yield pd.DataFrame({"key": [], "id": [], "hit": []})

    def close(self) -> None:
        pass


def cache(requests: DataFrame, ttl_ms: int, late: str) -> DataFrame:
    """key, id, hit for a stream of (key, at: timestamp, at_ms, id); start it within ``keyed_state``.

    An answer is removed once the watermark, ``late`` behind the newest request, has passed its end.
    """
    kind = dict(requests.dtypes)
    marked = requests.withWatermark("at", late)
    return marked.groupBy("key").transformWithStateInPandas(
        Cache(ttl_ms), f"key {kind['key']}, id {kind['id']}, hit boolean", "Append", "EventTime"
    )


def windowed(events: DataFrame, at: str, width: str, late: str, *by: str) -> DataFrame:
    """start, by, n, total: tumbling windows over event time; rows later than ``late`` are dropped."""
    marked = events.withWatermark(at, late)
    return (
        marked.groupBy(F.window(at, width).alias("w"), *by)
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), *by, "n", "total")
    )


def sessions(events: DataFrame, at: str, gap: str, late: str, by: str) -> DataFrame:
    """start, end, by, n: sessions that end after ``gap`` without an event."""
    marked = events.withWatermark(at, late)
    return (
        marked.groupBy(F.session_window(at, gap).alias("w"), by)
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")
    )


def in_parts(rows: DataFrame, part: Column, parts: int, folder: str) -> str:
    """``rows`` written part by part (0 to ``parts`` - 1), one after the other: a folder that a stream reads in this order.

    All tasks look for a part's rows, and one writes them.
    """
    marked = rows.withColumn("_part", part)
    for i in range(parts):
        marked.where(F.col("_part") == i).drop("_part").repartition(1).write.mode("append").parquet(folder)
    return folder


def run_once(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Everything there is, through the stream, into Parquet at ``path``; read back as a table."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint")
    with keyed_state(stream.sparkSession):
        writer.outputMode(mode).trigger(availableNow=True).start(f"{path}/rows").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def learn_stream(pages: DataFrame, path: str, lexicon: Callable[[DataFrame], DataFrame], observe: Callable[[DataFrame, DataFrame], DataFrame]):
    """Writer of a stream of pages that only ever adds: every batch looks at its own new pages.

    A page is learned once, by its url.  ``lexicon(batch)`` gives the terms (term) of a
    batch; they join those of the batches before in a table, so that later pages
    reinforce what earlier ones brought.  ``observe(pages, terms)`` turns the new pages
    into rows of evidence, kept by batch; a batch that is run again replaces its own.
    """

    def before(folder: str, number: int) -> str:
        return f"{path}/{folder}/batch={number}"

    def absorb(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["url"])
        if number:
            old = spark.read.schema("url string, batch int").parquet(f"{path}/urls").where(F.col("batch") < number)
            fresh = fresh.join(old.select("url"), "url", "left_anti")
        fresh.write.mode("overwrite").parquet(before("pages", number))
        kept = spark.read.schema(batch.schema).parquet(before("pages", number))
        kept.select("url").write.mode("overwrite").parquet(before("urls", number))
        lexicon(kept).select("term").write.mode("overwrite").parquet(before("terms", number))
        known = spark.read.schema("term string, batch int").parquet(f"{path}/terms").where(F.col("batch") <= number)
        observe(kept, known.select("term").distinct()).write.mode("overwrite").parquet(before("evidence", number))

    return pages.writeStream.foreachBatch(absorb).option("checkpointLocation", f"{path}/checkpoint")
