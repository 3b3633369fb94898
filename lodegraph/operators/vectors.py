"""Exact vector search: a stated query set against all rows, in blocks.

Up to ``BLOCK`` query vectors are sent to the tasks, which read the vectors
where they lie.  More are dealt to blocks and the vectors to chunks, and Spark
brings each block and chunk together, so neither the driver nor a task ever
holds more than one of each.  Tasks return what the question needs of a block
and chunk (the best, bins, one value per row), never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

#: Query vectors, and rows, that a task compares at once.
BLOCK, CHUNK = 2048, 20_000
#: Scores that a task holds at once: a chunk is compared in slices of so many.
CELLS = 1 << 20
#: Bins of scores between -1 and 1.
BINS = 1024


def cosine(a, b):
    """Cosine of two array columns over their common length; 0 where a norm is 0."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    add = lambda t, x: t + x
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), add)
    norm = [F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), add)) for v in (a, b)]
    return F.when((norm[0] > 0) & (norm[1] > 0), dot / (norm[0] * norm[1])).otherwise(0.0)


def _unit(rows: list) -> np.ndarray:
    matrix = np.array(rows, dtype=np.float64)
    if not len(matrix):
        return np.zeros((0, 0))
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


class Best:
    """The k best rows of each query so far, or all (k: None)."""

    schema = "query_id long, id long, score double"

    def __init__(self, ids: np.ndarray, k: int | None):
        self.ids, self.k, self.held = ids, k, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def add(self, own: np.ndarray, score: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = len(own)
        if self.k is not None and self.k < n:  # a slice's own best first
            edge = np.partition(score, n - self.k, axis=1)[:, n - self.k] - 1e-9
            query, at = np.nonzero(score >= edge[:, None])
            row, value = own[at], score[query, at]
        else:
            query, row, value = np.repeat(np.arange(len(self.ids)), n), np.tile(own, len(self.ids)), score.ravel()
        if self.k is None:
            yield _batch({"query_id": self.ids[query], "id": row, "score": value})
            return
        query, row, value = (np.concatenate(x) for x in zip(self.held, (query, row, value), strict=True))
        order = np.lexsort((row, -np.round(value, 9), query))
        query, row, value = query[order], row[order], value[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        self.held = tuple(x[place < self.k] for x in (query, row, value))

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.k is not None and len(self.held[0]):
            query, row, value = self.held
            yield _batch({"query_id": self.ids[query], "id": row, "score": value})


class Bins:
    """How many rows have which score, to one of ``BINS``, and the best score, per query."""

    schema = "query_id long, bin int, n long, top double"

    def __init__(self, ids: np.ndarray):
        self.ids, self.n, self.top = ids, np.zeros(len(ids) * BINS, np.int64), np.full(len(ids), -np.inf)

    def add(self, own: np.ndarray, score: np.ndarray) -> Iterator[pa.RecordBatch]:
        value = np.round(score, 9)
        at = (np.arange(len(self.ids))[:, None] * BINS + bin_of(value)).ravel()
        self.n += np.bincount(at, minlength=len(self.n))
        self.top = np.maximum(self.top, value.max(axis=1))
        return iter(())

    def end(self) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(self.n)
        yield _batch(
            {"query_id": self.ids[at // BINS], "bin": (at % BINS).astype(np.int32), "n": self.n[at], "top": self.top[at // BINS]}
        )


class Inside:
    """How many rows have which score, within each query's one bin that matters."""

    schema = "query_id long, score double, n long"

    def __init__(self, ids: np.ndarray, bins: np.ndarray):
        self.ids, self.bins, self.held = ids, bins, []

    def add(self, own: np.ndarray, score: np.ndarray) -> Iterator[pa.RecordBatch]:
        value = np.round(score, 9)
        query, row = np.nonzero(bin_of(value) == self.bins[:, None])
        pairs, n = np.unique(np.stack([query, value[query, row]], axis=1), axis=0, return_counts=True)
        if len(pairs):
            yield _batch({"query_id": self.ids[pairs[:, 0].astype(int)], "score": pairs[:, 1], "n": n})

    def end(self) -> Iterator[pa.RecordBatch]:
        return iter(())


class Nearest:
    """Each row's best score over all queries of the block."""

    schema = "id long, score double"

    def __init__(self, ids: np.ndarray):
        self.ids = ids

    def add(self, own: np.ndarray, score: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield _batch({"id": own, "score": score.max(axis=0)})

    def end(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def bin_of(score: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((score + 1) * (BINS / 2)), 0, BINS - 1).astype(np.int64)


def _searched(queries: DataFrame, vectors: DataFrame, schema: str, start: Callable) -> DataFrame:
    """What ``start(ids, extra)`` gathers of all rows of ``vectors`` (id, vec), per block of ``queries`` (query_id, vec, extra)."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec").isNotNull()).select("id", "vec")
    asked = queries.where(F.col("vec").isNotNull()).select("query_id", "vec", "extra")

    def gather(ids, unit, extra, batches):
        found = start(np.array(ids, dtype=np.int64), np.array(extra))
        step = max(1, CELLS // len(unit))
        for own, vecs in batches:
            for i in range(0, len(own), step):
                yield from found.add(own[i : i + step], unit @ _unit(vecs[i : i + step]).T)
        yield from found.end()

    few = asked.limit(BLOCK + 1).collect()
    if not few:
        return spark.createDataFrame([], schema)
    if len(few) <= BLOCK:
        shared = spark.sparkContext.broadcast(
            ([r["query_id"] for r in few], _unit([r["vec"] for r in few]), [r["extra"] for r in few])
        )

        def run(batches):
            slices = (b.slice(i, CHUNK) for b in batches for i in range(0, b.num_rows, CHUNK))
            yield from gather(*shared.value, ((b.column("id").to_numpy(), b.column("vec").to_pylist()) for b in slices))

        return rows.mapInArrow(run, schema)

    blocks, chunks_ = -(-asked.count() // BLOCK), max(1, -(-rows.count() // CHUNK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = asked.select("query_id", F.col("vec").alias("asked"), "extra", dealt("query_id", blocks).alias("block"), every(chunks_).alias("chunk"))
    right = rows.select("id", F.col("vec").alias("held"), dealt("id", chunks_).alias("to_chunk"), every(blocks).alias("to_block"))

    def meet(one: pa.Table, other: pa.Table) -> pa.Table:
        if not one.num_rows or not other.num_rows:
            return empty
        unit = _unit(one.column("asked").to_pylist())
        pair = [(other.column("id").to_numpy(), other.column("held").to_pylist())]
        out = list(gather(one.column("query_id").to_pylist(), unit, one.column("extra").to_pylist(), pair))
        return pa.Table.from_batches(out) if out else empty

    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    empty = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in schema.split(", "))]).empty_table()
    return left.groupBy("block", "chunk").cogroup(right.groupBy("to_block", "to_chunk")).applyInArrow(meet, schema)


def similarities(queries: DataFrame, vectors: DataFrame, k: int | None = None) -> DataFrame:
    """query_id, id, score for ``queries`` (query_id, vec) against ``vectors`` (id, vec).

    ``k``: each task returns only its k best per query (ties in the ninth decimal
    by id); a global top-k follows outside.  Null vectors match nothing.
    """
    asked = queries.withColumn("extra", F.lit(0))
    return _searched(asked, vectors, Best.schema, lambda ids, _: Best(ids, k))


def best_over_queries(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """id, score: each row's best score over all queries."""
    found = _searched(queries.withColumn("extra", F.lit(0)), vectors, Nearest.schema, lambda ids, _: Nearest(ids))
    return found.groupBy("id").agg(F.max("score").alias("score"))


def field_statistics(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """query_id, top, middle, prominence: the middle is the descending list's element floor(n / 2).

    Tasks count scores (to nine decimals) in bins; only the scores of the bin that
    holds the middle are looked at one by one, in a second pass.
    """
    found = _searched(queries.withColumn("extra", F.lit(0)), vectors, Bins.schema, lambda ids, _: Bins(ids))
    counts = found.groupBy("query_id", "bin").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
    down = Window.partitionBy("query_id").orderBy(F.col("bin").desc())
    own = Window.partitionBy("query_id")
    counts = counts.withColumn("upto", F.sum("n").over(down)).withColumn("middle", F.floor(F.sum("n").over(own) / 2))
    counts = counts.withColumn("top", F.max("top").over(own))
    held = counts.where((F.col("upto") > F.col("middle")) & (F.col("upto") - F.col("n") <= F.col("middle"))).select(
        "query_id", "bin", "top", (F.col("middle") - F.col("upto") + F.col("n")).alias("place")
    )
    held = written(held, "middles")  # read several times below, each of which would bin all pairs anew
    asked = queries.join(held, "query_id").withColumn("extra", F.col("bin"))
    inside = _searched(asked, vectors, Inside.schema, lambda ids, bins: Inside(ids, bins))
    inside = inside.groupBy("query_id", "score").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("query_id").orderBy(F.col("score").desc()))
    middle = inside.withColumn("upto", upto).join(held, "query_id").where(
        (F.col("upto") > F.col("place")) & (F.col("upto") - F.col("n") <= F.col("place"))
    )
    return middle.select("query_id", "top", F.col("score").alias("middle"), (F.col("top") - F.col("score")).alias("prominence"))
