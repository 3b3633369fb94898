"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is a few aggregates and joins; nothing is collected but two numbers
that tell whether a round changed anything.  Rounds grow with the logarithm of
the table, and each is written to the shared folder, which keeps lineage short.
A round's tables have about as many rows as the one before, so they are written
to a number of files that goes with its rows: many tasks that hold next to
nothing each would leave thousands of small files per round.

The task that writes a file first contracts its edges to stars, so a round leaves
at most one edge per node and file, and paths within a file go at once.  This
spares most rounds, and with them the driver: Spark keeps a thread for a minute
for each exchange it submits.  A table of one file is finished by that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Rows of a file, about.
FILE_ROWS = 100_000


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that is not the smallest of its component among these edges, and the smallest."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    least = np.arange(len(nodes))
    while (x != y).any():
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (least[least] != least).any():
            least = least[least]
        x, y = least[x], least[y]
    moved = least != np.arange(len(nodes))
    return nodes[moved], nodes[least[moved]]


def contracted(edges: DataFrame, files: int) -> DataFrame:
    """The components of ``edges`` (a > b) in at most ``files`` slices, each as stars: (node, the slice's smallest)."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            table = pa.Table.from_batches(held)
            columns = _stars(*(table[c].to_numpy() for c in ("a", "b")))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["a", "b"])

    return edges.coalesce(files).mapInArrow(contract, "a long, b long")


def _seal(edges: DataFrame):
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """node, component from ``edges`` (a, b: long): every node that is not its component's smallest, with the smallest."""
    now = materialise(_tidy(edges), "edges")
    seal = _seal(now)
    files = 1 + seal[0] // FILE_ROWS
    now = materialise(contracted(now, files), "edges")
    while files > 1:
        files = 1 + 2 * seal[0] // FILE_ROWS
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that the join is apart from the aggregate and a hub's rows can be dealt to tasks
        least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "large-star", files)
        large = (
            both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        large = materialise(large.distinct(), "large", files)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = contracted(_tidy(moved.unionByName(least.select("a", F.col("m").alias("b")))), files)
        now = materialise(stars.distinct(), "edges", files)
        before, seal = seal, _seal(now)
        if before == seal:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
