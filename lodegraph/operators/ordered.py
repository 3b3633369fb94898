"""Running values over ordered rows of few, large groups.

A window over a group puts all its rows into one task.  Here the order is cut
into slices of bounded width; values are run within each slice, the slices'
totals are run over the slices (a short table), and both are put together.  The
results are those of the plain window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carried(rows: DataFrame, by: list[str], piece: Column, total: Column, combine: Callable[[Column], Column]) -> DataFrame:
    """``rows`` with ``_piece`` and ``_carry``: ``total`` (an aggregate per slice) combined over the slices before."""
    cut = rows.withColumn("_piece", piece)
    totals = cut.groupBy(*by, "_piece").agg(total.alias("_total"))
    before = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_piece").alias("_at"), combine(F.col("_total")).over(before).alias("_carry"))
    same = cut["_piece"] == totals["_at"]
    for i, c in enumerate(by):
        same = same & cut[c].eqNullSafe(totals[f"_by{i}"])
    return cut.join(totals, same).drop("_at", *[f"_by{i}" for i in range(len(by))])


def numbered(rows: DataFrame, by: list[str], piece: Column, *order: Column | str) -> DataFrame:
    """Adds ``place``, the row's number in its group by (``piece``, ``order``), from 1; pieces follow the order."""
    out = carried(rows, by, piece, F.count("*"), F.sum)
    within = F.row_number().over(Window.partitionBy(*by, "_piece").orderBy(*order))
    return out.withColumn("place", F.coalesce("_carry", F.lit(0)) + within).drop("_piece", "_carry")
