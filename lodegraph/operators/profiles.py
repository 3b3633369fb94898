"""Effort profiles and context blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Effort, hops, most seeds, most modules, top k.
EFFORTS = (
    ("low", 1, 3, 5, 10),
    ("medium", 2, 4, 12, 20),
    ("high", 2, 6, 12, 20),
    ("xhigh", 3, 8, 16, 30),
    ("max", 4, 10, 20, 40),
)


def effort_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EFFORTS, "effort string, hops int, max_seeds int, max_modules int, top_k int")


def parse_effort(raw: Column) -> Column:
    """A known effort in lower case, else ``medium``."""
    low = F.lower(F.trim(raw))
    return F.when(low.isin(*[e[0] for e in EFFORTS]), low).otherwise("medium")


def context_block(rows: DataFrame, by: str, head: Column, body: Column, *order: str) -> DataFrame:
    """by, context: blocks of header and body in order, blank lines between (rows are already within a budget)."""
    block = F.concat(F.lit("## "), head, F.lit("\n"), body)
    listed = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], block.alias("block"))))
    return rows.groupBy(by).agg(F.array_join(F.transform(listed, lambda x: x["block"]), "\n\n").alias("context"))


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def accessible_shade(r: Column, g: Column, b: Column, back: Column, needed: float) -> Column:
    """The first of twenty steps towards black (on light grounds) or white that reads on ``back``; null if none does."""
    from ..functions.scores import contrast, luminance

    def first(x: Column) -> Column:
        def reads(step: Column) -> Column:
            mixed = F.struct(*[F.round(x[c] + (x["goal"] - x[c]) * step / F.lit(20.0)).alias(c) for c in "rgb"])
            lum = _let(mixed, lambda m: luminance(m["r"], m["g"], m["b"]))
            return _let(lum, lambda y: contrast(y, x["back"])) >= needed

        found = lambda so_far, step: F.when(so_far.isNotNull(), so_far).when(reads(step), step)
        return F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(None).cast("int"), found)

    def known(ground: Column) -> Column:
        goal = F.when(ground > 0.35, F.lit(0.0)).otherwise(F.lit(255.0))
        return _let(F.struct(r.alias("r"), g.alias("g"), b.alias("b"), ground.alias("back"), goal.alias("goal")), first)

    return _let(back, known)
