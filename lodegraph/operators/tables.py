"""Snapshot tables: upserts, caches, limits, meters over event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered


def latest_per_key(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def upsert(current: DataFrame, delta: DataFrame, key: str, texts: list[str], sticky: list[str] = []) -> DataFrame:
    """A new snapshot: delta wins where it says something, blanks never erase, sticky flags never fall."""
    new = delta.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in [*texts, *sticky]])
    joined = current.join(new, current[key] == new["_key"], "full")
    blank = lambda c: F.when(F.trim(c.cast("string")) != "", c)
    return joined.select(
        F.coalesce(key, "_key").alias(key),
        *[F.coalesce(blank(F.col(f"_{c}")), F.col(c)).alias(c) for c in texts],
        *[F.greatest(F.coalesce(c, F.lit(0)), F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sticky],
    )


def fresh(rows: DataFrame, at: str, as_of: Column, hours: int) -> DataFrame:
    """Cache rows younger than ``hours`` at ``as_of`` (strictly)."""
    return rows.where(F.col(at) > as_of - F.make_dt_interval(F.lit(0), F.lit(hours)))


def first_wins(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def token_bucket(requests: DataFrame, capacity: float, per_minute: float) -> DataFrame:
    """Adds allowed, retry_after (s) to ``requests`` (key, at_ms, id, cost): one bucket per key.

    Refills are continuous; a denied request keeps what was refilled.  The fold
    is ordered per key and streams over the key's sorted rows with one number of
    state, so the rows of a hot key never have to fit in memory at once.
    """
    rate = per_minute / 60000.0
    rows = requests.select("key", "at_ms", "id", "cost")
    schema = ", ".join(f"{c} {kind}" for c, kind in rows.dtypes) + ", allowed boolean, retry_after long"
    ordered = rows.repartition("key").sortWithinPartitions("key", "at_ms", "id")

    def run(batches):
        key, left, last = object(), 0.0, 0
        for pdf in batches:
            allowed, wait = [], []
            for k, at, cost in zip(pdf["key"], pdf["at_ms"], pdf["cost"], strict=True):
                if k != key:
                    key, left, last = k, capacity, at
                left, last = min(capacity, left + (at - last) * rate), at
                fine = left >= cost
                allowed.append(fine)
                wait.append(0 if fine else max(1, -int(-((cost - left) / rate / 1000.0) // 1)))
                left -= cost if fine else 0
            yield pdf.assign(allowed=allowed, retry_after=wait)

    return ordered.mapInPandas(run, schema)


def paced(requests: DataFrame, gap: int, width: int = 86_400) -> DataFrame:
    """Adds release: the n-th request of a key goes out ``gap`` after the one before, or on arrival.

    The recursion has a closed form: gap * i + running maximum of (arrival - gap * i).
    Keys may be few and hot, so both run within slices of ``width`` and over the slices.
    """
    piece = F.floor(F.col("at") / F.lit(width))
    behind = F.col("at") - F.lit(gap) * F.col("_i")
    rows = ordered.numbered(requests, ["key"], piece, "at", "id").withColumn("_i", F.col("place") - 1).drop("place")
    out = ordered.carried(rows, ["key"], piece, F.max(behind), F.max)
    own = F.max(behind).over(Window.partitionBy("key", "_piece").orderBy("at", "id"))
    return out.withColumn("_own", own).withColumn(
        "release", F.greatest("_own", F.coalesce("_carry", "_own")) + F.lit(gap) * F.col("_i")
    ).drop("_i", "_piece", "_carry", "_own")


def concurrency_peak(spans: DataFrame, by: str, width: int = 86_400) -> DataFrame:
    """by, peak: the most spans [begin, end) open at once; levels run within slices of ``width`` and over the slices."""
    change = F.explode(F.array(F.struct(F.col("begin").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d"))))
    steps = spans.select(by, change.alias("c")).groupBy(by, F.col("c.at").alias("at")).agg(F.sum("c.d").alias("d"))
    out = ordered.carried(steps, [by], F.floor(F.col("at") / F.lit(width)), F.sum("d"), F.sum)
    level = F.sum("d").over(Window.partitionBy(by, "_piece").orderBy("at")) + F.coalesce("_carry", F.lit(0))
    return out.withColumn("level", level).groupBy(by).agg(F.max("level").alias("peak"))


def stalled(steps: DataFrame, by: str, *order: str, last: int = 4) -> DataFrame:
    """Adds stalled: the last ``last`` steps all failed (``ok`` 0/1)."""
    frame = Window.partitionBy(by).orderBy(*order).rowsBetween(1 - last, 0)
    return steps.withColumn("stalled", (F.count("*").over(frame) == last) & (F.sum("ok").over(frame) == 0))


def best_so_far(rounds: DataFrame, by: str, score: str, *order: str) -> DataFrame:
    """Adds best_before, accepted (strict improvement) and since (rounds since the last accepted one)."""
    frame = Window.partitionBy(by).orderBy(*order)
    before = F.max(score).over(frame.rowsBetween(Window.unboundedPreceding, -1))
    out = rounds.withColumn("best_before", before).withColumn("place", F.row_number().over(frame))
    out = out.withColumn("accepted", F.col("best_before").isNull() | (F.col(score) > F.col("best_before")))
    taken = F.max(F.when(F.col("accepted"), F.col("place"))).over(frame)
    return out.withColumn("since", F.col("place") - taken).drop("place")


def counter_delta(rows: DataFrame, by: str, value: str, *order: str) -> DataFrame:
    """Adds delta of a cumulative counter, never below 0; null on the first row."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("delta", F.when(step < 0, step - step).otherwise(step))


def within_budget(rows: DataFrame, by: str, size: Column, most: float, *order: Column, parts: int = 64) -> DataFrame:
    """Rows of each group up to the first that overflows the running budget (sizes are not negative).

    What overflows it in a part of its group overflows it in the whole, so most
    rows of a large group go before the group comes together.
    """
    part = F.pmod(F.xxhash64(*order), F.lit(parts))
    near = F.sum(size).over(Window.partitionBy(by, part).orderBy(*order))
    few = rows.withColumn("running", near).where(F.col("running") <= most).drop("running")
    frame = Window.partitionBy(by).orderBy(*order)
    return few.withColumn("running", F.sum(size).over(frame)).where(F.col("running") <= most)


def tiered(name: Column, alias: Column, query: Column) -> Column:
    """Palette order: exact name 0, prefix 1, substring 2, prefix of an alias 3, else null."""
    return (
        F.when(name == query, 0)
        .when(F.startswith(name, query), 1)
        .when(F.contains(name, query), 2)
        .when(F.startswith(alias, query), 3)
    )


def worst_category(findings: DataFrame, *by: str) -> DataFrame:
    """by, check, cost: the check with the highest summed cost, first by name on ties."""
    sums = findings.groupBy(*by, "check").agg(F.sum("cost").alias("cost"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("cost").desc(), "check"))
    return sums.withColumn("_place", place).where("_place = 1").drop("_place")
