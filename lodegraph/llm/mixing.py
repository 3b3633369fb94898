"""Mixing sources to target weights.

Tokens are aggregated per source, every source gets a target and a repetition
rate, and each document is emitted floor(rate) times plus one hash-seeded
Bernoulli copy whose probability is the rate's fraction.

The coins of a source are not tossed independently, since its words would then
miss the target by the noise of as many coins as it has documents.  Its documents
are dealt to strata of like size.  From the largest size down, each stratum gets
the copies that its share of what the target still lacks asks for, rounded by a
hash, and in it the documents with the smallest hashes take them.  The share is
the fraction on average over all seeds, so every document keeps its probability
(but where the rest cannot make up for what the large ones took), and the words
taken differ from the target by little more than a small document's.

Only DataFrame functions run here, and texts are never shuffled.  What is
grouped are narrow rows: counts per source, stratum and hash prefix combine on
the map side, and only the rows of each stratum's one deciding prefix (a part in
``PREFIXES``) are ranked, so a source with a third of all rows costs no skew.
Other windows run over one row per source, stratum or prefix.

Defined cases: null or empty texts have size 0; the null source is a source of
its own, ordered last; a source without words has target 0 and is not emitted;
rows equal in id and text share a hash, so they are taken alike; rows without
an id draw by their texts; equal hashes are ties and taken together; an empty
table gives an empty mix; columns of the input with names of the result are
replaced (``mix``) or kept (``emit``, whose ``copy`` replaces one), others pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, materialise

#: Hash prefixes (the first three hex digits) among which a stratum's last copy is looked for.
PREFIXES = 1 << 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def source_targets(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """source, source_size, target from ``docs`` (source, text): ``share`` of all sizes dealt by weight, none above
    ``most`` times its source.
    """
    return _targets(docs.select("source", word_count(F.col("text")).alias("size")), weights, share, most)


def _targets(sized: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Sources in code point order take ``weights`` in turn.

    Sorted by how early they reach their cap, the capped sources are a prefix,
    so the level at which the rest stands is found by running sums instead of by
    rounds.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    dealt = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    everyone = Window.partitionBy()
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    goal = F.sum(F.col("source_size")).over(everyone) * F.lit(float(share))
    level = (goal - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = dealt.withColumn("level", level).withColumn("capped", F.col("cap") / F.col("weight") <= F.col("level"))
    stand = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("level"))))
    return levels.withColumn("stand", stand.over(everyone)["level"]).select(
        "source",
        "source_size",
        F.when(F.col("capped"), F.col("cap")).otherwise(F.col("stand") * F.col("weight")).alias("target"),
    )


def draw(key: Column, text: Column, seed: int) -> Column:
    """13 hex digits that hang on the id, the text and the seed alone (the first 52 bits of an MD5)."""
    parts = [F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("-")), F.coalesce(text, F.lit(""))]
    return F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13)


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that hangs on the keys and the seed alone."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("-")) for k in keys]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def stratum(size: Column) -> Column:
    """The size's number of bits and the four highest of them: sizes of a stratum differ by an eighth at most."""
    bits = F.when(size > 0, F.length(F.bin(size))).otherwise(0)
    high = F.when(bits > 4, F.call_function("shiftright", size, bits - 4)).otherwise(size)
    return bits * 16 + high.cast("int")


def copies_of(strata: DataFrame, rates: DataFrame, seed: int) -> DataFrame:
    """source, stratum, copies from ``strata`` (source, stratum, n, words) and ``rates`` (source, fraction).

    A source has a bounded number of strata, so one row folds them in order.
    """
    rising = F.col("stratum").desc()
    upto = Window.partitionBy("source").orderBy(rising)
    everything = F.sum("words").over(Window.partitionBy("source"))
    left = strata.withColumn("words_left", everything - F.sum("words").over(upto) + F.col("words"))
    left = left.withColumn("u", uniform(seed, F.col("source"), F.col("stratum")))
    held = F.array_sort(
        F.collect_list(F.struct((-F.col("stratum")).alias("order"), "stratum", "n", "words", "words_left", "u"))
    )
    rate = rates.withColumnRenamed("source", "of")
    rows = left.groupBy("source").agg(held.alias("strata")).join(rate, F.col("source").eqNullSafe(F.col("of")))
    none = F.array().cast("array<struct<stratum:int,copies:bigint>>")
    lacking = F.col("fraction") * F.element_at("strata", 1)["words_left"]

    def step(state, x):
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), state["lacks"] / x["words_left"]))
        share = F.when(x["words_left"] > 0, share).otherwise(F.col("fraction"))
        copies = F.floor(share * x["n"] + x["u"])
        return F.struct(
            (state["lacks"] - copies * (x["words"] / x["n"])).alias("lacks"),
            F.concat(state["out"], F.array(F.struct(x["stratum"].alias("stratum"), copies.alias("copies")))).alias("out"),
        )

    folded = F.aggregate("strata", F.struct(lacking.alias("lacks"), none.alias("out")), step)
    return rows.select("source", F.explode(folded["out"]).alias("x")).select("source", "x.stratum", "x.copies")


def thresholds(narrow: DataFrame, rates: DataFrame, seed: int) -> DataFrame:
    """source, stratum, last: documents of the stratum take a copy more if their hash is at most ``last`` (no row: none).

    ``narrow``: source, stratum, size, hash of all documents; ``rates``: source, fraction.
    """
    prefix = F.substring("hash", 1, 3).alias("prefix")
    counts = narrow.groupBy("source", "stratum", prefix).agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    counts = materialise(counts, "mix-counts")
    strata = counts.groupBy("source", "stratum").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    asked = materialise(copies_of(strata, rates, seed).where("copies > 0"), "mix-asked")
    by_prefix = Window.partitionBy("source", "stratum").orderBy("prefix")
    before = F.coalesce(F.sum("n").over(by_prefix.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    mine = asked.select(F.col("source").alias("of"), F.col("stratum").alias("in"), "copies")
    same = F.col("source").eqNullSafe(F.col("of")) & (F.col("stratum") == F.col("in"))
    deciding = (
        counts.withColumn("before", before)
        .join(mine, same)
        .where("before < copies and copies <= before + n")
        .select("of", "in", F.col("prefix").alias("at"), (F.col("copies") - F.col("before")).alias("place"))
    )
    deciding = materialise(deciding, "mix-deciding")
    rows = narrow.join(deciding, same & (F.substring("hash", 1, 3) == F.col("at")))
    rank = F.row_number().over(Window.partitionBy("source", "stratum").orderBy("hash"))
    return rows.withColumn("rank", rank).where("rank = place").select("source", "stratum", F.col("hash").alias("last"))


def _decided(docs: DataFrame, seed: int, rules: dict) -> DataFrame:
    """``docs`` with one more column ``_mix``: size, source_size, target and copies (long)."""
    at = F.struct(
        F.col("source").alias("source"),
        word_count(F.col("text")).alias("size"),
        draw(F.col("doc_id"), F.col("text"), seed).alias("hash"),
    )
    keyed = docs.withColumn("_mix", at)
    narrow = keyed.select("_mix.source", "_mix.size", "_mix.hash").withColumn("stratum", stratum(F.col("size")))
    narrow = materialise(narrow, "mix-sizes")
    targets = materialise(_targets(narrow, **{"weights": (5, 2, 1), "share": 1.5, "most": 2.0, **rules}), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rates = targets.select("source", "source_size", "target", F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("fraction"))
    last = materialise(thresholds(narrow, rates.select("source", "fraction"), seed), "mix-thresholds")
    per_source = rates.select(F.struct("source", "source_size", "target", "whole").alias("_source"))
    per_stratum = last.select(F.struct("source", "stratum", "last").alias("_stratum"))
    joined = keyed.join(per_source, F.col("_mix.source").eqNullSafe(F.col("_source.source")), "left").join(
        per_stratum,
        F.col("_mix.source").eqNullSafe(F.col("_stratum.source")) & (stratum(F.col("_mix.size")) == F.col("_stratum.stratum")),
        "left",
    )
    extra = F.coalesce(F.col("_mix.hash") <= F.col("_stratum.last"), F.lit(False)).cast("long")
    found = F.struct(
        F.col("_mix.size").alias("size"),
        F.col("_source.source_size").alias("source_size"),
        F.col("_source.target").alias("target"),
        (F.col("_source.whole").cast("long") + extra).alias("copies"),
    )
    return joined.withColumn("_mix", found).drop("_source", "_stratum")


NEW = ("size", "source_size", "target", "copies")


def mix(docs: DataFrame, seed: int = 10, **rules) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, source, ...) with size, source_size, target and copies (long): how often the
    mix emits the row.  ``rules``: those of ``source_targets``.
    """
    keep = [c for c in docs.columns if c not in (*NEW, "_mix", "_source", "_stratum")]
    return _decided(docs.select(*keep), seed, rules).select(*keep, *[F.col("_mix")[c].alias(c) for c in NEW])


def emit(docs: DataFrame, seed: int = 10, **rules) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with ``copy`` from 1."""
    keep = [c for c in docs.columns if c != "copy"]
    held = docs.select("doc_id", "text", "source", F.struct(*keep).alias("_row"))
    taken = _decided(held, seed, rules).where(F.col("_mix.copies") > 0)
    numbers = F.sequence(F.lit(1), F.col("_mix.copies").cast("int"))
    return taken.select("_row", F.explode(numbers).alias("copy")).select("_row.*", "copy")
