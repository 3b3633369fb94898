"""Rank fusion and the relevance gate, for a whole table of questions at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


@dataclass(frozen=True)
class Gate:
    # The gate's default floors.
    min_cosine: float = 0.35
    min_prominence: float = 0.13
    min_bm25: float = 3.5
    agreement: float = 0.8
    stands_clear: float = 0.166
    relative_floor: float = 0.72
    near_miss: float = 0.85
    max_seeds: int = 6


def rrf(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """query_id, id, rrf, sources from ``lists`` (query_id, retriever, id, rank, score)."""
    detail = F.struct("retriever", F.struct("rank", "score"))
    return lists.groupBy("query_id", "id").agg(
        F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("rrf"),
        F.map_from_entries(F.sort_array(F.collect_list(detail))).alias("sources"),
    )


def grounded(hits: DataFrame, unclaimed: DataFrame, modules: DataFrame, weight: float = 0.2) -> DataFrame:
    """Hits sorted anew: a match through a name that the question does not claim counts ``weight``, common names less.

    ``hits``: query_id, id, score; ``unclaimed``: query_id, id; ``modules``: id, specificity.
    """
    marked = hits.select("query_id", "id", "score").join(unclaimed.withColumn("off", F.lit(True)), ["query_id", "id"], "left")
    scored = marked.join(modules.select("id", "specificity"), "id").withColumn(
        "score", F.when(F.col("off"), F.col("score") * weight).otherwise(F.col("score")) * F.col("specificity")
    )
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id")
    return scored.select("query_id", "id", "score", F.row_number().over(order).alias("rank"))


def fuse_search_results(results: DataFrame, limit: int, k: int = RRF_K) -> DataFrame:
    """url, title, engines, score, rank from ``results`` (engine, rank, url, title): one row per page.

    An engine that lists a page twice counts with its best rank; the longest
    title stays.
    """
    each = results.groupBy("url", "engine").agg(
        F.min("rank").alias("rank"), F.max(F.struct(F.length("title"), "title")).alias("best")
    )
    fused = each.groupBy("url").agg(
        F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"),
        F.min("rank").alias("best_rank"),
        F.max("best")["title"].alias("title"),
        F.array_join(F.sort_array(F.collect_set("engine")), ",").alias("engines"),
    )
    return fused.orderBy(F.round("score", 9).desc(), "best_rank", "url").limit(limit)


def signals(fused: DataFrame, lexical: DataFrame, vector: DataFrame, field: DataFrame, rare: DataFrame) -> DataFrame:
    """One row per question with everything the gate looks at.

    ``lexical``, ``vector``: query_id, id, score (retriever lists); ``field``:
    query_id, middle; ``rare``: query_id, id, score over distinctive terms only,
    plus ``has_rare`` per question in ``fused``'s absence of such terms.
    """
    best = lambda df, name: df.groupBy("query_id").agg(
        F.max(F.struct(F.round("score", 9).alias("s"), (-F.col("id")).alias("i"))).alias(name)
    )
    out = fused.select("query_id").distinct()
    for df, name in ((lexical, "lex"), (vector, "vec"), (rare, "rare")):
        out = out.join(best(df, name), "query_id", "left")
    out = out.join(field.select("query_id", "middle"), "query_id", "left")
    zero = F.lit(0.0)
    return out.select(
        "query_id",
        F.coalesce("vec.s", zero).alias("top_cosine"),
        F.coalesce("middle", zero).alias("median_cosine"),
        F.coalesce("lex.s", zero).alias("top_bm25"),
        F.coalesce("rare.s", zero).alias("top_bm25_rare"),
        F.coalesce(F.col("lex.i") == F.col("vec.i"), F.lit(False)).alias("retrievers_agree"),
    )


def passes(gate: Gate) -> dict:
    """The gate's tests as columns over signals (with has_rare and top_exact)."""
    prominence = F.col("top_cosine") - F.col("median_cosine")
    lexical = F.when(F.col("has_rare"), F.col("top_bm25_rare")).otherwise(F.col("top_bm25"))
    weak = lexical >= gate.min_bm25 * gate.agreement
    exact = F.col("top_exact") >= 0.99
    clear = F.when(F.col("median_cosine") <= 0, F.col("top_cosine") > 0).otherwise(prominence >= gate.stands_clear)
    covered = ~F.col("has_rare") | (F.col("top_bm25_rare") > 0) | (F.col("top_exact") > 0)
    semantic = (prominence >= gate.min_prominence) & (F.col("top_cosine") >= gate.min_cosine) & (weak | exact | clear)
    agree = F.col("retrievers_agree") & (F.col("top_cosine") >= gate.min_cosine * gate.agreement) & weak
    confidence = F.greatest(
        F.col("top_exact"),
        F.least(F.lit(1.0), lexical / (gate.min_bm25 * 2)),
        F.least(F.lit(1.0), prominence / max(gate.min_prominence, 1e-9)),
    )
    relevant = covered & (semantic | (lexical >= gate.min_bm25) | agree | exact)
    return {"prominence": prominence, "lexical": lexical, "covered": covered, "relevant": relevant, "confidence": confidence}


def seed_gate(fused: DataFrame, signal: DataFrame, gate: Gate = Gate()) -> DataFrame:
    """query_id, id, rrf, verdict, confidence, reason for each fused hit.

    ``signal``: query_id and the columns of ``signals`` with has_rare, top_exact.
    """
    tests = passes(gate)
    judged = signal.select("query_id", *[tests[x].alias(x) for x in ("covered", "relevant", "confidence")])
    order = Window.partitionBy("query_id").orderBy(F.round("rrf", 12).desc(), "id")
    hits = fused.withColumn("place", F.row_number().over(order)).withColumn(
        "floor", F.max("rrf").over(Window.partitionBy("query_id")) * gate.relative_floor
    )
    verdict = (
        F.when(~F.col("relevant"), "BELOW_THRESHOLD")
        .when(F.col("rrf") < F.col("floor") * gate.near_miss, "BELOW_THRESHOLD")
        .when(F.col("rrf") < F.col("floor"), "NEAR_MISS")
        .when(F.col("place") > gate.max_seeds, "OVER_CAP")
        .otherwise("SEED")
    )
    reason = (
        F.when(~F.col("covered"), "no module holds a distinctive term of the question")
        .when(~F.col("relevant"), "no retriever finds anything relevant")
        .when(F.col("rrf") < F.col("floor"), "too far below the best")
        .when(F.col("place") > gate.max_seeds, "all seeds are taken")
        .otherwise("in contention with the best")
    )
    out = hits.join(judged, "query_id").withColumn("verdict", verdict).withColumn("reason", reason)
    confidence = F.when(F.col("verdict") == "SEED", F.col("confidence")).alias("confidence")
    return out.select("query_id", "id", "rrf", "verdict", confidence, "reason")


def knowledge_gaps(decisions: DataFrame) -> DataFrame:
    """query_id, gap: no seed at all."""
    return decisions.groupBy("query_id").agg((~F.bool_or(F.col("verdict") == "SEED")).alias("gap"))
