"""The k best documents of every question, by blocks of documents.

Postings of the asked terms are dealt to groups of documents, once and not per
question; the questions go to every group.  A task scores all questions over its
group with arrays.  A question's terms are added rarest first.  What the terms
left can add is bounded by their largest parts in each block of ``BLOCK``
documents; a document whose sum and bound stay below the k-th best sum so far is
left out of all further terms, and so are whole blocks.  The k-th best never
falls, so the result is exact.

Where there are many groups, one in ``SAMPLED`` is scored first; the k-th best of
each question there is a threshold that all groups share from their start.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

K1, B = 1.2, 0.75
#: Documents of a group (one task's work) and of a block (one bound), about.
GROUP, BLOCK = 4_096, 16
SAMPLED = 16
#: Sums of the same parts in another order differ by less.
ROUNDING = 1e-6


def group_of(key: Column, groups: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(groups)).cast("int")


def _parts_of_group(postings: pa.Table, key: str, mean_length: float) -> tuple:
    """The group's keys; document and part (without idf) of each posting, by term; terms, where their postings start and stop."""
    keys = postings[key].combine_chunks()
    distinct = keys.unique().sort()
    doc = pa.compute.index_in(keys, distinct).to_numpy(zero_copy_only=False)
    term, weight, length = (postings[c].to_numpy() for c in ("term", "weight", "length"))
    order = np.lexsort((doc, term))
    term, doc = term[order], doc[order]
    part = weight[order] * (K1 + 1) / (weight[order] + K1 * (1 - B + B * length[order] / mean_length))
    terms, starts = np.unique(term, return_index=True)
    return distinct, term, doc, part, terms, starts, np.append(starts[1:], len(term))


def _best_question_of_group(postings: pa.Table, asked: pa.Table, key: str, mean_length: float) -> tuple:
    """Keys, the best score of each over all questions, and its question: the smaller one on ties in the ninth decimal."""
    distinct, _, doc, part, terms, starts, stops = _parts_of_group(postings, key, mean_length)
    number = {t: i for i, t in enumerate(terms.tolist())}
    best, which = np.full(len(distinct), -1.0), np.zeros(len(distinct), np.int64)
    question, asked_term, idf = (asked[c].to_numpy() for c in ("question", "term", "idf"))
    by = np.argsort(question, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(question[by]) != 0)) if len(by) else []
    for x, y in zip(cuts, [*cuts[1:], len(by)]):
        sums, held = np.zeros(len(distinct)), np.zeros(len(distinct), bool)
        for t, w in zip(asked_term[by[x:y]].tolist(), idf[by[x:y]].tolist()):
            if t in number:
                at = slice(starts[number[t]], stops[number[t]])
                sums[doc[at]] += w * part[at]
                held[doc[at]] = True
        sums = np.where(held, np.round(sums, 9), -1.0)
        better = sums > best
        best[better], which[better] = sums[better], question[by[x]]
    found = np.flatnonzero(best >= 0)
    return distinct.take(pa.array(found)), best[found], which[found]


def _best_of_group(postings: pa.Table, asked: pa.Table, key: str, mean_length: float, k: int) -> Iterator[tuple]:
    """(question, keys, scores, postings added) per question."""
    distinct, term, doc, part, terms, starts, stops = _parts_of_group(postings, key, mean_length)
    n, blocks = len(distinct), -(-len(distinct) // BLOCK)
    block = doc // BLOCK
    edges = np.flatnonzero(np.append(True, (np.diff(term) != 0) | (np.diff(block) != 0))) if len(term) else np.zeros(0, np.int64)
    most = np.maximum.reduceat(part, edges) if len(edges) else part
    edge_block, edge_starts = block[edges], np.searchsorted(edges, starts)
    edge_stops = np.append(edge_starts[1:], len(edges))
    number = {t: i for i, t in enumerate(terms.tolist())}
    question, asked_term, idf, least = (asked[c].to_numpy() for c in ("question", "term", "idf", "least"))
    by = np.lexsort((-idf, question))
    cuts = np.flatnonzero(np.append(True, np.diff(question[by]) != 0)) if len(by) else []
    of_block = np.arange(n) // BLOCK
    for x, y in zip(cuts, [*cuts[1:], len(by)]):
        rows = [(number[t], w) for t, w in zip(asked_term[by[x:y]].tolist(), idf[by[x:y]].tolist()) if t in number]
        if not rows:
            continue
        rest = np.zeros((len(rows) + 1, blocks))
        for i, (t, w) in enumerate(rows):
            rest[i, edge_block[edge_starts[t] : edge_stops[t]]] = w * most[edge_starts[t] : edge_stops[t]]
        rest = rest[::-1].cumsum(axis=0)[::-1]
        sums, threshold, added = np.zeros(n), least[by[x]], 0
        alive = rest[0][of_block] >= threshold - ROUNDING
        for i, (t, w) in enumerate(rows):
            at = slice(starts[t], stops[t])
            mine = alive[doc[at]]
            docs = doc[at][mine]
            sums[docs] += w * part[at][mine]
            added += len(docs)
            if n > k:
                threshold = max(threshold, np.partition(sums, n - k)[n - k])
                alive &= sums + rest[i + 1][of_block] >= threshold - ROUNDING
        found = np.flatnonzero(alive & (sums > 0))
        best = found[np.lexsort((found, -np.round(sums[found], 9)))][:k]
        yield question[by[x]], distinct.take(pa.array(best)), sums[best], added


def _hashed(postings: DataFrame, key: str, groups: int) -> DataFrame:
    return postings.select(group_of(F.col(key), groups).alias("group"), key, F.xxhash64("term").alias("term"), F.col("weight").cast("double"), F.col("length").cast("double"))


def _groups(spark, n: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-n // GROUP))


def best_question(asked: DataFrame, postings: DataFrame, key: str, n: int, mean_length: float) -> DataFrame:
    """key, best_score, best_query: each document's best score over all questions (query_id long); arguments as of ``best``.

    A group's task keeps one sum per document, so pairs of questions and documents never travel.
    """
    groups = _groups(asked.sparkSession, n)
    schema = T.StructType([T.StructField(key, postings.schema[key].dataType), *T.StructType.fromDDL("best_score double, best_query long")])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        want = to_arrow_schema(schema)
        columns = _best_question_of_group(left, right, key, mean_length)
        return pa.Table.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, want)], schema=want)

    everywhere = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    dealt = asked.select(F.col("query_id").cast("long").alias("question"), F.xxhash64("term").alias("term"), F.col("idf").cast("double"), everywhere.alias("group"))
    return _hashed(postings, key, groups).groupBy("group").cogroup(dealt.groupBy("group")).applyInArrow(score, schema)


def best(asked: DataFrame, postings: DataFrame, key: str, n: int, mean_length: float, k: int) -> DataFrame:
    """query_id, key, score, added: at least the k best of each question.

    ``asked``: query_id, term, idf, one row per question and term; ``postings``: key, term, weight, length, one row per
    document and term; ``n``: documents.  ``added``: postings of the question that were added up in the group.
    """
    groups = _groups(asked.sparkSession, n)
    return best_of_groups(asked, _hashed(postings, key, groups), groups, key, postings.schema[key].dataType, mean_length, k)


def best_of_groups(
    asked: DataFrame, hashed: DataFrame, groups: int, key: str, key_type: T.DataType, mean_length: float, k: int, unpack: Callable[[pa.Table], pa.Table] | None = None
) -> DataFrame:
    """As ``best``; ``hashed`` has a column group, all rows of a document in one, and key, term (its hash), weight, length.

    With ``unpack`` it may have other columns, of which ``unpack`` makes these in the group's task.
    """
    query_type = asked.schema["query_id"].dataType
    schema = T.StructType([T.StructField("question", T.LongType()), T.StructField(key, key_type), *T.StructType.fromDDL("score double, added long")])
    # questions travel by number; a question's rows meet again by it
    numbered = asked.select("query_id", F.xxhash64("query_id").alias("question"), F.xxhash64("term").alias("term"), F.col("idf").cast("double").alias("idf"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        want = to_arrow_schema(schema)
        if not len(left) or not len(right):
            return want.empty_table()
        left = left if unpack is None else unpack(left)
        out = [(np.full(len(keys), q, np.int64), keys, scores, np.full(len(keys), added, np.int64)) for q, keys, scores, added in _best_of_group(left, right, key, mean_length, k)]
        if not out:
            return want.empty_table()
        columns = [
            pa.array(np.concatenate([x[0] for x in out]), pa.int64()),
            pa.concat_arrays([x[1] for x in out]),
            pa.array(np.concatenate([x[2] for x in out])),
            pa.array(np.concatenate([x[3] for x in out]), pa.int64()),
        ]
        return pa.Table.from_arrays([c.cast(t.type) for c, t in zip(columns, want)], schema=want)

    def scored(rows: DataFrame, questions: DataFrame, numbers: Column) -> DataFrame:
        dealt = questions.select("question", "term", "idf", "least", F.explode(numbers).alias("group"))
        return rows.groupBy("group").cogroup(dealt.groupBy("group")).applyInArrow(score, schema)

    everywhere = F.sequence(F.lit(0), F.lit(groups - 1))
    questions = numbered.withColumn("least", F.lit(float("-inf")))
    if groups >= 2 * SAMPLED:
        some = hashed.where(F.col("group") % SAMPLED == 0)
        first = scored(some, questions, F.filter(everywhere, lambda g: g % SAMPLED == 0))
        place = F.row_number().over(Window.partitionBy("question").orderBy(F.col("score").desc()))
        kth = first.withColumn("place", place).where(F.col("place") <= k).where(F.col("place") == k).select("question", F.col("score").alias("kth"))
        questions = numbered.join(kth, "question", "left").withColumn("least", F.coalesce("kth", F.lit(float("-inf"))))
    found = scored(hashed, questions, everywhere)
    ids = numbered.select("question", "query_id").distinct()
    return found.join(ids, "question").select(F.col("query_id").cast(query_type), key, "score", "added")
