"""Corpus statistics and lexical retrieval.

Texts are cut into tokens once: ``bags`` counts them inside each row, so nothing
is shuffled, and an ``Index`` writes the result once for all that reads it:
frequencies, breadth, postings, lengths and, in ``graph``, shared terms.
Frequencies are exact, since thresholds depend on them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import query_tokens, spaced, tokens
from ..sources.tables import dealt, written
from . import ranking
from .ranking import B, K1


#: Bytes of text that a task counts at once, about.
CUT = 1 << 21


def _counted(texts: list[pa.Array], weights: list[float]) -> tuple[pa.Array, pa.Array]:
    """Per row its number of tokens, and its distinct tokens in their order with their weighted numbers (``texts``: ``spaced``)."""
    words = [pc.split_pattern(t, " ") for t in texts]
    sizes = [pc.fill_null(pc.list_value_length(w), 0).to_numpy(zero_copy_only=False) for w in words]
    coded = pa.concat_arrays([w.flatten() for w in words]).dictionary_encode()
    trimmed = pc.utf8_trim(coded.dictionary, "-.")  # once per distinct word
    terms = trimmed.filter(pc.greater_equal(pc.utf8_length(trimmed), 2)).unique()
    terms = terms.take(pc.array_sort_indices(terms))
    of = pc.fill_null(pc.index_in(trimmed, value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    term, row = of[coded.indices.to_numpy()], np.concatenate([np.repeat(np.arange(len(n)), n) for n in sizes])
    kept = term >= 0
    place = row[kept] * max(1, len(terms)) + term[kept]
    if len(texts) == 1:
        place, n = np.unique(place, return_counts=True)
        weight = n * weights[0]
    else:
        place, which = np.unique(place, return_inverse=True)
        weight = np.bincount(which, np.repeat(weights, [n.sum() for n in sizes])[kept], len(place))
    of_row, term = np.divmod(place, max(1, len(terms)))
    pairs = pa.StructArray.from_arrays([terms.take(pa.array(term)), pa.array(weight, pa.float64())], ["term", "weight"])
    cuts = np.searchsorted(of_row, np.arange(len(sizes[0]) + 1))
    known = reduce(pc.and_, [t.is_valid() for t in texts])
    length = pa.array(np.bincount(row[kept], minlength=len(sizes[0])), pa.int64())
    return pc.if_else(known, length, None), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pairs)


def bags(docs: DataFrame, key: str, fields: dict[str, float], domain: str | None = None) -> DataFrame:
    """key, domain, length (tokens in all fields), terms: array of (term, weight), sorted by term; one row per row.

    A token weighs what its field does; what several fields hold of a term is added up.
    """
    own = [F.col(key), *([F.col(domain).alias("domain")] if domain else [])]
    names = ["domain"] if domain else []
    docs = dealt(docs.select(*own, *fields).toDF(key, *names, *fields))
    cut = docs.select(key, *names, *[spaced(F.col(name)).alias(f"w{i}") for i, name in enumerate(fields)])
    kind = T.StructType([*[cut.schema[c] for c in (key, *names)], *T.StructType.fromDDL("length long, terms array<struct<term:string,weight:double>>")])
    weights, first = [float(w) for w in fields.values()], 1 + len(names)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(kind)
        for batch in batches:
            size = sum(pc.fill_null(pc.binary_length(t), 0).to_numpy(zero_copy_only=False).astype(np.int64) for t in batch.columns[first:])
            piece = np.cumsum(size) // CUT
            starts = np.flatnonzero(np.append(True, np.diff(piece) != 0)).tolist() if len(piece) else []
            for x, y in zip(starts, [*starts[1:], len(piece)]):
                some = batch.slice(x, y - x)
                columns = [*some.columns[:first], *_counted(some.columns[first:], weights)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return cut.mapInArrow(run, kind)


#: Terms whose documents a task counts at once, about.
TALLY = 1 << 20


def _tallied(lists) -> pa.RecordBatch:
    """term, n: in how many of the rows' lists of distinct terms each term is."""
    counts = pc.value_counts(pa.chunked_array(lists))
    return pa.RecordBatch.from_arrays([counts.field("values").cast(pa.string()), counts.field("counts")], ["term", "n"])


def _tally(lists):
    """``_tallied`` of some lists after the other, so that a task hands on a row per term and not per document and term."""
    held, size = [], 0
    for terms in lists:
        held.append(terms)
        size += len(terms)
        if size >= TALLY:
            yield _tallied(held)
            held, size = [], 0
    if held:
        yield _tallied(held)


def frequency_of(docs: DataFrame, text: str) -> DataFrame:
    """term, df as of an ``Index`` over one field: for what needs nothing else of it, so nothing is written."""

    def run(batches):
        def lists():
            for batch in batches:
                size = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                piece = np.cumsum(size) // CUT
                starts = np.flatnonzero(np.append(True, np.diff(piece) != 0)).tolist() if len(piece) else []
                for x, y in zip(starts, [*starts[1:], len(piece)]):
                    yield _counted([batch.column(0).slice(x, y - x)], [1.0])[1].flatten().field("term")

        return _tally(lists())

    counts = dealt(docs.select(text)).select(spaced(F.col(text)).alias("w")).mapInArrow(run, "term string, n long")
    return counts.groupBy("term").agg(F.sum("n").alias("df"))


@dataclass(frozen=True)
class Index:
    """A corpus cut into tokens once: its ``bags``, how many documents they are and how long on average."""

    rows: DataFrame
    key: str
    n: int
    mean_length: float

    @classmethod
    def build(cls, docs: DataFrame, key: str, fields: dict[str, float], domain: str | None = None) -> Index:
        rows = written(bags(docs, key, fields, domain), "bags")
        size = rows.agg(F.count("*").alias("n"), F.avg("length").alias("m")).first()
        return cls(rows, key, size["n"], size["m"] or 0.0)

    def postings(self) -> DataFrame:
        """key, term, wtf (weighted frequency), length: one row per document and term."""
        flat = self.rows.select(self.key, "length", F.explode("terms").alias("x")).select(self.key, "length", "x.term", "x.weight")
        return flat.withColumnRenamed("weight", "wtf")

    def frequency(self) -> DataFrame:
        """term, df."""

        def run(batches):
            return _tally(batch.column(0).flatten() for batch in batches)

        counts = self.rows.select(F.col("terms.term").alias("t")).mapInArrow(run, "term string, n long")
        return counts.groupBy("term").agg(F.sum("n").alias("df"))

    def statistics(self) -> DataFrame:
        """term, df, n_domains, breadth: documents per (term, domain), then per term."""
        terms = self.rows.select("domain", F.explode("terms.term").alias("term"))
        each = terms.groupBy("term", "domain").agg(F.count("*").alias("n"))
        held = each.groupBy("term").agg(F.sum("n").alias("df"), F.count("domain").alias("n_domains"))
        return held.withColumn("breadth", F.col("n_domains") / self.rows.agg(F.count_distinct("domain")).scalar())


def doc_terms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf: one row per document and term; counted inside each row, so nothing is shuffled."""
    # an outer explode: the plain one lets the optimizer repeat the tokeniser, lambdas and all, in a filter below
    found = bags(docs, key, {text: 1.0}).select(key, F.explode_outer("terms").alias("x"))
    return found.select(key, "x.term", F.col("x.weight").cast("long").alias("tf")).where("term is not null")


def doc_frequency(docs: DataFrame, text: str) -> DataFrame:
    """term, df: distinct tokens per row are exploded, so a plain count is a distinct count of documents."""
    words = docs.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("df"))


def breadth(docs: DataFrame, text: str, domain: str) -> DataFrame:
    """term, n_domains, breadth: the share of all domains whose texts hold the term."""
    words = docs.select(F.col(domain).alias("domain"), F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    held = words.distinct().groupBy("term").agg(F.count("domain").alias("n_domains"))
    all_domains = docs.agg(F.count_distinct(domain)).scalar()
    return held.select("term", "n_domains", (F.col("n_domains") / all_domains).alias("breadth"))


def distinctive(queries: DataFrame, statistics: DataFrame, n_docs: int) -> DataFrame:
    """query_id, term, df, breadth of the terms rare enough to identify a subject (``queries``: query_id, text)."""
    known = asked_terms(queries).join(statistics.select("term", "df", "breadth"), "term", "left")
    limit = max(2, n_docs * 5 // 100)
    return known.select(
        "query_id",
        "term",
        F.coalesce("df", F.lit(0)).alias("df"),
        F.coalesce("breadth", F.lit(0.0)).alias("breadth"),
    ).where((F.col("df") <= limit) & (F.col("breadth") <= 0.25))


def asked_terms(queries: DataFrame, most: int | None = 24) -> DataFrame:
    """query_id, term from ``queries`` (query_id, text): the first ``most`` distinct tokens of each, or all (None)."""
    return queries.select("query_id", F.explode(query_tokens(F.col("text"), most)).alias("term"))


def _wanted(asked: DataFrame, index: Index) -> tuple[DataFrame, DataFrame]:
    """Postings of asked terms (one row per document and term), and term, df, idf of these."""
    terms = asked.select("term").distinct()
    some = index.postings().join(terms, "term", "left_semi")
    wanted = written(some.select(index.key, "length", "term", "wtf"), "asked-postings")
    frequency = wanted.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln((F.lit(index.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return wanted, written(frequency.withColumn("idf", F.when(idf > 0, idf).otherwise(1e-6)), "asked-terms")


def _part(index: Index) -> Column:
    """What a term adds to a document's score; ``idf * (K1 + 1)`` bounds it."""
    share = 1 - B + B * F.col("length") / F.lit(index.mean_length)
    return F.col("idf") * F.col("wtf") * (K1 + 1) / (F.col("wtf") + K1 * share)


def bm25(asked: DataFrame, index: Index) -> DataFrame:
    """query_id, key, score for every document that holds a term of ``asked`` (query_id, term).

    Common words make this nearly all pairs of questions and documents; ``bm25_top`` gives the best ones without them.
    """
    wanted, ranked = _wanted(asked, index)
    return asked.join(ranked, "term").join(wanted, "term").groupBy("query_id", index.key).agg(F.sum(_part(index)).alias("score"))


def bm25_top(asked: DataFrame, index: Index, k: int) -> DataFrame:
    """query_id, key, score, rank: the k best documents of each question, exactly as ``top_k(bm25(...))``; see ``ranking``."""
    wanted, ranked = _wanted(asked, index)
    known = asked.select("query_id", "term").distinct().join(ranked, "term")
    found = ranking.best(known, wanted.withColumnRenamed("wtf", "weight"), index.key, index.n, index.mean_length, k)
    return top_k(found.drop("added"), index.key, k)


def best_question(asked: DataFrame, index: Index) -> DataFrame:
    """key, best_score, best_query: ``max_over_queries`` of ``bm25``, without its pairs of questions and documents."""
    wanted, ranked = _wanted(asked, index)
    known = asked.select("query_id", "term").distinct().join(ranked, "term")
    return ranking.best_question(known, wanted.withColumnRenamed("wtf", "weight"), index.key, index.n, index.mean_length)


def top_k(scored: DataFrame, key: str, k: int, score: str = "score", by: str = "query_id") -> DataFrame:
    """The k best per query with their rank; ties in the ninth decimal go to the smaller key."""
    order = Window.partitionBy(by).orderBy(F.round(score, 9).desc(), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def max_over_queries(scored: DataFrame, key: str) -> DataFrame:
    """key, best_score, best_query: the query with the highest score, the smaller one on ties."""
    best = F.max(F.struct(F.round("score", 9).alias("s"), (-F.col("query_id")).alias("q"))).alias("best")
    return scored.groupBy(key).agg(best).select(
        key, F.col("best.s").alias("best_score"), (-F.col("best.q")).alias("best_query")
    )


def _gram(n: int):
    return lambda i: F.array_join(F.slice("w", i, F.lit(n)), " ")


def ngram_hits(texts: DataFrame, key: str, text: Column, names: DataFrame) -> DataFrame:
    """key, name: names (canonical, words between blanks) that stand in the text at word boundaries.

    An equi-join on the text's word n-grams, of all lengths that names have, instead of a containment join.
    """
    n_words = F.size(F.filter(F.split("name", " "), lambda w: w != ""))
    lengths = [r[0] for r in names.select(n_words.alias("n")).where("n > 0").distinct().collect()]
    words = F.filter(F.split(F.trim(text), " "), lambda w: w != "")
    rows = texts.select(key, words.alias("w"))
    runs = F.array().cast("array<string>")
    for n in sorted(lengths):
        places = F.sequence(F.lit(1), F.size("w") - n + 1)
        grams = F.when(
            F.size("w") >= n, F.transform(places, _gram(n))
        ).otherwise(F.array().cast("array<string>"))
        runs = F.concat(runs, grams)
    return rows.select(key, F.explode(F.array_distinct(runs)).alias("name")).join(names, "name")
