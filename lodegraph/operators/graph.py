"""The association graph: edges with evidence, spreading activation, alternatives.

An edge joins two terms that share documents.  Our own definition: it exists
for every pair of lexicon terms with a common document, is stored in both
directions, counts one observation per document and one domain per distinct
domain of these documents, and weighs its normalised pointwise mutual
information.  Edges propagate only if seeded, or seen often enough in enough
domains.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scores import npmi, npmi_to_weight, rescale_weight
from ..sources.tables import written
from .corpus import Index

#: Rows whose pairs a task counts at once.
PAIR_ROWS = 2000


def lexicon_table(index: Index, low: float = 0.02, high: float = 0.12, size: int = 200) -> DataFrame:
    """term: the ``size`` most frequent terms of four letters or more in a middle band of document shares."""
    return banded(index.frequency(), index.n, low, high, size)


def banded(frequency: DataFrame, n: int, low: float = 0.02, high: float = 0.12, size: int = 200) -> DataFrame:
    """``lexicon_table`` of frequencies (term, df) over ``n`` documents."""
    held = frequency.where(F.length("term") >= 4)
    band = held.where((F.col("df") >= low * n) & (F.col("df") <= high * n))
    return band.orderBy(F.col("df").desc(), "term").limit(size).select("term")


def lexicon(index: Index, low: float = 0.02, high: float = 0.12, size: int = 200) -> list[str]:
    """The terms of ``lexicon_table`` in their order."""
    return [r["term"] for r in lexicon_table(index, low, high, size).collect()]


def _among(names: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in names]) if names else F.array().cast("array<string>")


def lexicon_terms(terms: Column, names: list[str]) -> Column:
    """Sorted distinct lexicon terms among a row's terms (the lexicon is a bounded list)."""
    return F.sort_array(F.array_intersect(terms, _among(names)))


def held_terms(index: Index, names: list[str]) -> DataFrame:
    """key, domain, held: the lexicon terms of each document, for all that looks at terms documents share.

    Written, since the optimizer spells the intersection out wherever held stands, filters and lambdas included.
    """
    return written(index.rows.select(index.key, "domain", lexicon_terms(F.col("terms.term"), names).alias("held")), "held")


def held_of_table(index: Index, terms: DataFrame) -> DataFrame:
    """key, domain, held as ``held_terms``, with the lexicon as a table (term) of any size."""
    rows = index.rows.select(index.key, "domain", F.explode_outer("terms.term").alias("term"))
    known = rows.where("term is not null").join(terms, "term")
    return known.groupBy(index.key, "domain").agg(F.sort_array(F.collect_list("term")).alias("held"))


def pairs(docs: DataFrame, terms: Column, *keep: str) -> DataFrame:
    """a, b (a < b) and ``keep`` for each pair of a row's terms."""
    later = F.transform(
        "terms",
        lambda a, i: F.transform(
            F.slice("terms", i + 2, F.size("terms")), lambda b: F.struct(a.alias("a"), b.alias("b"))
        ),
    )
    rows = docs.select(*keep, terms.alias("terms")).where(F.size("terms") > 1)
    return rows.select(*keep, F.explode(F.flatten(later)).alias("p")).select(*keep, "p.a", "p.b")


def _pairs_of(domain: pa.Array, held: pa.Array) -> dict[str, pa.Array]:
    """a, b, domain, n: the pairs (a < b) of the rows' sorted terms, counted per domain."""
    coded, place = held.flatten().dictionary_encode(), domain.dictionary_encode(null_encoding="encode")
    term, size = coded.indices.to_numpy().astype(np.int64), pc.list_value_length(held).to_numpy(zero_copy_only=False)
    later = np.repeat(np.cumsum(size), size) - np.arange(len(term)) - 1  # terms of the same row behind each
    first = np.repeat(np.arange(len(term)), later)
    second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(later) - later, later)
    of = np.repeat(place.indices.to_numpy().astype(np.int64), size)[first]
    many = max(1, len(coded.dictionary))
    code, n = np.unique((of * many + term[first]) * many + term[second], return_counts=True)
    take = lambda values, at: values.take(pa.array(at))
    return {
        "a": take(coded.dictionary, code // many % many), "b": take(coded.dictionary, code % many),
        "domain": take(place.dictionary, code // many // many), "n": pa.array(n, pa.int64()),
    }


def cooccurrence(held: DataFrame) -> DataFrame:
    """a, b, both, n_domains from ``held_terms``.

    Pairs come from each row's own array, so the self-join per document is
    gone; tasks count them per (a, b, domain) before anything travels.
    """
    kind = T.StructType([*T.StructType.fromDDL("a string, b string"), held.schema["domain"], *T.StructType.fromDDL("n long")])

    def count(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(kind)
        for batch in batches:
            for i in range(0, len(batch), PAIR_ROWS):
                some = batch.slice(i, PAIR_ROWS)
                found = _pairs_of(some.column(0), some.column(1))
                yield pa.RecordBatch.from_arrays([found[f.name].cast(f.type) for f in schema], schema=schema)

    seen = held.where(F.size("held") > 1).select("domain", "held").mapInArrow(count, kind)
    by_domain = seen.groupBy("a", "b", "domain").agg(F.sum("n").alias("n"))
    return by_domain.groupBy("a", "b").agg(F.sum("n").alias("both"), F.count("domain").alias("n_domains"))


def edges(index: Index, names: list[str]) -> DataFrame:
    """src, dst, npmi, weight, n_obs, n_domains, seeded: both directions of every pair."""
    n, held = index.n, held_terms(index, names)
    frequency = held.select(F.explode("held").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    both = cooccurrence(held)
    known = both.join(frequency.select(F.col("term").alias("a"), F.col("df").alias("df_a")), "a").join(
        frequency.select(F.col("term").alias("b"), F.col("df").alias("df_b")), "b"
    )
    value = npmi(F.lit(n), F.col("df_a"), F.col("df_b"), F.col("both"))
    flat = known.withColumn("npmi", value)
    ways = F.array(
        F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("df_b").alias("df_dst")),
        F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), F.col("df_a").alias("df_dst")),
    )
    out = flat.withColumn("way", F.explode(ways))
    return out.select(
        "way.src",
        "way.dst",
        "npmi",
        npmi_to_weight(F.col("npmi"), F.col("way.df_dst"), F.lit(n)).alias("weight"),
        F.col("both").alias("n_obs"),
        "n_domains",
        F.lit(0).alias("seeded"),
    )


def eligible(table: DataFrame, min_obs: int = 3, min_domains: int = 2) -> DataFrame:
    enough = (F.col("n_obs") >= min_obs) & (F.col("n_domains") >= min_domains)
    return table.where((F.col("seeded") == 1) | enough)


def seeded(curated: DataFrame, n_obs: int = 99) -> DataFrame:
    """Curated pairs (src, dst, relation) as seeded edges of full weight, once in each direction."""
    back = curated.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation")
    both = curated.select("src", "dst", "relation").unionByName(back).distinct()
    return both.select("*", F.lit(1.0).alias("weight"), F.lit(n_obs).alias("n_obs"), F.lit(1).alias("seeded"))


def capped(table: DataFrame, most: int = 24) -> DataFrame:
    """The strongest ``most`` edges per source; seeded ones always stay."""
    order = Window.partitionBy("src").orderBy(F.col("seeded").desc(), F.round("weight", 9).desc(), "dst")
    ranked = table.withColumn("place", F.row_number().over(order))
    return ranked.where((F.col("place") <= most) | (F.col("seeded") == 1)).drop("place")


def with_brake(table: DataFrame, c: float = 0.4) -> DataFrame:
    """Adds rescaled and blocked: weights up to c carry nothing."""
    scaled = table.withColumn("rescaled", rescale_weight(F.col("weight"), c))
    return scaled.withColumn("blocked", F.col("rescaled") <= 0)


def hop_flows(frontier: DataFrame, table: DataFrame, hop: int, decay: float, alternative: float) -> DataFrame:
    """query_id, src, dst, contribution of one hop."""
    factor = F.lit(decay**hop)
    if "relation" in table.columns:
        factor = factor * F.when(F.col("relation") == "alternative", F.lit(alternative)).otherwise(F.lit(1.0))
    return frontier.join(table.where("rescaled > 0"), frontier["id"] == table["src"]).select(
        "query_id", "src", "dst", (F.col("activation") * F.col("rescaled") * factor).alias("contribution")
    )


def spread_activation(
    seeds: DataFrame,
    table: DataFrame,
    hops: int = 2,
    decay: float = 0.65,
    tau: float = 0.5,
    alternative: float = 0.35,
) -> tuple[DataFrame, DataFrame]:
    """(query_id, id, activation, hop) and the flows (query_id, src, dst, contribution, hop).

    All of a hop's flows use the activations at its start.  ``table`` has
    rescaled weights; only nodes first reached in a hop, and above tau, go on.
    Flows and activations are written after each hop, so a hop never computes
    the ones before it again.
    """
    state = seeds.select("query_id", "id", F.lit(1.0).alias("activation"), F.lit(0).alias("hop")).distinct()
    frontier, all_flows = state, None
    for hop in range(1, hops + 1):
        flows = written(hop_flows(frontier, table, hop, decay, alternative), "flows")
        got = flows.groupBy("query_id", F.col("dst").alias("id")).agg(F.sum("contribution").alias("more"))
        state = state.join(got, ["query_id", "id"], "full").select(
            "query_id",
            "id",
            F.least(
                F.lit(1.0), F.coalesce("activation", F.lit(0.0)) + F.coalesce("more", F.lit(0.0))
            ).alias("activation"),
            F.coalesce("hop", F.lit(hop)).alias("hop"),
        )
        state = written(state, "activations")
        frontier = state.where((F.col("hop") == hop) & (F.col("activation") >= tau))
        flows = flows.withColumn("hop", F.lit(hop))
        all_flows = flows if all_flows is None else all_flows.unionByName(flows)
    return state, all_flows


def resolve_alternatives(activated: DataFrame, alternatives: DataFrame) -> DataFrame:
    """Adds in_favour_of (null: kept) to ``activated`` (query_id, id, activation) given ``alternatives`` (a, b).

    The strongest node of each query that is still undecided wins and drops its
    alternatives, until none is left.  A query's activated nodes are few (the
    activation threshold bounds them), so one task folds one query.
    """
    both = alternatives.select("a", "b").unionByName(alternatives.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = activated.select("query_id", F.col("id").alias("b"))
    links = (
        activated.select("query_id", "id")
        .join(both, activated["id"] == both["a"])
        .join(other, ["query_id", "b"])
        .groupBy("query_id", "id")
        .agg(F.sort_array(F.collect_set("b")).alias("others"))
    )
    rows = activated.join(links, ["query_id", "id"], "left").select("query_id", "id", "activation", "others")
    kind = dict(activated.dtypes)

    def fold(pdf):
        pdf = pdf.assign(order=-pdf["activation"].round(12)).sort_values(["order", "id"]).reset_index(drop=True)
        lost: dict = {}
        for row in pdf.itertuples():
            if row.id in lost or row.others is None:
                continue
            for x in row.others:
                if x != row.id and x not in lost:
                    lost[x] = row.id
        return pdf.assign(in_favour_of=[lost.get(x) for x in pdf["id"]])[
            ["query_id", "id", "activation", "in_favour_of"]
        ]

    schema = f"query_id {kind['query_id']}, id {kind['id']}, activation double, in_favour_of {kind['id']}"
    return rows.groupBy("query_id").applyInPandas(fold, schema)


def evidence_sample(evidence: DataFrame, per_edge: int = 2) -> DataFrame:
    """The first ``per_edge`` rows per (src, dst) by confidence, then age, then document."""
    order = Window.partitionBy("src", "dst").orderBy(F.col("confidence").desc(), "doc_id")
    return evidence.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_edge)
