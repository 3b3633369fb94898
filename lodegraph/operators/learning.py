"""Pages to knowledge, as one chain: a record per page, glue and skips, edges that can be taken back.

``records`` makes one nested row per page in a single pass over its html: what
its sentences mention, which terms they offer as alternatives, the best mention
of each term, and why a page teaches nothing.  All of it happens inside the row,
so nothing is shuffled.

``Knowledge`` keeps what pages brought as signed counts.  A delivery names pages
that are new, changed or gone; the counts that a page brought before are taken
back, and those of its new form are added.  Deliveries are written one after the
other and summed when edges are read, so a delivery costs its own size;
``compact`` sums them up once.  Weights hang on the number of pages, so edges are
weighed when they are read; a report tells which pairs a delivery made, changed
or removed.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import npmi, npmi_to_weight
from ..functions.text import ALTERNATIVE_CUES, REQUIREMENT_CUES, sentences, tokens
from ..sources.tables import dealt, scratch, written
from .graph import _among, pairs

#: Confidence below which only prose speaks for a term; share of domains beyond which such a term is glue; terms a page needs.
PROSE_ONLY, GLUE_BREADTH, FEWEST_TERMS = 0.6, 0.10, 2
MENTION = "struct<term:string,confidence:double,context:string,sentence:int>"


def _mentions(cut: Column, known: Column) -> Column:
    def of(sentence: Column, number: Column) -> Column:
        # the cue is looked for once in a sentence, not for each of its terms
        def found(confidence: float, context: str) -> Column:
            return F.transform(
                F.array_intersect(F.array_distinct(tokens(sentence)), known),
                lambda t: F.struct(t.alias("term"), F.lit(confidence).alias("confidence"), F.lit(context).alias("context"), number.alias("sentence")),
            )

        none = F.array().cast(f"array<{MENTION}>")
        cue = sentence.rlike(REQUIREMENT_CUES)
        return F.when(~F.length(sentence).between(8, 600), none).when(cue, found(0.6, "requirements-list")).otherwise(found(0.25, "prose"))

    return F.flatten(F.transform(cut, of))


def _choices(cut: Column, known: Column) -> Column:
    """Distinct pairs (a < b) of two to four terms in a sentence with a cue of choice."""

    def of(sentence: Column) -> Column:
        held = F.array_sort(F.array_intersect(F.array_distinct(tokens(sentence)), known))
        both = F.flatten(
            F.transform(held, lambda a, i: F.transform(F.slice(held, i + 2, F.size(held)), lambda b: F.struct(a.alias("a"), b.alias("b"))))
        )
        fits = F.length(sentence).between(8, 400) & sentence.rlike(ALTERNATIVE_CUES) & F.size(held).between(2, 4)
        return F.when(fits, both).otherwise(F.array().cast("array<struct<a:string,b:string>>"))

    return F.array_distinct(F.flatten(F.transform(cut, of)))


def records(pages: DataFrame, key: str, names: list[str]) -> DataFrame:
    """key, domain, mentions, alternatives, terms, skipped from ``pages`` (key, domain, text).

    ``terms``: the best mention of each term (highest confidence, then first sentence), sorted by term; ``skipped``: why the
    page teaches nothing, or null.  Pages without text are empty; a null domain is a domain of its own.

    Records are written: a filter on them would otherwise move below, where all that makes ``skipped`` and ``terms`` is spelled
    out again for each mention.
    """
    known = _among(names)
    cut = dealt(pages.select(key, "domain", "text")).select(key, "domain", sentences(F.coalesce("text", F.lit(""))).alias("s"))
    rows = cut.select(key, "domain", F.size(F.filter("s", lambda x: F.trim(x) != "")).alias("n"), _mentions(F.col("s"), known).alias("mentions"), _choices(F.col("s"), known).alias("alternatives"))
    by_term = F.array_sort(
        F.transform("mentions", lambda m: F.struct(m["term"].alias("term"), (-m["confidence"]).alias("last"), m["sentence"].alias("sentence"), m["context"].alias("context")))
    )
    rows = rows.withColumn("sorted", by_term)
    first = F.filter("sorted", lambda m, i: (i == 0) | ~F.get("sorted", i - 1)["term"].eqNullSafe(m["term"]))
    terms = F.transform(first, lambda m: F.struct(m["term"].alias("term"), (-m["last"]).alias("confidence"), m["context"].alias("context"), m["sentence"].alias("sentence")))
    rows = rows.withColumn("terms", terms)
    count = F.size("terms")
    skipped = F.when(F.col("n") == 0, "empty").when(count < FEWEST_TERMS, F.concat(F.lit("only "), count.cast("string"), F.lit(" terms")))
    return written(rows.select(key, "domain", "mentions", "alternatives", "terms", skipped.alias("skipped")), "records")


def glue(breadth: DataFrame, names: list[str]) -> list[str]:
    """Names on more domains than a term that only prose speaks for may have (``breadth``: term, breadth); names are a bounded list."""
    rows = breadth.where(F.col("term").isin(names) & (F.col("breadth") > GLUE_BREADTH)).select("term").collect() if names else []
    return sorted(r["term"] for r in rows)


def taught(rows: DataFrame, key: str, rejected: list[str]) -> DataFrame:
    """key, domain, held (sorted terms), alternatives: what pages that are not skipped teach, without glue."""
    bare = lambda m: (m["confidence"] < PROSE_ONLY) & ~m["term"].rlike("[-.]") & m["term"].isin(rejected)
    kept = F.filter("terms", lambda m: ~bare(m)) if rejected else F.col("terms")
    held = F.transform(kept, lambda m: m["term"])
    fine = lambda p: F.array_contains(held, p["a"]) & F.array_contains(held, p["b"])
    return rows.where("skipped is null").select(key, "domain", held.alias("held"), F.filter("alternatives", fine).alias("alternatives"))


@dataclass(frozen=True)
class Knowledge:
    """What deliveries of pages have brought so far, under ``root``; one folder per delivery."""

    spark: SparkSession
    root: str
    key: str
    deliveries: tuple[str, ...] = ()

    @classmethod
    def new(cls, spark: SparkSession, key: str, root: str | None = None) -> Knowledge:
        return cls(spark, root or scratch(spark, "knowledge"), key)

    def _path(self, delivery: str, part: str) -> str:
        return f"{self.root}/{delivery}/{part}"

    def _all(self, part: str) -> DataFrame:
        made = [self.spark.read.parquet(self._path(d, part)).withColumn("delivery", F.lit(i)) for i, d in enumerate(self.deliveries)]
        return reduce(DataFrame.unionByName, made)

    def pages(self) -> DataFrame:
        """key, domain, held, alternatives of all pages as they are now: the last form of each, without those that are gone."""
        order = F.struct("delivery", "domain", "held", "alternatives", "gone")
        last = self._all("pages").groupBy(self.key).agg(F.max_by(order, "delivery").alias("x"))
        return last.where("not x.gone").select(self.key, "x.domain", "x.held", "x.alternatives")

    def deliver(self, pages: DataFrame, gone: DataFrame | None = None) -> tuple[Knowledge, DataFrame]:
        """The state with ``pages`` (key, domain, held, alternatives; one row per key) and without the keys of ``gone``.

        Also the report: a, b, before, after of every pair whose count of pages changed.  A key that is both delivered and gone
        is gone.  A page that comes again as it was changes nothing; so does a key that was never there.
        """
        columns = [self.key, "domain", "held", "alternatives"]
        kind = {c: pages.schema[c].dataType for c in columns}
        new = pages.select(*columns)
        if gone is not None:
            lost = gone.select(self.key).distinct()
            empty = [F.lit(None).cast(kind[c]).alias(c) for c in columns[1:]]
            new = new.join(lost, self.key, "left_anti").withColumn("gone", F.lit(False)).unionByName(lost.select(self.key, *empty, F.lit(True).alias("gone")))
        else:
            new = new.withColumn("gone", F.lit(False))
        name = scratch(self.spark, "d").rsplit("/", 1)[1]
        new.write.parquet(self._path(name, "pages"))
        fresh = self.spark.read.parquet(self._path(name, "pages"))
        signed = fresh.where("not gone").select(*columns[1:], F.lit(1).alias("sign"))
        if self.deliveries:
            old = self.pages().join(fresh.select(self.key), self.key, "left_semi")
            signed = signed.unionByName(old.select(*columns[1:], F.lit(-1).alias("sign")))
        signed = written(signed, "signed")
        self._changes(signed, "held").write.parquet(self._path(name, "pairs"))
        choices = signed.select("sign", F.explode("alternatives").alias("p")).groupBy("p.a", "p.b").agg(F.sum("sign").alias("n"))
        choices.where("n <> 0").write.parquet(self._path(name, "choices"))
        terms = signed.select("sign", F.explode("held").alias("term")).groupBy("term").agg(F.sum("sign").alias("n"))
        terms.where("n <> 0").write.parquet(self._path(name, "terms"))
        signed.agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("n")).coalesce(1).write.parquet(self._path(name, "size"))
        after = replace(self, deliveries=(*self.deliveries, name))
        return after, self._report(after, name)

    def _changes(self, signed: DataFrame, held: str) -> DataFrame:
        """a, b, domain, n: signed counts of pages."""
        seen = pairs(signed, F.col(held), "domain", "sign")
        return seen.groupBy("a", "b", "domain").agg(F.sum("sign").alias("n")).where("n <> 0")

    def _report(self, after: Knowledge, name: str) -> DataFrame:
        change = self.spark.read.parquet(self._path(name, "pairs")).groupBy("a", "b").agg(F.sum("n").alias("change"))
        counts = after._all("pairs").join(change.select("a", "b"), ["a", "b"], "left_semi").groupBy("a", "b").agg(F.sum("n").alias("after"))
        told = change.join(counts, ["a", "b"]).select("a", "b", (F.col("after") - F.col("change")).alias("before"), "after")
        return told.where("before <> after")

    def compact(self) -> Knowledge:
        """All deliveries summed up as one."""
        name = scratch(self.spark, "d").rsplit("/", 1)[1]
        self.pages().withColumn("gone", F.lit(False)).write.parquet(self._path(name, "pages"))
        for part, by in (("pairs", ["a", "b", "domain"]), ("choices", ["a", "b"]), ("terms", ["term"]), ("size", [])):
            self._all(part).groupBy(*by).agg(F.sum("n").alias("n")).where("n <> 0" if by else "true").write.parquet(self._path(name, part))
        return replace(self, deliveries=(name,))

    def edges(self) -> DataFrame:
        """src, dst, npmi, weight, n_obs, n_domains, seeded, relation of all pairs that pages share now, in both directions."""
        by_domain = self._all("pairs").groupBy("a", "b", "domain").agg(F.sum("n").alias("n")).where("n > 0")
        both = by_domain.groupBy("a", "b").agg(F.sum("n").alias("both"), F.count("domain").alias("n_domains"))
        df = self._all("terms").groupBy("term").agg(F.sum("n").alias("df"))
        choices = self._all("choices").groupBy("a", "b").agg(F.sum("n").alias("offered")).where("offered > 0")
        n = self._all("size").agg(F.sum("n")).scalar()
        known = both.join(df.select(F.col("term").alias("a"), F.col("df").alias("df_a")), "a").join(
            df.select(F.col("term").alias("b"), F.col("df").alias("df_b")), "b"
        )
        known = known.join(choices, ["a", "b"], "left").withColumn("n", n)
        known = known.withColumn("npmi", npmi(F.col("n"), F.col("df_a"), F.col("df_b"), F.col("both")))
        ways = F.array(
            F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("df_b").alias("df_dst")),
            F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), F.col("df_a").alias("df_dst")),
        )
        out = known.withColumn("way", F.explode(ways))
        return out.select(
            "way.src",
            "way.dst",
            "npmi",
            npmi_to_weight(F.col("npmi"), F.col("way.df_dst"), F.col("n")).alias("weight"),
            F.col("both").alias("n_obs"),
            "n_domains",
            F.lit(0).alias("seeded"),
            F.when(F.col("offered").isNotNull(), "alternative").otherwise("together").alias("relation"),
        )
