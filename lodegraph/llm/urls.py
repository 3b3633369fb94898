"""URL filters: explicit rules first, then empirical-Bayes host reputation.

Labelled page outcomes are counted per host.  A host's good rate is shrunk to
its registered domain's, the domain's to its suffix's and the suffix's to the
rate of all pages, each through a beta-binomial prior whose strength comes from
the spread between siblings (method of moments).  A host is blocked when the
upper bound of its posterior rate stays below a threshold.

Only DataFrame functions run here.  Counts combine on the map side; pages meet
their host's posterior in a plain equi-join, which Spark broadcasts while the
host table is small and otherwise splits where a host is hot.

Defined cases: null urls and urls without ``://`` have an empty host and path;
they share the reputation of the empty host.  Hosts without labelled pages get
their domain's prior.  Null outcomes do not count.  Several outcomes of a page
all count.  No labelled page at all: a rate of 1/2 with no evidence, so nothing
is blocked by reputation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialise

#: Public suffixes of two labels that the reputation knows beside all suffixes of one label.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule as struct<rule, verdict>, or null; rules are (verdict, ``host/path``)."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda x: len(x[1])):
        of_host, _, of_path = rule.partition("/")
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith("/" + of_path)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def suffix_of(host: Column) -> Column:
    bare = F.regexp_replace(host, r"^.*@|:\d*$", "")
    two = F.substring_index(bare, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(bare, ".", -1))


def domain_of(host: Column) -> Column:
    bare = F.regexp_replace(host, r"^.*@|:\d*$", "")
    two = F.substring_index(bare, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(bare, ".", -3)).otherwise(two)


def _shrunk(level: DataFrame) -> DataFrame:
    """Adds a and b, the posterior of each row, given n, k and the prior mean; one strength for the whole level."""
    p = F.col("prior")
    moments = level.agg(
        F.sum(F.pow(F.col("k") - F.col("n") * p, 2)).alias("spread"),
        F.sum(F.col("n") * p * (1 - p)).alias("binomial"),
        F.sum(F.col("n") * (F.col("n") - 1) * p * (1 - p)).alias("pairs"),
    ).first()
    excess = (moments["spread"] - moments["binomial"]) / moments["pairs"] if moments["pairs"] else 0.0
    strength = 1.0 / min(max(excess, 0.001), 0.5) - 1.0
    return level.withColumn("a", F.lit(strength) * p + F.col("k")).withColumn(
        "b", F.lit(strength) * (1 - p) + F.col("n") - F.col("k")
    )


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """host, n, k, rate, deviation from ``outcomes`` (host, good 0/1/null): one row per host."""
    hosts = materialise(
        outcomes.groupBy("host").agg(
            F.count("good").cast("double").alias("n"),
            F.coalesce(F.sum(F.col("good").cast("double")), F.lit(0.0)).alias("k"),
        ),
        "hosts",
    ).select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "k")
    totals = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    whole = hosts.agg(*totals).first()
    everyone = ((whole["k"] or 0.0) + 1.0) / ((whole["n"] or 0.0) + 2.0)
    mean = F.col("a") / (F.col("a") + F.col("b"))
    suffixes = _shrunk(hosts.groupBy("suffix").agg(*totals).withColumn("prior", F.lit(everyone)))
    domains = hosts.groupBy("domain", "suffix").agg(*totals)
    domains = _shrunk(domains.join(suffixes.select("suffix", mean.alias("prior")), "suffix"))
    final = _shrunk(hosts.join(domains.select("domain", "suffix", mean.alias("prior")), ["domain", "suffix"]))
    total = F.col("a") + F.col("b")
    return final.select(
        "host",
        "n",
        "k",
        mean.alias("rate"),
        F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1))).alias("deviation"),
    )


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: list[tuple[str, str]],
    least_rate: float = 0.5,
    z: float = 1.645,
) -> DataFrame:
    """page_id, host, path, rule, verdict, rate, upper for each row of ``pages`` (page_id, url).

    ``outcomes``: page_id, good (0/1).  A page whose url fits a rule takes the
    rule's verdict; another is blocked if ``rate + z * deviation`` of its host
    is below ``least_rate``.
    """
    host, path = host_and_path(F.col("url"))
    placed = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = outcomes.where(F.col("good").isNotNull() & F.col("page_id").isNotNull()).select("page_id", "good")
    seen = placed.select("page_id", "host").join(known, "page_id", "left").select("host", "good")
    hosts = materialise(host_reputation(seen), "reputation").select(
        "host", "rate", (F.col("rate") + F.lit(z) * F.col("deviation")).alias("upper")
    )
    ruled = placed.withColumn("found", matching_rule(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("upper") < F.lit(least_rate), F.lit("block")).otherwise(F.lit("allow"))
    return ruled.join(hosts, "host", "left").select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), own).alias("verdict"),
        "rate",
        "upper",
    )
