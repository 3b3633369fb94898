"""Quality rules by robust multivariate outliers.

Every text gets a few counts; their transformed rates form a vector.  Per
language and source a minimum-covariance-determinant estimate describes the bulk
of the vectors, and a document is rejected when its squared Mahalanobis distance
exceeds a chi-square cut-off.

The estimate is the one of least determinant over several deterministic starts:
medians with median deviations, the spatial signs, the correlation of tanh
values, and the plain moments.  All starts take two concentration steps, the best
``FINALISTS`` of each group go on until no determinant falls any more, and the
best is kept.  A last step takes the h-subset exactly.  The subset's covariance is
made consistent for its share h of normal data.

The estimates use every document that passes the base rules.  A concentration
step is one Spark aggregate: each task bins its rows' distances per group (bins
of ``1/BINS`` in log2) and hands on counts and moments per bin, so a group with
a third of all rows costs no more than any other; the bin that the h-th smallest
distance falls into counts by the share of its rows that is needed.  The last,
exact step ranks only the rows of one bin of ``1/FINE``.  Groups below
``least_rows`` pool with the small groups of their language, and what is still
small pools into one group.

Rates are shrunk towards zero by a pseudo-count of words, so that short texts
are not outliers by noise alone, and each variance has a floor, so that a
statistic that is zero in most documents cannot make the estimate singular (the
regularised form of the estimator).

Defined cases: null texts have no words and fail the base rules; null language
or source is a group of its own; with fewer than ``least_rows`` rows in the last
pool there is no estimate and the base rules alone decide; rows as far away as
the h-th (ties) all belong to the subset, and rows at the cut-off are kept; equal
determinants go to the start that comes first; repeated rows count each.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, materialise

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The transformed statistics, in order.
STATISTICS = ("symbols", "upper", "digits", "dup_lines", "repeats", "punctuation", "word_length")
WIDTH = len(STATISTICS)
#: Pseudo-words of the shrunk rates, and the least standard deviation of each statistic.
PRIOR_WORDS = 50.0
FLOORS = (0.04, 0.06, 0.05, 0.10, 0.10, 0.05, 0.06)
#: Bins of squared distances per factor of two: of moments, and of counts in the last step.
BINS, FINE = 4, 4096
#: Starts by name; those of each group that go on after two steps; the most steps that these take.
STARTS, FINALISTS, MOST_STEPS = ("median", "signs", "tanh", "moments"), 2, 30
#: Tables with a row per group are written to so many files.
FILES = 8
#: Estimates up to this number (10 MB) are broadcast to the tasks; more are joined to the rows.
MOST_BROADCAST = 20_000

_CONTINUED = bytes(range(0x80, 0xC0))
_SYMBOL_BYTES = b"#*$%&|<>"
_NO_SYMBOLS = bytes(c for c in range(256) if c not in _SYMBOL_BYTES)
_UPPER = bytes(range(65, 91))
_NO_UPPER = bytes(c for c in range(256) if c not in _UPPER)
_NO_DIGITS = bytes(c for c in range(256) if not 48 <= c <= 57)
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in _SYMBOL_BYTES)
_NO_PUNCTUATION = bytes(c for c in range(256) if c not in _PUNCTUATION)


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    if len(number) == n:
        return 0
    pairs = ids[:-1] * n + ids[1:]  # below n * n, so exact; numbered again to make room for the third word
    _, pair = np.unique(pairs, return_inverse=True)
    keys = pair[:-1] * n + ids[2:]
    _, where, counts = np.unique(keys, return_inverse=True, return_counts=True)
    twice = counts[where] > 1
    covered = np.zeros(n, dtype=bool)
    for i in range(3):
        covered[i : n - 2 + i] |= twice
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(lines) < 2:
        return 0
    worded = [x for x in lines if x and x.split()]
    return len(worded) - len(set(worded))


def statistics(text: bytes) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The counts of a text and its vector."""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined.translate(None, _CONTINUED))
    symbols = len(text.translate(None, _NO_SYMBOLS))
    duplicates, repeats = duplicate_lines(text), repeated_words(words)
    upper, digits = len(joined.translate(None, _NO_UPPER)), len(joined.translate(None, _NO_DIGITS))
    marks = len(joined.translate(None, _NO_PUNCTUATION))
    lines = text.count(b"\n") + 1
    base, prior_chars = n + PRIOR_WORDS, chars + 6 * PRIOR_WORDS
    vector = (
        np.sqrt(symbols / prior_chars),
        np.sqrt(upper / prior_chars),
        np.sqrt(digits / prior_chars),
        np.sqrt(duplicates / (lines + 10.0)),
        np.sqrt(repeats / base),
        np.sqrt(marks / prior_chars),
        np.log((chars + 6 * PRIOR_WORDS) / base),
    )
    return (n, chars, symbols, duplicates, repeats), vector


def _measurer(keep: list[str]):
    def run(batches):
        for batch, texts in chunks(batches):
            rows = [statistics(t) for t in texts]
            counts = np.array([c for c, _ in rows], dtype=np.int64).reshape(-1, len(COUNTS))
            vectors = np.array([v for _, v in rows], dtype=np.float64).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep]
                + [pa.array(counts[:, i]) for i in range(len(COUNTS))]
                + [pa.FixedSizeListArray.from_arrays(pa.array(vectors.ravel()), WIDTH).cast(pa.list_(pa.float64()))],
                [*keep, *COUNTS, "vector"],
            )

    return run


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` (text, ...) with the counts, vector and base_failed."""
    fields = ", ".join(f"{c} long" for c in COUNTS)
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    measured = docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(
        _measurer(keep), f"{kept}, {fields}, vector array<double>"
    )
    return measured.withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    )


def grouped(measured: DataFrame, least_rows: int = 60) -> DataFrame:
    """Adds ``pool``: the group whose estimate judges the row."""
    good = measured.where(~F.col("base_failed"))
    sizes = good.groupBy("lang", "source").agg(F.count("*").alias("rows"))
    sizes = materialise(sizes, "pool-sizes", FILES)
    own = F.concat_ws("\x01", F.lit("own"), *[F.coalesce(c, F.lit("\x02")) for c in (F.col("lang"), F.col("source"))])
    of_lang = F.concat_ws("\x01", F.lit("lang"), F.coalesce(F.col("lang"), F.lit("\x02")))
    rest = (
        sizes.where(F.col("rows") < least_rows)
        .groupBy(F.col("lang").alias("small_lang"))
        .agg(F.sum("rows").alias("pooled"))
    )
    pools = sizes.join(rest, F.col("lang").eqNullSafe(F.col("small_lang")), "left").select(
        F.col("lang").alias("of_lang"),
        F.col("source").alias("of_source"),
        F.when(F.col("rows") >= least_rows, own)
        .when(F.col("pooled") >= least_rows, of_lang)
        .otherwise(F.lit("rest"))
        .alias("pool"),
    )
    same = F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source"))
    return measured.join(materialise(pools, "pools", FILES), same, "left").drop("of_lang", "of_source")


_UPPER_HALF = np.triu_indices(WIDTH)
MOMENTS = 1 + WIDTH + len(_UPPER_HALF[0])


def chi_square(x: float, freedom: int) -> float:
    """The distribution function (the series of the incomplete gamma function)."""
    if x <= 0:
        return 0.0
    a, half = freedom / 2, x / 2
    term = total = math.exp(a * math.log(half) - half - math.lgamma(a + 1))
    n = 0
    while term > 1e-17 * total:
        n += 1
        term *= half / (a + n)
        total += term
    return min(total, 1.0)


def chi_square_quantile(p: float, freedom: int) -> float:
    low, high = 0.0, 10.0 * freedom + 100.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, freedom) < p else (low, middle)
    return low


def consistency(h: float) -> float:
    """What the covariance of the inner share h of normal data must be multiplied by."""
    return h / chi_square(chi_square_quantile(h, WIDTH), WIDTH + 2) if h < 1 else 1.0


def _sums(vectors: np.ndarray) -> np.ndarray:
    """Count, sums and sums of products of the rows."""
    products = vectors.T @ vectors
    return np.concatenate([[len(vectors)], vectors.sum(axis=0), products[_UPPER_HALF]])


def _mean_and_covariance(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = sums[1 : WIDTH + 1] / sums[0]
    second = np.zeros((WIDTH, WIDTH))
    second[_UPPER_HALF] = sums[WIDTH + 1 :] / sums[0]
    second += np.triu(second, 1).T
    return mean, second - np.outer(mean, mean)


def _regularised(covariance: np.ndarray, h: float) -> np.ndarray:
    return consistency(h) * covariance + np.diag(np.square(FLOORS))


def _groups(batch: pa.RecordBatch):
    """Pools of a batch with their vectors."""
    pools = batch.column("pool").dictionary_encode()
    number = pools.indices.to_numpy()
    vectors = batch.column("vector").flatten().to_numpy().reshape(-1, WIDTH)
    for i, pool in enumerate(pools.dictionary.to_pylist()):
        yield pool, vectors[number == i]


def _frame(held: dict) -> pa.RecordBatch:
    keys = sorted(held)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k in keys], pa.string()),
            pa.array([k[1] for k in keys], pa.string()),
            pa.array([k[2] for k in keys], pa.int32()),
            pa.array([np.atleast_1d(held[k]) for k in keys], pa.list_(pa.float64())),
        ],
        ["pool", "start", "bin", "moments"],
    )


BINNED = "pool string, start string, bin int, moments array<double>"
MODEL = "pool string, start string, rows double, logdet double, center array<double>, inverse array<double>"


def _histograms(batches):
    """Per pool and statistic: rows by value, in quarters of the statistic's floor (as ``start``: its number)."""
    held: dict = {}
    for batch in batches:
        for pool, vectors in _groups(batch):
            for i in range(WIDTH):
                values, counts = np.unique(np.floor(vectors[:, i] / FLOORS[i] * 4).astype(int), return_counts=True)
                for value, n in zip(values.tolist(), counts.tolist(), strict=True):
                    key = (pool, str(i), value)
                    held[key] = held.get(key, 0.0) + n
    if held:
        yield _frame(held)


def _middle(values: np.ndarray, counts: np.ndarray) -> float:
    order = np.argsort(values)
    upto = np.cumsum(counts[order])
    return float(values[order][np.searchsorted(upto, upto[-1] / 2)])


def _medians(pdf: pd.DataFrame) -> pd.DataFrame:
    """The first start: medians, and median deviations as scales (the floor at least)."""
    center, scale = np.zeros(WIDTH), np.zeros(WIDTH)
    for i in range(WIDTH):
        own = pdf[pdf["start"] == str(i)]
        values, counts = (own["bin"].to_numpy() + 0.5) / 4 * FLOORS[i], np.array([m[0] for m in own["moments"]])
        center[i] = _middle(values, counts)
        scale[i] = max(1.4826 * _middle(np.abs(values - center[i]), counts), FLOORS[i])
    rows = float(sum(m[0] for m in pdf["moments"][pdf["start"] == "0"]))
    return _model_row(pdf["pool"].iloc[0], "median", rows, np.inf, center, np.diag(1 / np.square(scale)))


def _model_row(pool, start, rows, logdet, center, inverse) -> pd.DataFrame:
    return pd.DataFrame(
        {"pool": [pool], "start": [start], "rows": [rows], "logdet": [logdet], "center": [center.tolist()], "inverse": [inverse.ravel().tolist()]}
    )


def _transforms(models: dict, batch: pa.RecordBatch, held: dict) -> None:
    """Moments of the standardised rows: plain, as spatial signs, and as tanh values."""
    for pool, vectors in _groups(batch):
        for _, center, inverse in models.get(pool, ()):
            z = (vectors - center) * np.sqrt(np.diag(inverse))
            length = np.linalg.norm(z, axis=1, keepdims=True)
            for start, values in (("moments", z), ("signs", z / np.maximum(length, 1e-12)), ("tanh", np.tanh(z))):
                key = (pool, start, 0)
                held[key] = held.get(key, 0.0) + _sums(values)


def _distances(models: dict, batch: pa.RecordBatch, held: dict) -> None:
    """Moments of the rows per start and bin of the squared distance."""
    for pool, vectors in _groups(batch):
        for start, center, inverse in models.get(pool, ()):
            off = vectors - center
            d2 = np.einsum("ij,ij->i", off @ inverse, off)
            at = np.floor(np.log2(np.maximum(d2, 1e-30)) * BINS).astype(int)
            for value in np.unique(at).tolist():
                key = (pool, start, value)
                held[key] = held.get(key, 0.0) + _sums(vectors[at == value])


def _starts(pdf: pd.DataFrame) -> pd.DataFrame:
    """The other starts of a pool, given the first one's center and scale."""
    out = []
    for row in pdf.to_dict("records"):
        scale = np.diag(1 / np.sqrt(np.diag(np.reshape(row["inverse"], (WIDTH, WIDTH)))))
        mean, covariance = _mean_and_covariance(np.array(row["moments"]))
        if row["start"] != "moments":  # of scatters about the median only the shape counts
            covariance = (covariance + np.outer(mean, mean)) * WIDTH
            mean = np.zeros(WIDTH)
        spread = scale @ covariance @ scale + np.diag(np.square(FLOORS))
        center = np.array(row["center"]) + scale @ mean
        out.append(_model_row(row["pool"], row["start"], row["rows"], np.inf, center, np.linalg.inv(spread)))
    return pd.concat(out)


def _concentrated(h: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        moments = np.stack(pdf["moments"].to_numpy())
        upto = np.cumsum(moments[:, 0])
        need = h * upto[-1]
        last = int(np.searchsorted(upto, need - 1e-9))
        before = upto[last] - moments[last, 0]
        used = moments[:last].sum(axis=0) + moments[last] * (need - before) / moments[last, 0]
        center, covariance = _mean_and_covariance(used)
        spread = _regularised(covariance, h)
        logdet = float(np.linalg.slogdet(spread)[1])
        return _model_row(pdf["pool"].iloc[0], pdf["start"].iloc[0], float(upto[-1]), logdet, center, np.linalg.inv(spread))

    return run


def _by_pool(rows: list) -> dict:
    models: dict = {}
    for r in rows:
        inverse = np.reshape(r["inverse"], (WIDTH, WIDTH))
        models.setdefault(r["pool"], []).append((r["start"], np.array(r["center"]), inverse))
    return models


def _summed(rows: DataFrame, model: DataFrame, measure) -> DataFrame:
    """pool, start, bin, moments of ``rows`` (pool, vector) under the estimates of ``model``, added up over all tasks."""
    narrow = model.select("pool", "start", "center", "inverse")
    if narrow.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        shared = rows.sparkSession.sparkContext.broadcast(_by_pool(narrow.collect()))

        def run(batches):
            held: dict = {}
            for batch in batches:
                measure(shared.value, batch, held)
            if held:
                yield _frame(held)

        binned = rows.select("pool", "vector").mapInArrow(run, BINNED)
    else:

        def run_joined(batches):
            held: dict = {}
            for batch in batches:
                for own in {(r["pool"], r["start"]): r for r in batch.select(["pool", "start", "center", "inverse"]).to_pylist()}.values():
                    same = pa.compute.and_(
                        pa.compute.equal(batch.column("pool"), own["pool"]), pa.compute.equal(batch.column("start"), own["start"])
                    )
                    measure(_by_pool([own]), batch.filter(same), held)
            if held:
                yield _frame(held)

        binned = rows.select("pool", "vector").join(narrow, "pool").mapInArrow(run_joined, BINNED)
    return _added(binned, MOMENTS)


def _added(binned: DataFrame, width: int) -> DataFrame:
    parts = [F.sum(F.get("moments", F.lit(i))).alias(f"m{i}") for i in range(width)]
    return binned.groupBy("pool", "start", "bin").agg(*parts).select(
        "pool", "start", "bin", F.array(*[F.col(f"m{i}") for i in range(width)]).alias("moments")
    )


def _step(rows: DataFrame, model: DataFrame, h: float, name: str) -> DataFrame:
    binned = _summed(rows, model, _distances)
    return materialise(binned.groupBy("pool", "start").applyInPandas(_concentrated(h), MODEL), name, FILES)


def _best(model: DataFrame, most: int) -> DataFrame:
    """The ``most`` estimates of least determinant per pool."""
    names = F.array(*[F.lit(x) for x in STARTS])
    order = Window.partitionBy("pool").orderBy("logdet", F.array_position(names, F.col("start")))
    return model.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")


def squared_distance(vector: Column, center: Column, inverse: Column) -> Column:
    off = F.zip_with(vector, center, lambda x, c: x - c)
    row = lambda i: F.slice(inverse, i * WIDTH + 1, F.lit(WIDTH))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    return dot(off, F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda i: dot(row(i), off)))


def _exact_step(rows: DataFrame, model: DataFrame, h: float) -> DataFrame:
    """One concentration step whose subset is exact: the rows no farther than the h-th smallest distance."""
    known = model.select("pool", "center", "inverse")
    d2 = squared_distance(F.col("vector"), F.col("center"), F.col("inverse"))
    far = rows.select("pool", "vector").join(known, "pool").select("pool", "vector", d2.alias("d2"))
    bin_ = F.floor(F.log2(F.greatest(F.col("d2"), F.lit(1e-30))) * FINE).alias("bin")
    counts = far.groupBy("pool", bin_).agg(F.count("*").alias("n"))
    upto = Window.partitionBy("pool").orderBy("bin")
    counts = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy("pool")))
    need = F.greatest(F.lit(1), F.ceil(F.col("all") * F.lit(h)))
    held = counts.where((F.col("upto") >= need) & (F.col("upto") - F.col("n") < need)).select(
        "pool", F.col("bin").alias("at"), (need - F.col("upto") + F.col("n")).alias("place")
    )
    held = materialise(held, "last-bin", FILES)
    near = far.withColumn("bin", bin_).join(held, "pool").where("bin = at")
    rank = F.row_number().over(Window.partitionBy("pool").orderBy("d2"))
    last = near.withColumn("rank", rank).where("rank = place").select("pool", F.col("d2").alias("last"))
    subset = far.join(materialise(last, "last-distance", FILES), "pool").where("d2 <= last")
    products = [F.col("vector")[i] * F.col("vector")[j] for i, j in zip(*_UPPER_HALF, strict=True)]
    values = [F.lit(1.0), *[F.col("vector")[i] for i in range(WIDTH)], *products]
    total = subset.groupBy("pool").agg(F.array(*[F.sum(v) for v in values]).alias("moments"))
    sizes = model.select("pool", "start", "rows")

    def finish(batches):
        for pdf in batches:
            for pool, start, rows_, moments in zip(*[pdf[c] for c in ("pool", "start", "rows", "moments")], strict=True):
                center, covariance = _mean_and_covariance(np.array(moments))
                spread = _regularised(covariance, h)
                yield _model_row(pool, start, rows_, float(np.linalg.slogdet(spread)[1]), center, np.linalg.inv(spread))

    return total.join(sizes, "pool").mapInPandas(finish, MODEL)


def estimate(pooled: DataFrame, h: float = 0.75, most_steps: int = MOST_STEPS) -> DataFrame:
    """pool, start, rows, logdet, center, inverse: the estimate of each pool of ``pooled`` (pool, vector, base_failed).

    ``h``: the share of rows in the subset.  ``most_steps``: a bound on steps, far above what determinants need to settle.
    """
    rows = pooled.where(~F.col("base_failed") & F.col("pool").isNotNull()).select("pool", "vector")
    counts = _added(rows.mapInArrow(_histograms, BINNED), 1)
    first = materialise(counts.groupBy("pool").applyInPandas(_medians, MODEL), "medians", FILES)
    moments = _summed(rows, first, _transforms).join(first.select("pool", "rows", "center", "inverse"), "pool")
    others = materialise(moments.groupBy("pool").applyInPandas(_starts, MODEL), "starts", FILES)
    model = first.unionByName(others)
    for _ in range(2):
        model = _step(rows, model, h, "estimates")
    model = _best(model, FINALISTS)
    for _ in range(most_steps):
        after = _step(rows, model, h, "estimates")
        old = model.select("pool", "start", F.col("logdet").alias("old"))
        falls = after.join(old, ["pool", "start"]).where("logdet < old - 1e-4")
        model = after
        if falls.isEmpty():
            break
    return materialise(_exact_step(rows, materialise(_best(model, 1), "best", FILES), h), "estimate", FILES)


def judge(docs: DataFrame, cut: float = 29.9, h: float = 0.75, least_rows: int = 60) -> DataFrame:
    """doc_id, the counts, base_failed, distance (squared, null without an estimate) and kept.

    ``cut``: the chi-square quantile 0.9999 for the seven statistics.

    ``docs``: doc_id, text, lang, source.
    """
    measured = materialise(measure(docs, ["doc_id", "lang", "source"]), "measured")
    pooled = grouped(measured, least_rows)
    model = estimate(pooled, h).where(F.col("rows") >= least_rows).select("pool", "center", "inverse")
    judged = pooled.join(model, "pool", "left").withColumn(
        "distance",
        F.when(F.col("center").isNotNull(), squared_distance(F.col("vector"), F.col("center"), F.col("inverse"))),
    )
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= F.lit(cut))
    return judged.select("doc_id", *COUNTS, "base_failed", "distance", kept.alias("kept"))
