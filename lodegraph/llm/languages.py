"""Language identification by rank-order profiles.

A language's profile is its most frequent n-grams (one to three characters of
lower-cased words, words padded by a blank) in order of frequency.  A document
is compared with each profile by the out-of-place distance: for each of its own
most frequent n-grams, how far its rank is from the rank in the profile, or the
profile's size where it is not there.

N-grams are counted inside the tasks over all training texts, summed by Spark
per (language, n-gram), and each profile is a top-k.  What is sent to the tasks
at once are the profiles of ``LANGUAGES`` languages at most, each of ``size``
n-grams; with more languages the texts pass several blocks, and the least
distances so far travel with them.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
rows without a language never train; equally frequent n-grams are ranked by their
code points, in profiles and documents alike; equal distances go to the language
that comes first by code point; repeated rows count, and are judged, each;
without training rows everything is ``und``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, materialise

UNKNOWN = "und"
#: Languages whose profiles a task holds at once (some 10 MB).
LANGUAGES = 2_000
#: A map task hands on its counts when it holds this many different n-grams.
HELD = 400_000


class Letters:
    """Lower-cased letters by code point; 0 for everything that is no letter."""

    def __init__(self):
        self.table = np.full(0x110000, -1, dtype=np.int64)  # filled with what texts hold

    def of(self, text: bytes) -> np.ndarray:
        points = np.frombuffer(text.decode().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        out = self.table[points]
        if (out < 0).any():
            for c in np.unique(points[out < 0]).tolist():
                low = chr(c).lower()
                self.table[c] = 0 if not chr(c).isalpha() else ord(low) if len(low) == 1 else c
            out = self.table[points]
        return out


def grams(letters: np.ndarray) -> np.ndarray:
    """Keys of all n-grams of a text: three 21-bit code points, 1 for the blank around words."""
    padded = np.concatenate([[0], letters, [0]])
    keep = (padded != 0) | (np.concatenate([[1], padded[:-1]]) != 0)
    c = padded[keep]
    c = np.where(c == 0, 1, c)
    one = c[c != 1]
    two = c[:-1] << 21 | c[1:]
    three = c[:-2] << 42 | c[1:-1] << 21 | c[2:]
    inner = c[1:-1] != 1  # a blank stands at the rim only
    return np.concatenate([one, two, three[inner]])


def _counter():
    def run(batches):
        letters, held = Letters(), {}

        def flush():
            for lang, (keys, counts) in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys)), pa.array(keys), pa.array(counts)], ["lang", "gram", "n"]
                )
            held.clear()

        def add(lang, keys, counts):
            if lang in held:
                keys, counts = np.concatenate([held[lang][0], keys]), np.concatenate([held[lang][1], counts])
            keys, where = np.unique(keys, return_inverse=True)
            held[lang] = keys, np.bincount(where, counts, len(keys)).astype(np.int64)

        for batch, texts in chunks(batches):
            langs = batch.column("lang").to_pylist()
            for lang in sorted(set(langs)):
                parts = [grams(letters.of(t)) for t, x in zip(texts, langs, strict=True) if x == lang and t]
                if parts:
                    add(lang, *np.unique(np.concatenate(parts), return_counts=True))
            if sum(len(k) for k, _ in held.values()) > HELD:
                yield from flush()
        yield from flush()

    return run


def profiles(docs: DataFrame, size: int = 400) -> DataFrame:
    """lang, gram (key), rank (from 0): the ``size`` most frequent n-grams of each language of ``docs`` (text, lang)."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    counted = rows.mapInArrow(_counter(), "lang string, gram long, n long")
    total = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    ranked = total.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size)
    return ranked.select("lang", "gram", (F.col("place") - 1).alias("rank"))


class Ranker:
    """Out-of-place distances to a block of profiles, from the languages and ranks of each n-gram that some profile has."""

    def __init__(self, block: dict):
        self.size, self.langs = block["size"], block["langs"]
        order = np.argsort(block["grams"], kind="stable")
        self.owners, self.ranks = block["owners"][order], block["ranks"][order]
        self.keys, self.begins, self.counts = np.unique(block["grams"][order], return_index=True, return_counts=True)

    def distances(self, top: np.ndarray) -> np.ndarray:
        """For each language, the sum over ``top`` of how far the ranks are apart; ``size`` for what a profile lacks."""
        out = np.full(len(self.langs), self.size * len(top), dtype=np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, top), len(self.keys) - 1)
            held = np.flatnonzero(self.keys[at] == top)
            counts = self.counts[at[held]]
            places = np.repeat(held, counts)
            inside = np.arange(len(places)) - np.repeat(np.cumsum(counts) - counts, counts)
            entry = np.repeat(self.begins[at[held]], counts) + inside
            near = self.size - np.abs(self.ranks[entry] - places)
            out -= np.bincount(self.owners[entry], near, len(self.langs)).astype(np.int64)
        return out


def most_frequent(letters: np.ndarray, size: int) -> np.ndarray:
    keys, counts = np.unique(grams(letters), return_counts=True)
    return keys[np.argsort(-counts, kind="stable")[:size]]


def _predictor(shared, keep: list[str], first: bool):
    def run(batches):
        letters, ranker = Letters(), Ranker(shared.value)
        for batch, texts in chunks(batches):
            found = batch.column("_best").to_pylist() if not first else [None] * len(texts)
            for i, text in enumerate(texts):
                own = letters.of(text)
                if not own.any():
                    continue
                top = most_frequent(own, ranker.size)
                distance = ranker.distances(top)
                best = int(np.argmin(distance))
                rest = np.delete(distance, best)
                new = {
                    "lang": ranker.langs[best], "near": int(distance[best]),
                    "next": int(rest.min()) if len(rest) else None, "most": ranker.size * len(top),
                }
                found[i] = new if found[i] is None else _nearer(found[i], new)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(found, BEST)], [*keep, "_best"])

    return run


def _nearer(old: dict, new: dict) -> dict:
    """The least and the second least distance of both; ties stay with ``old``, whose languages come first."""
    win, lose = (new, old) if new["near"] < old["near"] else (old, new)
    others = [x for x in (win["next"], lose["near"]) if x is not None]
    return {**win, "next": min(others)}


BEST = pa.struct([("lang", pa.string()), ("near", pa.int64()), ("next", pa.int64()), ("most", pa.int64())])
BEST_TYPE = T.StructType(
    [T.StructField("lang", T.StringType()), *[T.StructField(x, T.LongType()) for x in ("near", "next", "most")]]
)


def predict(docs: DataFrame, profile: DataFrame, keep: list[str], size: int = 400) -> DataFrame:
    """Columns ``keep`` of ``docs`` (text, ...) with lang_pred and score (0 to 1: how far the runner-up is)."""
    spark = docs.sparkSession
    rows = materialise(profile, "profiles")
    numbered = rows.select("lang").distinct().withColumn("number", F.row_number().over(Window.orderBy("lang")) - 1)
    numbered = materialise(numbered, "languages")
    n_blocks = max(1, -(-numbered.count() // LANGUAGES))
    through = list(dict.fromkeys([*keep, "text"]))
    out = docs.select(*through)
    schema = T.StructType([*[docs.schema[c] for c in through], T.StructField("_best", BEST_TYPE)])
    for block in range(n_blocks):
        own = numbered.where(F.floor(F.col("number") / LANGUAGES) == block)
        langs = [r["lang"] for r in own.orderBy("number").collect()]
        held = rows.join(own, "lang").select("gram", "rank", (F.col("number") - block * LANGUAGES).alias("owner")).toPandas()
        model = {
            "langs": langs,
            "size": size,
            "grams": held["gram"].to_numpy(dtype=np.int64),
            "ranks": held["rank"].to_numpy(dtype=np.int64),
            "owners": held["owner"].to_numpy(dtype=np.int64),
        }
        if not langs:
            break
        out = out.mapInArrow(_predictor(spark.sparkContext.broadcast(model), through, block == 0), schema)
        if n_blocks > 1:  # one block's workers at a time
            out = materialise(out, "nearest")
    if "_best" not in out.columns:
        out = out.withColumn("_best", F.lit(None).cast(BEST_TYPE))
    near, following, most = (F.col("_best")[x] for x in ("near", "next", "most"))
    score = F.when(following.isNull(), 1 - near / most).when(following > 0, (following - near) / following).otherwise(0.0)
    return out.select(
        *keep,
        F.coalesce(F.col("_best.lang"), F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(F.col("_best").isNull(), 0.0).otherwise(score).cast("double").alias("score"),
    )
