"""Benchmark decontamination by winnowing.

Every text is cut into words, every run of k words has a hash, and of each
``window - k + 1`` consecutive hashes the smallest is kept.  Two texts that
share ``window`` consecutive words therefore share a kept hash.  Kept document
hashes are joined with the kept benchmark hashes; a hit is extended word by
word to every window of the document that holds it, and a window counts when
its words are a benchmark window.  Benchmark texts shorter than the window are
one window each and are looked up by runs of exactly their length.

Items count once per id and text.  A benchmark of at most ``block_bytes`` is
broadcast, and the documents pass it in one narrow map.  A larger one is never
gathered: tasks make the kept hashes and the windows behind them of both sides,
and Spark joins them, first each document's distinct hashes with the
benchmark's, then the windows around the hits.  The documents' side of each join
is salted by row, so a passage that very many documents hold is dealt over tasks,
and no task holds more than a chunk of texts or one document's hits.

Defined cases: null texts have no words; a document without words has no hits;
items without id or words match nothing; repeated items count once; documents
repeated are scored each.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM_TABLE, WordHashes, chunks, materialise

SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField(
            "spans",
            T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])),
        ),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
NONE = np.iinfo(np.uint64).max
#: A document's rows of a join go to one of so many places per key.
SALTS = 8


def words_of(text: bytes) -> list[bytes]:
    return text.translate(ALNUM_TABLE).split()


def gram_hashes(hashes: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place; NONE where fewer than k are left before the text's end."""
    out = np.full(len(hashes), NONE, dtype=np.uint64)
    n = len(hashes) - k + 1
    if n > 0:
        total = np.zeros(n, dtype=np.uint64)
        for i in range(k):
            total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n + i]
        total ^= total >> np.uint64(29)
        out[:n] = np.where(np.arange(n) + k <= ends[:n], total, NONE)
    return out


def winnowed(grams: np.ndarray, w: int) -> np.ndarray:
    """True where a hash is the smallest of some w consecutive ones (ties: each of them)."""
    n = len(grams)
    least = np.concatenate([grams, np.full(w, NONE, dtype=np.uint64)])
    windows = least[:n].copy()
    for i in range(1, w):
        np.minimum(windows, least[i : n + i], out=windows)
    before = np.concatenate([np.zeros(w, dtype=np.uint64), windows])
    best = windows.copy()
    for i in range(1, w):
        np.maximum(best, before[w - i : w - i + n], out=best)
    return (grams == best) & (grams != NONE)


def window_key(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def build_block(items: list[tuple[str, bytes]], k: int, window: int) -> dict:
    """What a task needs of a block of items: kept hashes and the windows behind them."""
    names, windows, kept, short = [], {}, [], {}
    memo = WordHashes()
    for name, text in items:
        words = words_of(text)
        if not words:
            continue
        at, size = len(names), min(window, len(words))
        names.append(name)
        for start in range(len(words) - size + 1):
            windows.setdefault(window_key(words[start : start + size]), set()).add(at)
        hashes = memo.of(words)
        ends = np.full(len(words), len(words))
        if len(words) >= window:
            grams = gram_hashes(hashes, ends, k)
            kept.append(grams[winnowed(grams, window - k + 1)])
        else:
            short.setdefault(size, []).append(gram_hashes(hashes, ends, size)[:1])
    looked = {n: np.unique(np.concatenate(v)) for n, v in short.items()}
    if kept:
        looked[window] = np.unique(np.concatenate(kept))
    return {"names": names, "windows": windows, "looked": looked}


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def scan(texts: list[bytes], block: dict, k: int, window: int, memo: WordHashes):
    """Word counts, and by document its hit window spans and items (only documents with hits)."""
    lists = [words_of(t) for t in texts]
    lengths = np.array([len(x) for x in lists], dtype=np.int64)
    stops = np.cumsum(lengths)
    words = list(chain.from_iterable(lists))
    del lists
    hashes, ends = memo.of(words), np.repeat(stops, lengths)
    found: dict[int, tuple[set[tuple[int, int]], set[int]]] = {}
    for size, looked in block["looked"].items():
        if size == window:
            grams, reach = gram_hashes(hashes, ends, k), window - k
            places = np.flatnonzero(winnowed(grams, reach + 1))
        else:
            grams, reach = gram_hashes(hashes, ends, size), 0
            places = np.flatnonzero(grams != NONE)
        if not len(places):
            continue
        seen = -1
        for place in places[_member(grams[places], looked)].tolist():
            doc = int(np.searchsorted(stops, place, side="right"))
            begin, stop = int(stops[doc] - lengths[doc]), int(stops[doc])
            for start in range(max(begin, place - reach, seen + 1), min(place, stop - size) + 1):
                seen = start
                hit = block["windows"].get(window_key(words[start : start + size]))
                if hit:
                    spans, names = found.setdefault(doc, (set(), set()))
                    spans.add((start - begin, start - begin + size))
                    names |= hit
    return lengths, found


def merged(spans) -> list[dict]:
    out: list[dict] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], end)
        else:
            out.append({"start": start, "end": end})
    return out


def fingerprints(words: list[bytes], sizes: list[int], k: int, window: int, memo: WordHashes):
    """By window size: places and hashes of one text that are looked up, and how far before a place windows begin."""
    hashes, ends = memo.of(words), np.full(len(words), len(words))
    for size in sizes:
        if size == window:
            grams, reach = gram_hashes(hashes, ends, k), window - k
            places = np.flatnonzero(winnowed(grams, reach + 1)) if len(words) >= size else np.zeros(0, dtype=np.int64)
        else:
            grams, reach = gram_hashes(hashes, ends, size), 0
            places = np.flatnonzero(grams != NONE)
        yield size, places, grams[places].view(np.int64), reach


def _scanner(shared, k: int, window: int, keep: list[str]):
    def run(batches):
        block, memo = shared.value, WordHashes()
        for batch, texts in chunks(batches):
            lengths, found = scan(texts, block, k, window, memo)
            spans, items = [[] for _ in texts], [[] for _ in texts]
            for doc, (new, names) in found.items():
                spans[doc] = merged(new)
                items[doc] = sorted({block["names"][i] for i in names})
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep]
                + [pa.array(lengths), pa.array(spans, SPAN), pa.array(items, pa.list_(pa.string()))],
                [*keep, "n_words", "spans", "items"],
            )

    return run


def _item_maker(k: int, window: int):
    """hash, size, mark, item_id: the kept hashes of each item, with no mark, and the keys of its windows, with no hash."""

    def run(batches):
        memo = WordHashes()
        for batch, texts in chunks(batches):
            hashes, sizes, marks, names = [], [], [], []
            for name, text in zip(batch.column("item_id").to_pylist(), texts, strict=True):
                words = words_of(text)
                if not words:
                    continue
                size = min(window, len(words))
                _, _, kept, _ = next(fingerprints(words, [size], k, window, memo))
                kept = np.unique(kept).tolist()
                keys = list({window_key(words[i : i + size]) for i in range(len(words) - size + 1)})
                n = len(kept) + len(keys)
                hashes += kept + [None] * len(keys)
                marks += [None] * len(kept) + keys
                sizes += [size] * n
                names += [name] * n
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(marks, pa.binary()), pa.array(names, pa.string())],
                ["hash", "size", "mark", "item_id"],
            )

    return run


def _counter(through: list[str]):
    def run(batches):
        for batch, texts in chunks(batches):
            counts = pa.array([len(words_of(t)) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in through], counts], [*through, "n_words"])

    return run


def _doc_hashes(sizes: list[int], k: int, window: int):
    def run(batches):
        memo = WordHashes()
        for batch, texts in chunks(batches):
            rows, lengths, lists = [], [], []
            for row, text in zip(batch.column("_row").to_pylist(), texts, strict=True):
                for size, _, hashes, _ in fingerprints(words_of(text), sizes, k, window, memo):
                    rows.append(row)
                    lengths.append(size)
                    lists.append(np.unique(hashes))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(lengths, pa.int32()), pa.array(lists, pa.list_(pa.int64()))],
                ["_row", "size", "hashes"],
            )

    return run


def _doc_windows(sizes: list[int], k: int, window: int):
    def run(batches):
        memo = WordHashes()
        for batch, texts in chunks(batches):
            rows, starts, lengths, marks = [], [], [], []
            own, hits = batch.column("_row").to_pylist(), batch.column("hits").to_pylist()
            for row, hit, text in zip(own, hits, texts, strict=True):
                words, wanted = words_of(text), {}
                for x in hit:
                    wanted.setdefault(x["size"], []).append(x["hash"])
                used = [n for n in sizes if n in wanted]
                for size, places, hashes, reach in fingerprints(words, used, k, window, memo):
                    seen = -1
                    for place in places[np.isin(hashes, wanted[size])].tolist():
                        for start in range(max(0, place - reach, seen + 1), min(place, len(words) - size) + 1):
                            seen = start
                            rows.append(row)
                            starts.append(start)
                            lengths.append(size)
                            marks.append(window_key(words[start : start + size]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(starts, pa.int32()), pa.array(lengths, pa.int32()), pa.array(marks, pa.binary())],
                ["_row", "start", "size", "mark"],
            )

    return run


def _merger(batches):
    for batch in batches:
        spans = [merged((x["start"], x["end"]) for x in own) for own in batch.column("spans").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(spans, SPAN)], ["_row", "spans"])


def _salted(table: DataFrame) -> DataFrame:
    return table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _joined(docs: DataFrame, named: DataFrame, keep: list[str], k: int, window: int) -> DataFrame:
    """``overlaps`` for a benchmark of any size; ``named``: distinct item_id, text."""
    through = docs.columns
    schema = T.StructType([*docs.schema.fields, FOUND["n_words"]])
    counted = docs.mapInArrow(_counter(through), schema)
    counted = materialise(counted.withColumn("_row", F.monotonically_increasing_id()), "counted")
    made = named.mapInArrow(_item_maker(k, window), "hash long, size int, mark binary, item_id string")
    made = materialise(made, "items")
    sizes = sorted(r["size"] for r in made.select("size").distinct().collect())
    salt = F.pmod("_row", F.lit(SALTS)).cast("int").alias("salt")

    texts = counted.select("_row", "text")
    hashes = texts.mapInArrow(_doc_hashes(sizes, k, window), "_row long, size int, hashes array<long>")
    hashes = hashes.select("_row", "size", F.explode("hashes").alias("hash"), salt)
    looked = _salted(made.where("hash is not null").select("size", "hash").distinct())
    hits = hashes.join(looked, ["size", "hash", "salt"], "left_semi")
    hits = materialise(hits.groupBy("_row").agg(F.collect_list(F.struct("size", "hash")).alias("hits")), "hits")

    windows = texts.join(hits, "_row").mapInArrow(
        _doc_windows(sizes, k, window), "_row long, start int, size int, mark binary"
    )
    windows = windows.select("_row", "start", "size", "mark", salt)
    marks = materialise(made.where("mark is not null").select("size", "mark", "item_id").distinct(), "marks")
    held = windows.join(_salted(marks.select("size", "mark").distinct()), ["size", "mark", "salt"], "left_semi")
    held = materialise(held, "windows")
    ends = F.struct("start", (F.col("start") + F.col("size")).alias("end"))
    spans = held.groupBy("_row").agg(F.collect_list(ends).alias("spans"))
    merged_type = T.StructType([T.StructField("_row", T.LongType()), FOUND["spans"]])
    spans = spans.mapInArrow(_merger, merged_type)
    names = held.select("_row", "size", "mark", "salt").distinct().join(_salted(marks), ["size", "mark", "salt"])
    names = names.select("_row", "item_id").distinct().groupBy("_row").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    found = materialise(spans.join(names, "_row"), "overlaps")
    return counted.join(found, "_row", "left").select(
        *keep,
        "n_words",
        F.coalesce("spans", F.array().cast(FOUND["spans"].dataType)).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def overlaps(
    docs: DataFrame,
    items: DataFrame,
    keep: list[str] | None = None,
    k: int = 5,
    window: int = 10,
    block_bytes: int = 2_000_000,
) -> DataFrame:
    """``docs`` (text, ...) with n_words, spans (merged hit word ranges, end exclusive) and items (ids, sorted).

    ``items``: item_id, text.  ``keep``: the columns of ``docs`` to return, all
    by default (columns named n_words, spans or items are replaced).
    """
    spark = docs.sparkSession
    named = items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("string").alias("item_id"), "text"
    )
    named = named.where("text != ''").distinct()
    size = named.agg(F.sum(F.octet_length("text") + F.octet_length("item_id"))).first()[0] or 0
    new = [f.name for f in FOUND]
    keep = [c for c in (keep or docs.columns) if c not in new]
    through = list(dict.fromkeys([*keep, "text"]))
    if size > block_bytes:
        return _joined(docs.select(*through), named, keep, k, window)
    rows = [(r["item_id"], r["text"].encode()) for r in named.collect()]
    shared = spark.sparkContext.broadcast(build_block(rows, k, window))
    schema = T.StructType([docs.schema[c] for c in keep] + FOUND.fields)
    return docs.select(*through).mapInArrow(_scanner(shared, k, window, keep), schema)


def n_hit(spans="spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, x: total + (x["end"] - x["start"]))
