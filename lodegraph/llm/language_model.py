"""Katz back-off language model of word pairs.

Counts of words and word pairs come from all training texts.  Counts up to ``K``
are discounted by Good-Turing; one reserved count per context (and one for the
words as a whole) keeps mass free even where all counts are large:

* ``P1(w) = d1(c) * c / (N + 1)``; words never seen share the rest as one event;
* ``P(w2 | w1) = d2(c) * c / (c(w1) + 1)`` for a pair seen in training;
* otherwise ``backoff(w1) * P1(w2)``, where the weight is the exact quotient of
  the mass left in the context and the mass of the words not seen after it, so
  every context sums to one; an unseen context has weight 1.

Rows of single counts would be twelve times the size of the corpus, so counts
travel packed.  Documents become chunks (one row: local words, tokens as local
numbers), written once to the shared folder.  A chunk sends each key range the
sorted keys it holds, with its counts, as one packed array; Spark groups the
ranges' arrays, totals are taken per range and go back to the chunks in the
order of their keys.  Three such tables are exchanged, each partitioned by key
range: words, pairs, and contexts (sums over the pairs a chunk owns; a pair is
owned by the first chunk that has it in training).  A hot word or pair is one
entry per chunk, so no key can be heavier than another; ranges and chunks have
a bounded number of keys at any size of the corpus.  Only a handful of sums (N,
V, counts of counts) comes to the driver.

Words are 64-bit hashes, pairs 64-bit hashes of both.  Defined cases: null texts
are empty and consist of the end alone; rows repeated are scored each; without
training rows every word is unknown with probability 1.

Totals and contexts are also stored, a row per key range (``Model``), so that
``score`` can evaluate texts outside of the corpus: their chunks ask the ranges,
Spark brings both together, and every token is scored by its pair, or by its
word after backing off.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_TABLE, WordHashes, chunks, hash64, materialise

K = 5
START = np.uint64(hash64(b"\x00start"))
END = np.uint64(hash64(b"\x00end"))
#: Tokens of a chunk, and keys of a range (of all chunks together), about.
CHUNK_TOKENS = 2_000_000
RANGE_KEYS = 1_500_000


def pack(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, compressed."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data: bytes, kind) -> np.ndarray:
    size, kind = int.from_bytes(data[:8], "little"), np.dtype(kind)
    if not size:
        return np.zeros(0, dtype=kind)
    planes = pa.decompress(data[8:], size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def ranges(keys: np.ndarray, bits: int) -> np.ndarray:
    """Cuts of sorted keys into 2**bits ranges of their highest bits."""
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(1, dtype=np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def bits_for(total: int) -> int:
    return max(3, math.ceil(math.log2(max(total, 1) / RANGE_KEYS)))


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = first * np.uint64(0x9E3779B97F4A7C15) + (second ^ (second >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


CHUNK = "chunk long, doc_id array<long>, train array<boolean>, lengths binary, words binary, tokens binary, n_words long, n_tokens long"


def _chunker(batches):
    memo, held, size, number = WordHashes(), [], 0, 0
    base = TaskContext.get().partitionId() << 24

    def row():
        lengths = np.array([len(t) for _, _, t in held], dtype=np.int32)
        hashes = np.concatenate([t for _, _, t in held])
        words, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")  # frequent words get small numbers, which pack well
        rank = np.empty(len(order), dtype=np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        words = np.append(words[order], START)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([base + number]),
                pa.array([[d for d, _, _ in held]], pa.list_(pa.int64())),
                pa.array([[t for _, t, _ in held]], pa.list_(pa.bool_())),
                pa.array([pack(lengths)], pa.binary()),
                pa.array([pack(words)], pa.binary()),
                pa.array([pack(rank[inverse])], pa.binary()),
                pa.array([len(words)]),
                pa.array([len(hashes)]),
            ],
            ["chunk", "doc_id", "train", "lengths", "words", "tokens", "n_words", "n_tokens"],
        )

    for batch, texts in chunks(batches):
        ids, train = batch.column("doc_id").to_pylist(), batch.column("train").to_pylist()
        for doc, learn, text in zip(ids, train, texts, strict=True):
            hashes = np.append(memo.of(text.translate(LOWER_TABLE).split()), END)
            held.append((doc, bool(learn), hashes))
            size += len(hashes)
            if size >= CHUNK_TOKENS:
                yield row()
                held, size, number = [], 0, number + 1
    if held:
        yield row()


class Chunk:
    """A chunk's arrays: words (numbers as in tokens), tokens, the word before each, documents, pairs."""

    def __init__(self, row: dict):
        self.words = unpack(row["words"], np.uint64)
        self.tokens = unpack(row["tokens"], np.int32)
        self.lengths = unpack(row["lengths"], np.int32)
        self.start = len(self.words) - 1
        self.doc = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        self.before = np.empty_like(self.tokens)
        self.before[1:] = self.tokens[:-1]
        self.before[np.cumsum(self.lengths) - self.lengths] = self.start
        self.learned = np.array(row["train"], dtype=bool)[self.doc]
        self.order = np.argsort(self.words)
        keys = pair_keys(self.words[self.before], self.words[self.tokens])
        self.pairs, self.at, self.pair = np.unique(keys, return_index=True, return_inverse=True)


def _teller(word_bits: int, pair_bits: int):
    """Chunk rows to (kind, part, chunk, keys, counts): what each key range is told of a chunk."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own = Chunk(row)
                words = np.bincount(own.tokens[own.learned], minlength=len(own.words))[own.order]
                pairs = np.bincount(own.pair[own.learned], minlength=len(own.pairs))
                for kind, keys, counts, bits in (
                    ("word", own.words[own.order], words, word_bits),
                    ("pair", own.pairs, pairs, pair_bits),
                ):
                    cuts = ranges(keys, bits)
                    some = [(p, cuts[p], cuts[p + 1]) for p in range(1 << bits) if cuts[p + 1] > cuts[p]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([kind] * len(some)),
                            pa.array([p for p, _, _ in some], pa.int32()),
                            pa.array([row["chunk"]] * len(some), pa.int64()),
                            pa.array([pack_sorted(keys[a:b]) for _, a, b in some], pa.binary()),
                            pa.array([pack(counts[a:b].astype(np.int32)) for _, a, b in some], pa.binary()),
                        ],
                        ["kind", "part", "chunk", "keys", "counts"],
                    )

    return run


def _total(group: pa.Table) -> pa.Table:
    """Totals of a range's keys, back to each chunk: twice the total, plus one where the chunk owns the key.

    The row without a chunk is the range's part of the stored counts.
    """
    group = group.sort_by("chunk")
    kind, part = group["kind"][0].as_py(), group["part"][0].as_py()
    keys = [unpack_sorted(x) for x in group["keys"].to_pylist()]
    counts = [unpack(x, np.int32) for x in group["counts"].to_pylist()]
    names, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, np.concatenate(counts), len(names)).astype(np.int64)
    taken, answers, begin = np.zeros(len(names), dtype=bool), [], 0
    for own, n in zip(keys, counts, strict=True):
        at = inverse[begin : begin + len(own)]
        begin += len(own)
        new = (n > 0) & ~taken[at]
        taken[at[new]] = True
        answers.append(pack(total[at] * 2 + new))
    few = np.bincount(total[total <= K + 1], minlength=K + 2)[1 : K + 2]
    sums = [int(total.sum()), int((total > 0).sum()), *few.tolist()]
    return pa.table(
        {
            "kind": pa.array([kind] * (len(keys) + 1)),
            "part": pa.array([part] * (len(keys) + 1), pa.int32()),
            "chunk": pa.array([*group["chunk"].to_pylist(), None], pa.int64()),
            "answer": pa.array([*answers, None], pa.binary()),
            "sums": pa.array([*[None] * len(keys), sums], pa.list_(pa.int64())),
            "keys": pa.array([*[None] * len(keys), pack_sorted(names[total > 0])], pa.binary()),
            "totals": pa.array([*[None] * len(keys), pack(total[total > 0])], pa.binary()),
        }
    )


def discounts(histogram: dict[int, int]) -> list[float]:
    """Factors of counts 1 to K by Good-Turing, from how many events have each count.

    Where the estimate is no proper discount (too few events, or not
    decreasing), the count keeps a discount of ``r / (r + 1)``.
    """
    first, after = histogram.get(1, 0), histogram.get(K + 1, 0)
    cut = (K + 1) * after / first if first else 1.0
    out = []
    for r in range(1, K + 1):
        value = math.nan
        if histogram.get(r) and cut < 1:
            value = ((r + 1) * histogram.get(r + 1, 0) / histogram[r] / r - cut) / (1 - cut)
        out.append(value if 0 < value < 1 else r / (r + 1))
    return out


def _discounted(counts: np.ndarray, factors: list[float]) -> np.ndarray:
    table = np.array([0.0, *factors, 1.0])
    return table[np.minimum(counts, K + 1)] * counts


def _to_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _from_bytes(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


PARTIAL = "part int, chunk long, keys binary, seen binary, covered binary, needed binary, docs binary, open binary"


def _scorer(sums: dict, bits: int):
    """A chunk and its answers to partial scores, and what it knows and needs of contexts."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        own = Chunk(row)
        answers = right.sort_by([("kind", "ascending"), ("part", "ascending")])
        told = {"word": [], "pair": []}
        for kind, data in zip(answers["kind"].to_pylist(), answers["answer"].to_pylist(), strict=True):
            told[kind].append(unpack(data, np.int64))
        count = np.zeros(len(own.words), dtype=np.int64)
        count[own.order] = np.concatenate(told["word"]) >> 1
        pair = np.concatenate(told["pair"])
        pair_count, owned = pair >> 1, (pair & 1).astype(bool)
        context = count.copy()  # each occurrence of a word but the end is a context once
        context[own.start] = sums["texts"]
        word_p = np.where(count > 0, _discounted(count, sums["word"]) / (sums["n"] + 1.0), sums["unknown"])
        base = np.log10((count + 1.0) / (sums["n"] + sums["v"] + 1.0))
        pair_p = _discounted(pair_count, sums["pair"]) / (context[own.before[own.at]] + 1.0)
        seen = pair_count > 0
        logp = np.where(seen, np.log10(np.where(seen, pair_p, 1.0)), np.log10(word_p[own.tokens[own.at]]))[own.pair]
        n_docs = len(own.lengths)
        docs = pa.table(
            {
                "doc_id": pa.array(row["doc_id"], pa.int64()),
                "n_tokens": pa.array(own.lengths.astype(np.int64)),
                "n_known": pa.array(np.bincount(own.doc, count[own.tokens] > 0, n_docs).astype(np.int64)),
                "base_score": pa.array(np.bincount(own.doc, base[own.tokens], n_docs)),
                "score": pa.array(np.bincount(own.doc, logp, n_docs)),
            }
        )
        lost = np.flatnonzero(~seen[own.pair] & (context[own.before] > 0))
        first, second = own.before[own.at[owned]], own.tokens[own.at[owned]]
        mass = np.bincount(first, _discounted(pair_count[owned], sums["pair"]), len(own.words))
        cover = np.bincount(first, word_p[second], len(own.words))
        needed = np.zeros(len(own.words), dtype=bool)
        needed[own.before[lost]] = True
        used = own.order[(needed | (mass > 0))[own.order]]  # in the order of their hashes
        keys = own.words[used]
        wanted = used[needed[used]]
        place = np.zeros(len(own.words), dtype=np.int64)
        place[wanted] = np.arange(len(wanted))
        events, times = np.unique(own.doc[lost].astype(np.int64) << 32 | place[own.before[lost]], return_counts=True)
        open_ = pa.table({"event": pa.array(events), "times": pa.array(times)})
        cuts = ranges(keys, bits)
        some = [(p, cuts[p], cuts[p + 1]) for p in range(1 << bits) if cuts[p + 1] > cuts[p]]
        column = lambda f, last: pa.array([*[f(a, b) for _, a, b in some], last], pa.binary())
        return pa.table(
            {
                "part": pa.array([*[p for p, _, _ in some], -1], pa.int32()),
                "chunk": pa.array([row["chunk"]] * (len(some) + 1), pa.int64()),
                "keys": column(lambda a, b: pack_sorted(keys[a:b]), None),
                "seen": column(lambda a, b: pack(mass[used[a:b]]), None),
                "covered": column(lambda a, b: pack(cover[used[a:b]]), None),
                "needed": column(lambda a, b: pack(needed[used[a:b]]), pack(context[wanted])),
                "docs": pa.array([*[None] * len(some), _to_bytes(docs)], pa.binary()),
                "open": pa.array([*[None] * len(some), _to_bytes(open_)], pa.binary()),
            }
        )

    return run


def _contexts(group: pa.Table) -> pa.Table:
    """Sums of a range's contexts, back to the chunks that need them, and to the stored table (without a chunk)."""
    group = group.sort_by("chunk")
    keys = [unpack_sorted(x) for x in group["keys"].to_pylist()]
    names, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    both = [
        np.bincount(inverse, np.concatenate([unpack(x, np.float64) for x in group[c].to_pylist()]), len(names))
        for c in ("seen", "covered")
    ]
    cuts = np.cumsum([0] + [len(k) for k in keys])
    at = [inverse[a:b][unpack(x, bool)] for a, b, x in zip(cuts[:-1], cuts[1:], group["needed"].to_pylist(), strict=True)]
    held = np.flatnonzero(both[0] > 0)
    nothing = pa.array([None] * (len(at) + 1), pa.binary())
    return pa.table(
        {
            "chunk": pa.array([*group["chunk"].to_pylist(), None], pa.int64()),
            "part": pa.array([*group["part"].to_pylist(), group["part"][0].as_py()], pa.int32()),
            "seen": pa.array([pack(both[0][i]) for i in [*at, held]], pa.binary()),
            "covered": pa.array([pack(both[1][i]) for i in [*at, held]], pa.binary()),
            "context": nothing,
            "docs": nothing,
            "open": nothing,
            "keys": pa.array([*[None] * len(at), pack_sorted(names[held])], pa.binary()),
        }
    )


ANSWERED = "chunk long, part int, seen binary, covered binary, context binary, docs binary, open binary, keys binary"
SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _finish(group: pa.Table) -> pa.Table:
    rows = group.sort_by("part").to_pylist()
    head = next(r for r in rows if r["part"] < 0)
    docs, events = _from_bytes(head["docs"]), _from_bytes(head["open"])
    event = events["event"].to_numpy()
    if not len(event):
        return docs
    seen, covered = (
        np.concatenate([unpack(r[c], np.float64) for r in rows if r["part"] >= 0]) for c in ("seen", "covered")
    )
    context = unpack(head["context"], np.int64)
    weight = np.log10((1.0 - seen / (context + 1.0)) / (1.0 - covered))
    more = np.bincount(event >> 32, weight[event & 0xFFFFFFFF] * events["times"].to_numpy(), docs.num_rows)
    return docs.set_column(4, "score", pa.array(docs["score"].to_numpy() + more))


@dataclass(frozen=True)
class Model:
    """Stored tables, a row per key range, and a handful of sums.

    ``counts``: kind (word or pair), part, keys, totals.  ``contexts``: part,
    keys, seen, covered, from which a context's back-off weight follows.  Sums: n
    (training tokens), v (words), texts, the discounts of words and pairs, unknown.
    """

    counts: DataFrame
    contexts: DataFrame
    sums: dict
    word_bits: int
    pair_bits: int


def score_corpus(docs: DataFrame) -> tuple[DataFrame, dict]:
    """(doc_id, n_tokens, n_known, base_score, score) of every row of ``docs`` (doc_id, text, train), and the sums.

    The model learns from the rows where ``train`` is true, and the same
    exchanges answer all rows; ``score`` does it for texts outside of the corpus.
    """
    scored, model = _learned(docs)
    return scored, model.sums


def fit(docs: DataFrame) -> Model:
    """The model of ``docs`` (doc_id, text, train), for texts of any other table."""
    return _learned(docs)[1]


def _learned(docs: DataFrame) -> tuple[DataFrame, Model]:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("train", F.lit(False)).alias("train"))
    held = materialise(rows.mapInArrow(_chunker, CHUNK), "chunks")
    size = held.agg(F.sum("n_words").alias("w"), F.sum("n_tokens").alias("t")).first()
    word_bits, pair_bits = bits_for(size["w"] or 0), bits_for(size["t"] or 0)
    told = held.select("chunk", "train", "lengths", "words", "tokens").mapInArrow(
        _teller(word_bits, pair_bits), "kind string, part int, chunk long, keys binary, counts binary"
    )
    answered = materialise(
        told.groupBy("kind", "part").applyInArrow(
            _total, "kind string, part int, chunk long, answer binary, sums array<long>, keys binary, totals binary"
        ),
        "totals",
    )
    totals = {
        r["kind"]: r
        for r in answered.where("chunk IS NULL")
        .groupBy("kind")
        .agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(K + 3)])
        .collect()
    }
    few = {k: {i: int(r[f"s{i + 1}"]) for i in range(1, K + 2)} for k, r in totals.items()}
    texts = rows.where("train").count()
    sums = {
        "n": int(totals["word"]["s0"]) if totals else 0,
        "v": int(totals["word"]["s1"]) if totals else 0,
        "texts": texts,
        **{k: discounts(few.get(k, {})) for k in ("word", "pair")},
    }
    # what the discounts free of the words: those above K lose nothing but the reserved count
    freed = sum((1.0 - d) * r * few.get("word", {}).get(r, 0) for r, d in enumerate(sums["word"], 1))
    sums["unknown"] = (freed + 1.0) / (sums["n"] + 1.0)
    partial = materialise(
        held.groupBy("chunk")
        .cogroup(answered.where("chunk IS NOT NULL").select("chunk", "kind", "part", "answer").groupBy("chunk"))
        .applyInArrow(_scorer(sums, word_bits), PARTIAL),
        "partial-scores",
    )
    backed = partial.where("part >= 0").select("part", "chunk", "keys", "seen", "covered", "needed")
    weights = materialise(backed.groupBy("part").applyInArrow(_contexts, ANSWERED), "contexts")
    heads = partial.where("part < 0").select(
        "chunk", "part", F.lit(None).cast("binary").alias("seen"), F.lit(None).cast("binary").alias("covered"),
        F.col("needed").alias("context"), "docs", "open", F.lit(None).cast("binary").alias("keys"),
    )
    model = Model(
        answered.where("chunk IS NULL").select("kind", "part", "keys", "totals"),
        weights.where("chunk IS NULL").select("part", "keys", "seen", "covered"),
        sums,
        word_bits,
        pair_bits,
    )
    answers = weights.where("chunk IS NOT NULL").unionByName(heads)
    return answers.groupBy("chunk").applyInArrow(_finish, SCORED), model


def _asker(word_bits: int, pair_bits: int):
    """Chunk rows to (kind, part, chunk, keys): what each key range is asked."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own = Chunk(row)
                for kind, keys, bits in (("word", own.words[own.order], word_bits), ("pair", own.pairs, pair_bits)):
                    cuts = ranges(keys, bits)
                    some = [(p, cuts[p], cuts[p + 1]) for p in range(1 << bits) if cuts[p + 1] > cuts[p]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([kind] * len(some)),
                            pa.array([p for p, _, _ in some], pa.int32()),
                            pa.array([row["chunk"]] * len(some), pa.int64()),
                            pa.array([pack_sorted(keys[a:b]) for _, a, b in some], pa.binary()),
                        ],
                        ["kind", "part", "chunk", "keys"],
                    )

    return run


def _looked_up(names: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(names):
        return np.zeros(len(keys), dtype=values.dtype)
    at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
    return np.where(names[at] == keys, values[at], 0)


REPLY = "kind string, part int, chunk long, counts binary, seen binary, covered binary"


def _replied(asked: pa.Table, stored: pa.Table) -> pa.Table:
    """A range's stored values for the keys of each chunk."""
    values = {
        name: (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=kind))
        for name, kind in (("totals", np.int64), ("seen", np.float64), ("covered", np.float64))
    }
    for row in stored.to_pylist():
        for name, (_, empty) in list(values.items()):
            if row[name] is not None:
                values[name] = (unpack_sorted(row["names"]), unpack(row[name], empty.dtype))
    keys = [unpack_sorted(x) for x in asked["keys"].to_pylist()]
    column = lambda name: pa.array([pack(_looked_up(*values[name], k)) for k in keys], pa.binary())
    return pa.table(
        {
            "kind": asked["kind"], "part": asked["part"], "chunk": asked["chunk"],
            "counts": column("totals"), "seen": column("seen"), "covered": column("covered"),
        }
    )


def _evaluator(sums: dict):
    """A chunk and the replies to it to scores: each token by its pair, or by its word after backing off."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        own, told = Chunk(row), {}
        for r in right.sort_by([("kind", "ascending"), ("part", "ascending")]).to_pylist():
            held = told.setdefault(r["kind"], ([], [], []))
            for part, name, kind in zip(held, ("counts", "seen", "covered"), (np.int64, np.float64, np.float64), strict=True):
                part.append(unpack(r[name], kind))
        count, seen, covered = (np.zeros(len(own.words)) for _ in range(3))
        for whole, parts in zip((count, seen, covered), told["word"], strict=True):
            whole[own.order] = np.concatenate(parts)
        count, pair_count = count.astype(np.int64), np.concatenate(told["pair"][0])
        context = count.copy()
        context[own.start] = sums["texts"]
        word_p = np.where(count > 0, _discounted(count, sums["word"]) / (sums["n"] + 1.0), sums["unknown"])
        base = np.log10((count + 1.0) / (sums["n"] + sums["v"] + 1.0))
        backoff = np.where(context > 0, (1.0 - seen / (context + 1.0)) / (1.0 - covered), 1.0)
        first, second = own.before[own.at], own.tokens[own.at]
        direct = _discounted(pair_count, sums["pair"]) / (context[first] + 1.0)
        logp = np.log10(np.where(pair_count > 0, direct, backoff[first] * word_p[second]))[own.pair]
        n = len(own.lengths)
        return pa.table(
            {
                "doc_id": pa.array(row["doc_id"], pa.int64()),
                "n_tokens": pa.array(own.lengths.astype(np.int64)),
                "n_known": pa.array(np.bincount(own.doc, count[own.tokens] > 0, n).astype(np.int64)),
                "base_score": pa.array(np.bincount(own.doc, base[own.tokens], n)),
                "score": pa.array(np.bincount(own.doc, logp, n)),
            }
        )

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row of ``docs`` (doc_id, text), by the stored tables."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(False).alias("train"))
    held = materialise(rows.mapInArrow(_chunker, CHUNK), "chunks")
    asked = held.select("chunk", "doc_id", "train", "lengths", "words", "tokens").mapInArrow(
        _asker(model.word_bits, model.pair_bits), "kind string, part int, chunk long, keys binary"
    )
    none = F.lit(None).cast("binary")
    stored = model.counts.select("kind", "part", F.col("keys").alias("names"), "totals", none.alias("seen"), none.alias("covered"))
    stored = stored.unionByName(
        model.contexts.select(F.lit("word").alias("kind"), "part", F.col("keys").alias("names"), none.alias("totals"), "seen", "covered")
    )
    replies = asked.groupBy("kind", "part").cogroup(stored.groupBy("kind", "part")).applyInArrow(_replied, REPLY)
    replies = materialise(replies, "replies")
    return held.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_evaluator(model.sums), SCORED)
