"""Quality classifier: random-indexing word vectors and a two-layer network.

Random indexing gives every word a sparse random vector (a few +1 and -1, drawn
from the word's hash); a word's context vector is the sum of the random vectors
of its neighbours.  A document is pooled to the mean and the spread of its
words' vectors, and a network with one hidden layer turns that into a logit
whose temperature is calibrated on rows the weights have not seen.

The classifier is fitted on at most ``fit_rows`` labelled rows (those with the
smallest hashes) of at most ``fit_bytes`` of text, drawn without moving any text
but theirs; word vectors, the network and the temperature all come from this one
sample, so the model's size is bounded at any size of the corpus.  Scoring is a narrow map over all texts.

Words the sample has less than ``LEAST_COUNT`` times, and unseen ones, stand for
their shape (runs of character classes); shapes as rare share one vector of zeros.

Defined cases: null and empty texts are pooled to zeros and scored like any;
rows without a label never train; several labels of a document, and several texts
of an id, all train, rows repeated whole once; a score of exactly 1/2 (a tie) counts
as label 1 in the query; repeated rows are scored each and alike;
without labelled rows, or with one class only, the score is the smoothed share
of label 1.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, materialise

DIM = 64
NONZERO = 4
WINDOW = 2
LEAST_COUNT = 5
HIDDEN = 32

_CLASSES = bytes(
    ord("X") if 65 <= c <= 90 else ord("x") if 97 <= c <= 122 or c >= 128 else ord("9") if 48 <= c <= 57 else c
    for c in range(256)
)
_RUNS = re.compile(rb"(.)\1+", re.DOTALL)


def shape(word: bytes) -> bytes:
    """Runs of character classes, marked so that no word equals a shape."""
    return b" " + _RUNS.sub(rb"\1", word.translate(_CLASSES))


def random_vector(word: bytes) -> np.ndarray:
    rng = np.random.default_rng(xxhash.xxh64_intdigest(word))
    out = np.zeros(DIM, dtype=np.float32)
    out[rng.choice(DIM, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return out


class Vocabulary(dict):
    """Word -> number; a word without an entry gets its shape's number, remembered within bounds."""

    held = 300_000

    def __init__(self, names: list[bytes]):
        super().__init__((w, i + 1) for i, w in enumerate(names))
        self.names = dict(self)

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.held + len(self.names):
            self.clear()
            self.update(self.names)
        value = self[word] = self.names.get(shape(word), 0)
        return value

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


def learn_names(texts: list[bytes]) -> list[bytes]:
    counts: Counter = Counter()
    for text in texts:
        counts.update(text.split())
    names = sorted((w for w, n in counts.items() if n >= LEAST_COUNT), key=lambda w: (-counts[w], w))
    known, shapes = set(names), Counter()
    for word, n in counts.items():
        if word not in known:
            shapes[shape(word)] += n
    return names + sorted((s for s, n in shapes.items() if n >= LEAST_COUNT), key=lambda s: (-shapes[s], s))


def context_vectors(documents: list[np.ndarray], names: list[bytes]) -> np.ndarray:
    """Sum of the neighbours' random vectors per word, scaled to unit length; row 0 is the unknown shape."""
    index = np.vstack([np.zeros(DIM, dtype=np.float32), *[random_vector(w) for w in names]])
    out = np.zeros_like(index)
    size = len(index)
    for begin in range(0, len(documents), 200):
        part = documents[begin : begin + 200]
        for off in range(1, WINDOW + 1):
            left = np.concatenate([d[:-off] for d in part if len(d) > off] or [np.zeros(0, dtype=np.int64)])
            right = np.concatenate([d[off:] for d in part if len(d) > off] or [np.zeros(0, dtype=np.int64)])
            pairs, n = np.unique(np.concatenate([left * size + right, right * size + left]), return_counts=True)
            word, neighbour = pairs // size, pairs % size
            for j in range(DIM):
                out[:, j] += np.bincount(word, n * index[neighbour, j], size)
    # damp frequent contexts and keep part of the word's own random vector, so that no two words coincide
    out = np.sign(out) * np.log1p(np.abs(out))
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.maximum(norm, 1e-9) + 0.5 * index / np.sqrt(NONZERO)).astype(np.float32)


POOLED = 2 * DIM + 3


def pool(words: list[bytes], numbers: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the vectors of a document's words, and how often words and neighbours are the same."""
    n = len(words)
    if not n:
        return np.zeros(POOLED, dtype=np.float32)
    same = sum(map(eq, words, islice(words, 1, None))) / n
    distinct = len(set(words)) / n
    kinds, counts = np.unique(numbers, return_counts=True)
    weight = (counts / len(numbers)).astype(np.float32)
    own = vectors[kinds]
    mean = weight @ own
    spread = np.sqrt(np.maximum(weight @ np.square(own) - np.square(mean), 0))
    return np.concatenate([mean, spread, [np.sqrt(same), distinct, np.sqrt(1.0 / n)]])


def _logits(x: np.ndarray, net: dict) -> np.ndarray:
    hidden = np.tanh((x - net["shift"]) / net["scale"] @ net["w1"] + net["b1"])
    return hidden @ net["w2"] + net["b2"]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 1, epochs: int = 60, decay: float = 1e-3) -> dict:
    """The network by Adam on four fifths of the rows, and its temperature on the rest."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, used = order[: len(x) // 5], order[len(x) // 5 :]
    if len(set(y[held])) < 2 or len(set(y[used])) < 2:
        held = used = order
    net = {
        "shift": x[used].mean(0),
        "scale": x[used].std(0) + 1e-3,
        "w1": (rng.normal(size=(x.shape[1], HIDDEN)) / np.sqrt(x.shape[1])).astype(np.float64),
        "b1": np.zeros(HIDDEN),
        "w2": rng.normal(size=HIDDEN) / np.sqrt(HIDDEN),
        "b2": 0.0,
    }
    names = ("w1", "b1", "w2", "b2")
    first, second = {k: 0.0 for k in names}, {k: 0.0 for k in names}
    step, best = 0, (np.inf, dict(net))
    for _ in range(epochs):
        rows = rng.permutation(used)
        for begin in range(0, len(rows), 128):
            part = rows[begin : begin + 128]
            scaled = (x[part] - net["shift"]) / net["scale"]
            hidden = np.tanh(scaled @ net["w1"] + net["b1"])
            error = (_sigmoid(hidden @ net["w2"] + net["b2"]) - y[part]) / len(part)
            back = np.outer(error, net["w2"]) * (1 - np.square(hidden))
            slopes = {
                "w1": scaled.T @ back + decay * net["w1"],
                "b1": back.sum(0),
                "w2": hidden.T @ error + decay * net["w2"],
                "b2": error.sum(),
            }
            step += 1
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * slopes[k]
                second[k] = 0.999 * second[k] + 0.001 * np.square(slopes[k])
                rate = 0.003 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                net[k] = net[k] - rate * first[k] / (np.sqrt(second[k]) + 1e-8)
        loss = _loss(_logits(x[held], net), y[held])
        if loss < best[0]:
            best = (loss, dict(net))
    net = best[1]
    logits = _logits(x[held], net)
    temperatures = np.exp(np.linspace(np.log(0.25), np.log(8), 141))
    net["temperature"] = float(temperatures[np.argmin([_loss(logits / t, y[held]) for t in temperatures])])
    return net


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def sample(docs: DataFrame, labels: DataFrame, fit_rows: int, fit_bytes: int) -> DataFrame:
    """hash, text, label: up to ``fit_rows`` different labelled texts, by hashes of their ids, of ``fit_bytes`` together.

    The bounds are kept on narrow rows (ids, lengths, hashes of texts), so no
    text moves that does not train, however often its row is repeated.
    """
    known = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "label")
    chosen = known.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(fit_rows)
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    held = marked.select("doc_id", "mark", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))
    held = held.join(F.broadcast(chosen), "doc_id").distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("label"), F.col("mark")]
    few = held.orderBy(*order).limit(fit_rows)
    fits = F.sum("bytes").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    few = few.withColumn("upto", fits).where(F.col("upto") <= fit_bytes)
    few = materialise(few.select("doc_id", "mark", "label"), "sample")
    found = marked.join(F.broadcast(few), ["doc_id", "mark"])
    return found.groupBy("doc_id", "mark", "label").agg(F.first("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 6_000, fit_bytes: int = 256 << 20) -> dict:
    """The model from ``docs`` (doc_id, text) and ``labels`` (doc_id, label 0/1).

    It is fitted on a sample of at most ``fit_rows`` labelled rows and
    ``fit_bytes`` bytes of text, with ties in the order of ids, labels and texts.
    """
    rows = sample(docs, labels, fit_rows, fit_bytes)
    texts = []
    for row in rows.select("text", "label", "doc_id").toLocalIterator():
        texts.append((xxhash.xxh64_intdigest(str(row["doc_id"])), (row["text"] or "").encode(), float(row["label"])))
    texts.sort()
    y = np.array([x[2] for x in texts])
    bodies = [x[1] for x in texts]
    if len(set(y.tolist())) < 2:
        return {"share": float((y.sum() + 1) / (len(y) + 2))}
    names = learn_names(bodies)
    vocabulary = Vocabulary(names)
    documents = [vocabulary.numbers(t.split()) for t in bodies]
    vectors = context_vectors(documents, names)
    x = np.stack([pool(t.split(), d, vectors) for t, d in zip(bodies, documents, strict=True)]).astype(np.float64)
    return {"names": names, "vectors": vectors, "net": train(x, y)}


def _scorer(shared, keep: list[str]):
    def run(batches):
        model = shared.value
        vocabulary = Vocabulary(model.get("names", []))
        for batch, texts in chunks(batches):
            if "net" in model:
                lists = [t.split() for t in texts]
                x = np.stack([pool(w, vocabulary.numbers(w), model["vectors"]) for w in lists])
                score = _sigmoid(_logits(x.astype(np.float64), model["net"]) / model["net"]["temperature"])
            else:
                score = np.full(len(texts), model["share"])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(score)], [*keep, "score"])

    return run


def score(docs: DataFrame, model: dict, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (text, ...) with score: the probability of label 1.  ``keep``: columns to return, all by default."""
    keep = [c for c in (keep or docs.columns) if c != "score"]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(_scorer(shared, keep), schema)
