"""Alignment of two tokenizers' tokens over the same bytes.

A text with a space in front is cut by tokenizer A (byte-level BPE); tokenizer
B (pieces with byte fallback) adds the space itself.  Each list of tokens has
cumulative ends in bytes.  A dictionary per side leads from an end to its index;
the keys that both hold, sorted, cut both lists into groups.  Links are the
pairs of tokens whose bytes overlap; they are expanded within each group.

How often an id pair is linked is counted over the corpus.  Tasks cut slices of
texts into tokens once and write one row per slice, the *chunk*: packed ids,
packed cuts and its distinct pairs with counts.  Neither tokenizer has a token
over the end of a word (white space and what follows up to the next), so a
worker cuts each word once and remembers its tokens and groups, within bounds;
a model that has such a token is cut by whole texts.  Pairs are summed in
Spark (a frequent pair is one row per chunk, so no pair is heavier than
another), the sums go back to the chunks that asked, and tasks expand the
chunks' links again for the results by document.  Nothing is broadcast and no
table of pairs is held whole: a task holds one chunk and the sums of that
chunk's pairs.

Defined cases: a text that is null, empty, or whose tokens do not give back its
bytes (U+2581 in a text, for one) has no tokens and no groups, all its numbers
are zero.  Repeated rows count as often as they occur.  Among pairs that tie for
the highest count of a B id all are best.  Only the columns named are read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, materialise
from .language_model import pack, unpack

#: Where the tokenizers' files lie on every machine, and their names.
FOLDER, BYTE_LEVEL, PIECES = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: How a byte-level tokenizer of this kind splits a text before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space of that pattern, beside blanks and line ends.  A word begins with one of these two that follows no white space.
OTHER = "\t\v-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUN = rf"[ \n{OTHER}]*[^ \n{OTHER}]*"
WORD = re.compile(rf"[ \n]{RUN}(?:[{OTHER}]{RUN})*")
#: Texts that are cut at once; words and tokens of them that a worker remembers; bytes of text in a chunk, and chunks that a task of the second pass takes, about.
ENCODE_ROWS, HELD_WORDS, HELD_TOKENS, CHUNK_BYTES, TASK_CHUNKS = 64, 120_000, 1_500_000, 1_000_000, 16
#: A pair is one number: B's id times this, plus A's id.
SHIFT = 32


def byte_level_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for: printable Latin-1 is itself, the rest follows from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """Both tokenizers with their tokens' bytes."""

    def __init__(self, folder: str = FOLDER, byte_level: str = BYTE_LEVEL, pieces: str = PIECES):
        import sentencepiece
        import tiktoken

        with open(f"{folder}/{byte_level}", encoding="utf-8") as file:
            model = json.load(file)
        alphabet = byte_level_alphabet()
        special = {x["id"] for x in model["added_tokens"] if x["special"]}
        ranks = {bytes(map(alphabet.__getitem__, t)): i for t, i in model["model"]["vocab"].items() if i not in special}
        # ids are in the order of the merges, so they serve as ranks; special tokens are left out, their strings are ordinary text
        self.a = tiktoken.Encoding(byte_level, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{pieces}")
        size, names_of = self.b.get_piece_size(), {i: t for t, i in ranks.items()}
        self.bytes_a = [names_of.get(i, b"") for i in range(max(names_of) + 1)]
        names = self.b.id_to_piece(list(range(size)))
        self.bytes_b = [
            bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i)
            else x.replace("▁", " ").encode()
            for i, x in enumerate(names)
        ]
        # where no piece of B goes on over the start of a word, its merges end at words as those of A do
        over = re.compile(rf"[^ \n{OTHER}][ \n]| \n")
        self.by_words = not any(over.search(x.replace("▁", " ")) for x in names)
        self.blank = self.b.piece_to_id("▁")
        self.lengths_a = self.lengths()[0]

    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array([len(x) for x in side], dtype=np.int64) for side in (self.bytes_a, self.bytes_b))

    def words(self, text: str) -> list[str]:
        """A space and the text, cut into words; nothing of an empty text."""
        return [] if not text else WORD.findall(" " + text) if self.by_words else [" " + text]

    def encode(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and of B, and how many of each per word; none of a word that B does not give back.

        A's ids always do: it has a token for every byte, and merges keep the bytes.  B adds a space itself, but not to
        nothing; before a line end it is a token of its own, which goes again.  A takes the words joined, but for those
        that end in white space, whose cut hangs on what follows.
        """
        b = [(x or [self.blank])[w[0] != " " :] for w, x in zip(words, self.b.encode([w.removeprefix(" ") for w in words], num_threads=1))]
        given = lambda ids: b"".join(map(self.bytes_b.__getitem__, ids))
        if given(chain.from_iterable(b)) != "".join(words).encode():  # B's bytes of a word are never more than the word's
            fine = [given(x) == w.encode() for w, x in zip(words, b)]
            b = [x if ok else [] for x, ok in zip(b, fine)]
            words = [w if ok else "" for w, ok in zip(words, fine)]
        a, sizes, held = [], [], []
        for word in [*words, None]:
            if word is not None and not (open_end := word[-1:].isspace()):
                held.append(word)
                continue
            ids = self.a.encode_ordinary("".join(held))
            ends = np.cumsum(self.lengths_a[ids]) if ids else np.zeros(0, np.int64)
            stops = np.cumsum([len(w.encode()) for w in held])
            sizes.append(np.diff(np.searchsorted(ends, stops, "right"), prepend=0))
            a.append(np.array(ids, np.int32))
            held = []
            if word is not None and open_end:
                a.append(np.array(self.a.encode_ordinary(word), np.int32))
                sizes.append([len(a[-1])])
        flat = np.fromiter(chain.from_iterable(b), np.int32)
        return [np.concatenate(a), flat], [np.concatenate(sizes).astype(np.int64), np.fromiter(map(len, b), np.int64, len(b))]


def ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``values`` of the runs at ``starts``, one run after the other."""
    return values[np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)]


class Words(dict):
    """Word -> number, with the tokens and groups of each word: ``flat`` of ``a``, ``b``, ``m`` and ``n``, ``sizes`` and ``starts``.

    ``m`` and ``n`` are the tokens of A and of B per group.  A word without tokens is one that B does not give back.
    """

    names = ("a", "b", "m", "n")

    def __init__(self, both: Pair):
        super().__init__()
        self.both, self.lengths = both, both.lengths()
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.flat = {x: np.zeros(0, np.int32) for x in self.names}
        self.sizes = {x: np.zeros(0, np.int64) for x in self.names}
        self.starts = dict(self.sizes)

    def learn(self, words: list[str]) -> None:
        ids, sizes = self.both.encode(words)
        at = cuts(*[np.cumsum(t[x]) for t, x in zip(self.lengths, ids)])
        groups = np.diff(np.searchsorted(at[0], np.cumsum(sizes[0]), "right"), prepend=0)
        steps = [np.diff(x, prepend=0) for x in at]
        for name, values, size in zip(self.names, (*ids, *steps), (*sizes, groups, groups)):
            self.flat[name] = np.append(self.flat[name], values.astype(np.int32))
            self.sizes[name] = np.append(self.sizes[name], size)
            self.starts[name] = np.cumsum(self.sizes[name]) - self.sizes[name]
        self.update(zip(words, range(len(self), len(self) + len(words))))

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of each text's words; none of a text that B does not give back.  They hold until the next call."""
        if len(self) > HELD_WORDS or len(self.flat["a"]) > HELD_TOKENS:
            self.forget()
        out = []
        for at in range(0, len(texts), ENCODE_ROWS):
            cut = [self.both.words(t) for t in texts[at : at + ENCODE_ROWS]]
            new = [w for w in dict.fromkeys(chain.from_iterable(cut)) if w not in self]
            if new:
                self.learn(new)
            out += [np.fromiter(map(self.__getitem__, words), np.int64, len(words)) for words in cut]
        return [x if self.sizes["a"][x].all() else x[:0] for x in out]

    def of(self, name: str, numbers: np.ndarray) -> np.ndarray:
        return ragged(self.flat[name], self.starts[name][numbers], self.sizes[name][numbers])


def cuts(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of A and of B tokens up to each byte at which tokens of both end."""
    _, a, b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
    return a + 1, b + 1


def ranked(ids: np.ndarray) -> tuple[bytes, bytes]:
    """Ids as numbers of a list that begins with the frequent ones, and that list: smaller when packed."""
    counts = np.bincount(ids)
    order = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
    place = np.zeros(len(counts), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return pack(place[ids]), pack(order.astype(np.int32))


def expand(ends_a, ends_b, cuts_a, cuts_b) -> tuple[np.ndarray, np.ndarray]:
    """Places of the A and B tokens of all links, group by group (arguments: arrays of ends, arrays of cuts).

    In a group where one side has a single token, that token is linked with all
    of the other side; elsewhere both sides are walked from end to end.
    """
    m, n = np.diff(cuts_a, prepend=0), np.diff(cuts_b, prepend=0)
    simple = np.minimum(m, n) == 1
    size = np.where(simple, np.maximum(m, n), 0)
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    left = np.repeat(cuts_a - m, size) + np.where(np.repeat(m > 1, size), step, 0)
    right = np.repeat(cuts_b - n, size) + np.where(np.repeat(n > 1, size), step, 0)
    more_a, more_b = [], []
    for at in np.flatnonzero(~simple).tolist():
        (i, last_i), (j, last_j) = (cuts_a[at] - m[at], cuts_a[at]), (cuts_b[at] - n[at], cuts_b[at])
        heads, tails = ends_a[i:last_i].tolist(), ends_b[j:last_j].tolist()
        x = y = 0
        while x < len(heads) and y < len(tails):
            more_a.append(i + x)
            more_b.append(j + y)
            x, y = x + (heads[x] <= tails[y]), y + (tails[y] <= heads[x])
    return np.append(left, np.array(more_a, np.int64)), np.append(right, np.array(more_b, np.int64))


def chunked(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """One row per slice of documents: ids, cuts and pairs, packed.  Not deterministic in its numbers of chunks: write it once."""
    schema = T.StructType(
        [
            T.StructField("chunk", T.LongType()),
            T.StructField("doc_id", T.ArrayType(docs.schema["doc_id"].dataType)),
            *T.StructType.fromDDL("sizes binary, a binary, a_ids binary, b binary, b_ids binary, cuts binary, pairs array<long>, counts array<long>"),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out_schema, known, number = to_arrow_schema(schema), None, TaskContext.get().partitionId() << 32
        for batch, texts in chunks(batches, size=CHUNK_BYTES):
            known = known or Words(Pair(folder))
            numbers = known.numbers([t.decode() for t in texts])
            per_text = np.cumsum([0, *map(len, numbers)])
            numbers = np.concatenate(numbers)
            of_text = lambda x: np.diff(np.append(0, np.cumsum(known.sizes[x][numbers]))[per_text])  # noqa: B023, E731
            sizes = np.stack([of_text("a"), of_text("b")], axis=1)
            a, b, *steps = (known.of(x, numbers) for x in known.names)
            # links of each different word, as often as the word stands here
            words, often = np.unique(numbers, return_counts=True)
            word_a, word_b, *at = (known.of(x, words) for x in known.names)
            i, j = expand(*[np.cumsum(t[x]) for t, x in zip(known.lengths, (word_a, word_b))], *map(np.cumsum, at))
            often = often[np.searchsorted(np.cumsum(known.sizes["a"][words]), i, "right")]
            pairs, which = np.unique((word_b[j].astype(np.int64) << SHIFT) + word_a[i], return_inverse=True)
            counts = np.bincount(which, often, len(pairs)).astype(np.int64)
            docs_of = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            row = [number, docs_of, pack(sizes.astype(np.int32).ravel()), *ranked(a), *ranked(b), pack(np.concatenate(steps).astype(np.int32)), pairs, counts]
            yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(row, out_schema)], schema=out_schema)
            number += 1

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def pair_counts(chunk_rows: DataFrame) -> DataFrame:
    """pair, a, b, count, best (no pair of the same B id has more links), over all chunks."""
    asked = chunk_rows.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
    sums = asked.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("count"))
    sums = sums.select("pair", F.col("pair").bitwiseAND((1 << SHIFT) - 1).alias("a"), F.shiftright("pair", SHIFT).alias("b"), "count")
    return sums.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def align(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (``a1,a2|b1;a3|b2,b3``), one row per row of ``docs``."""
    held = materialise(chunked(docs, folder), "token-chunks")
    totals = pair_counts(held).select("pair", "count", "best")
    asked = held.select("chunk", F.explode("pairs").alias("pair"))
    sums = asked.join(totals.hint("merge"), "pair").groupBy("chunk").agg(F.collect_list(F.struct("pair", "count", "best")).alias("sums"))
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            *T.StructType.fromDDL("n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"),
        ]
    )
    lengths = Pair(folder).lengths()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out_schema = to_arrow_schema(schema)
        n_a, n_b = map(len, lengths)
        # every id with every mark that may follow it
        names = [f"{i}{x}" for x in (",", "|") for i in range(n_a)] + [f"{i}{x}" for x in (",", ";", "") for i in range(n_b)]
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name: batch.column(batch.schema.get_field_index(name))[row]  # noqa: B023, E731
                sizes = unpack(get("sizes").as_py(), np.int32).reshape(-1, 2).astype(np.int64)
                a, b = (unpack(get(f"{x}_ids").as_py(), np.int32).astype(np.int64)[unpack(get(x).as_py(), np.int32)] for x in "ab")
                steps = unpack(get("cuts").as_py(), np.int32).astype(np.int64).reshape(2, -1)
                m, n = steps
                cuts_a, cuts_b = np.cumsum(m), np.cumsum(n)
                after_a, after_b = np.cumsum(sizes, axis=0).T  # documents' ends among the tokens
                groups = np.diff(np.searchsorted(cuts_a, after_a, "right"), prepend=0)
                i, j = expand(np.cumsum(lengths[0][a]), np.cumsum(lengths[1][b]), cuts_a, cuts_b)
                doc = np.searchsorted(after_a, i, "right")
                pairs, count, best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
                if (told := get("sums")).is_valid and len(told.values):
                    pairs, count, best = (told.values.field(x).to_numpy(zero_copy_only=False) for x in ("pair", "count", "best"))
                    order = np.argsort(pairs)
                    pairs, count, best = pairs[order], count[order], best[order]
                at = np.searchsorted(pairs, (b[j] << SHIFT) + a[i])
                per_doc = lambda x: np.bincount(doc, x, len(sizes)).astype(np.int64)  # noqa: B023, E731
                count_sum = np.zeros(len(sizes), np.int64)
                np.add.at(count_sum, doc, count[at])
                # A's tokens of a group stand before B's: place and mark of each
                mark = np.append(a, b + 2 * n_a)
                mark[cuts_a - 1] += n_a
                mark[len(a) + cuts_b - 1] += n_b
                ends = after_b[sizes[:, 1] > 0]
                mark[len(a) + ends - 1] += n_b
                place = np.append(np.arange(len(a)) + np.repeat(cuts_b - n, m), np.arange(len(b)) + np.repeat(cuts_a, n))
                text = np.empty(len(mark), np.int64)
                text[place] = mark
                words, stops = text.tolist(), (after_a + after_b).tolist()
                texts = ["".join(map(names.__getitem__, words[x:y])) for x, y in zip([0, *stops], stops)]
                columns = [get("doc_id").as_py(), sizes[:, 0], sizes[:, 1], groups, per_doc(None), per_doc(best[at]), count_sum, texts]
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(columns, out_schema)], schema=out_schema)

    rows = held.drop("pairs", "counts").repartition(max(1, -(-held.count() // TASK_CHUNKS)), "chunk")
    return rows.join(sums.hint("merge"), "chunk", "left").drop("chunk").mapInArrow(finish, schema)
