"""Tokens of two tokenizers against a plain walk over bytes."""

from __future__ import annotations

import collections
import hashlib
import os
import random

import numpy as np
import pytest

from lodegraph.llm import alignment, queries

from ..conftest import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(alignment.FOLDER), reason="no tokenizers")


def plain(texts):
    """Everything per text by definition: owners of each byte, ids from the libraries' plain calls."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(f"{alignment.FOLDER}/{alignment.BYTE_LEVEL}")
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=f"{alignment.FOLDER}/{alignment.PIECES}")
    alphabet, rows, counts = alignment.byte_level_alphabet(), [], collections.Counter()
    for text in texts:
        a = a_side.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        a_bytes = [bytes(alphabet[c] for c in a_side.id_to_token(i)) for i in a]
        names = [b_side.id_to_piece(i) for i in b]
        b_bytes = [bytes([int(x[3:5], 16)]) if b_side.is_byte(i) else x.replace("▁", " ").encode() for i, x in zip(b, names)]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            rows.append((0, 0, 0, [], ""))
            continue
        own_a = [k for k, x in enumerate(a_bytes) for _ in x]
        own_b = [k for k, x in enumerate(b_bytes) for _ in x]
        links = sorted(set(zip(own_a, own_b)))
        groups, start = [], (0, 0)
        for at in range(1, len(whole) + 1):
            if at == len(whole) or (own_a[at] != own_a[at - 1] and own_b[at] != own_b[at - 1]):
                stop = (own_a[at - 1] + 1, own_b[at - 1] + 1)
                groups.append("|".join(",".join(map(str, ids[x:y])) for ids, x, y in zip((a, b), start, stop)))
                start = stop
        pairs = [(a[i], b[j]) for i, j in links]
        counts.update(pairs)
        rows.append((len(a), len(b), len(groups), pairs, ";".join(groups)))
    best = collections.defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [
        (n_a, n_b, n_g, len(pairs), sum(counts[p] == best[p[1]] for p in pairs), sum(counts[p] for p in pairs), groups)
        for n_a, n_b, n_g, pairs, groups in rows
    ]


def hard_texts():
    rng = random.Random(3)
    signs = ["a", "the", "Ünï", "é", "𝒳", "漢字", " ", "  ", "\n", "\t", "<|endoftext|>", "<s>", "<0x41>", " ", "1234", "!?", "ﬁ", "\x00", "é"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    return [*texts, None, "", " ", "\n", "a▁b", "▁", texts[0], texts[0], "word " * 20_000, "x" * 30_000, "ÿ" * 5_000]


SCHEMA = "doc_id long, text string, chunk string, pairs string, a string"


def test_against_a_walk_over_bytes(spark, monkeypatch):
    """Odd characters, special tokens' strings, texts without tokens, repeated rows, long texts, clashing columns; small chunks."""
    texts = hard_texts()
    docs = spark.createDataFrame([(None if i == 3 else i, t, "x", "y", "z") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    want = [(None if i == 3 else i, *r) for i, r in enumerate(plain(texts))]
    got = [tuple(r) for r in alignment.align(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in want) > 50 and any(r[6] > r[4] for r in want)


def test_a_word_is_cut_once(monkeypatch):
    """Words are told from whole texts by their tokens alone, whatever white space parts them and however few are remembered."""
    both = alignment.Pair()
    asked, encode = [], both.encode
    monkeypatch.setattr(both, "encode", lambda words: asked.extend(words) or encode(words))
    rng = random.Random(5)
    signs = ["a", "the", "don't", "Ünï", ";", " ", "  ", "\n", "\n ", " \n", "\r\n", "\t", "\xa0", "\u2003", "\x1c", "\x85", "}"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    for held in (3, 150_000):
        monkeypatch.setattr(alignment, "HELD_WORDS", held)
        known = alignment.Words(both)
        asked.clear()
        for at in range(0, 300, 20):
            part = [*texts[at : at + 20], "a▁b", ""]
            for text, numbers in zip(part, known.numbers(part)):
                want = both.a.encode_ordinary(" " + text), both.b.encode(text)
                assert [known.of(x, numbers).tolist() for x in "ab"] == (list(want) if text and "▁" not in text else [[], []])
    assert both.by_words and len(asked) == len(set(asked))


def test_empty_table(spark):
    none = alignment.align(spark.createDataFrame([], SCHEMA))
    assert none.collect() == [] and none.columns[-1] == "groups"


@pytest.mark.parametrize("seed", range(20))
def test_links_of_any_cuts(seed):
    """Groups with several tokens on both sides, by random cuts of the same bytes."""
    rng = random.Random(seed)
    size = rng.randint(1, 60)
    a, b = (np.array(sorted({*rng.sample(range(1, size + 1), rng.randint(1, size)), size})) for _ in range(2))
    own = lambda ends: np.searchsorted(ends, np.arange(size), "right")
    want = sorted(set(zip(own(a).tolist(), own(b).tolist())))
    cuts = alignment.cuts(a, b)
    cuts = [np.array(x) for x in cuts]
    assert a[cuts[0] - 1].tolist() == b[cuts[1] - 1].tolist() == sorted({*a.tolist()} & {*b.tolist()})
    assert sorted(zip(*(x.tolist() for x in alignment.expand(a, b, *cuts)))) == want


def test_query_over_whole_tables(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    want = dict(zip(texts, plain(texts.values())))
    rows = queries.op13_alignment(spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        digest = hashlib.sha256(want[r["doc_id"]][-1].encode()).hexdigest() if r["n_a"] else ""
        assert tuple(r)[1:] == (*want[r["doc_id"]][:-1], digest)
