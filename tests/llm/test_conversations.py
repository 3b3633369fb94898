"""Repair of conversations: brute force over edits, defined cases, blocks."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

from lodegraph.llm import conversations
from lodegraph.llm.conversations import BLANK, DUPLICATE, SOUND, TRUNCATED

SCHEMA = "conv_id long, turn long, role string, text string, kind string, report string, copies string"


def brute_edits(rows):
    """Least (cost, audit) and roles, by a search over (row, roles so far) without any state machine."""
    done, heap = set(), [(0, "", 0, "")]
    while heap:
        cost, audit, at, roles = heapq.heappop(heap)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit
        if (at, roles, audit) in done or len(roles) > len(rows) + 4:
            continue
        done.add((at, roles, audit))
        moves = [(2, "I", at, roles + x) for x in "ua"]
        if at < len(rows):
            initial, fault = rows[at]
            moves.append((3, "D", at + 1, roles))
            if fault not in (BLANK, DUPLICATE):
                extra = int(fault == TRUNCATED)
                moves += [(2 + extra, "R", at + 1, roles + x) for x in "ua"] + [(extra, "K", at + 1, roles + (initial or "?"))]
        for price, letter, then, now in moves:
            if re.fullmatch("s?(ua)*u?", now):
                heapq.heappush(heap, (cost + price, audit + letter, then, now))


@pytest.mark.parametrize("seed", range(60))
def test_cheapest_edits_against_a_search(seed):
    rng = random.Random(seed)
    rows = [(rng.choice("suaux"), rng.choice([SOUND, SOUND, SOUND, BLANK, DUPLICATE, TRUNCATED])) for _ in range(seed % 6)]
    for block in (1, 2, 3, 64):
        assert conversations.cheapest(rows, block) == brute_edits(rows)


@pytest.mark.parametrize("seed", range(10))
def test_blocks_change_nothing(seed):
    rng = random.Random(seed)
    rows = [(rng.choice("suaa"), rng.choice([SOUND] * 4 + [BLANK, TRUNCATED])) for _ in range(150)]
    whole = conversations.cheapest(rows, 1000)
    assert all(conversations.cheapest(rows, block) == whole for block in (1, 2, 7, 64))


def plain(rows):
    """The whole contract over (conv_id, turn, role, text) rows in Python."""
    out = {}
    for conv_id in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in (r for r in rows if r[0] == conv_id):
            name = lambda x: " " if x is None else str(x)
            kind = zlib.crc32(f"{name(conv_id)}:{name(turn)}".encode()) % 20
            role, text = name(role), name(text)
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            row = (turn, "user" if kind == 4 else role, text)
            kept += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        seen, judged = set(), []
        for turn, role, text in kept:
            words = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = BLANK if not words else DUPLICATE if (role, text) in seen else SOUND if words[-1] in ".!?" else TRUNCATED
            seen.add((role, text))
            judged.append((role[:1], fault))
        cost, audit = conversations.cheapest(judged)
        roles, lines, at = "", [], 0
        for letter in audit:
            free = "assistant" if roles.endswith("u") else "user"
            role, text = ("", "") if letter == "I" else kept[at][1:]
            at += letter != "I"
            if letter != "D":
                role = role if letter == "K" else free
                roles += role[0]
                lines.append(f"{role}:{text}")
        turns = [r[0] for r in kept if r[0] is not None]
        out[conv_id] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *[sum(f == x for _, f in judged) for x in (BLANK, DUPLICATE, TRUNCATED)],
            sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:])),
            cost,
            audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def hard_rows():
    rng = random.Random(4)
    texts = ["Is it?", "It is.", "so", " \t\n", "", None, "It is. \n", "é𝒳!", "x" * 200_000 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", None, "", "User", "tool"]
    rows = [(i, t, rng.choice(roles), rng.choice(texts)) for i in range(80) for t in range(rng.randint(0, 9))]
    rows += [(500, t, "user" if t % 2 else "assistant", f"{t}." if t % 9 else "cut") for t in range(1, 400)]
    rows += [(600, t % 3, "user", "Same.") for t in range(40)] + [(600, 1, "user", "Other.")] * 3
    rows += [(None, rng.choice([None, 1, 2, 9]), rng.choice(roles), rng.choice(texts)) for _ in range(20)]
    rows += [(700, None, "user", "It?"), (700, None, "assistant", "So."), (701, 2**40, "user", "Far."), (701, -5, "system", "Be.")]
    return rows


def repaired(spark, rows, parts=5):
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA).repartition(parts)
    damaged = conversations.damage(df)
    return conversations.digests(conversations.repair(damaged, conversations.reports(damaged, df)))


def test_against_plain_python(spark):
    """Nulls, empty and long texts, ties, repeated rows, odd roles, a long conversation, clashing columns."""
    rows = hard_rows()
    got = {r["conv_id"]: tuple(r)[1:] for r in repaired(spark, rows).collect()}
    assert got == plain(rows)


def test_empty_table_and_conversations_without_rows(spark):
    assert repaired(spark, []).collect() == []
    gone = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    (row,) = repaired(spark, [(1, gone, "user", "It.")]).collect()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_rows_are_well_formed(spark):
    """The operator's own output: rows in order, made by the edits that the report names; without damage nulls are spaces."""
    turns = spark.createDataFrame([r for r in hard_rows() if r[0] != 500], "conv_id long, turn long, role string, text string")
    rows = conversations.repair(turns, conversations.reports(turns)).collect()
    heads = [i for i, r in enumerate(rows) if r["place"] == 0]
    for a, b in zip(heads, heads[1:] + [len(rows)]):
        body = rows[a + 1 : b]
        assert [r["place"] for r in body] == list(range(1, len(body) + 1))
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in body))
        assert "".join(r["edit"] for r in body) == rows[a]["report"]["audit"].replace("D", "")
        assert all(r["text"] == "" for r in body if r["edit"] == "I")
