"""Secret scans with a trigram inverted index.

From each rule's regex a Boolean query over trigrams is derived: literal runs
must all occur, alternatives are or-ed, and what has no mandatory trigram is
true.  A task indexes its documents in segments (trigram -> documents that hold
it, over A-Z lower-cased bytes, only for trigrams that a rule asks for), answers
every rule's query by intersecting and uniting postings, and runs the regex over
the whole text of the documents left.  Rules without a query scan every text.

The map is narrow: no shuffle, no grouping, memory bounded by a segment.

Defined cases: null texts are empty and hold nothing; offsets count code
points, end exclusive; matches of one rule never overlap (leftmost first), those
of different rules may; repeated rows are scanned each.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import LOWER_TABLE, chunks


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    flags: int = re.ASCII
    #: A match counts only if this group has at least this many characters.
    group: int = 0
    least: int = 1


#: The contract's patterns and lengths.
BASE_RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        re.ASCII | re.IGNORECASE,
        2,
        6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", re.ASCII, 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: A private key after its BEGIN line: up to its END line, or where that is cut off, all lines of base64 and PEM headers.
_KEY_BODY = (
    r"(?:(?:(?!-----)[\s\S])*+-----END [A-Z ]{0,40}PRIVATE KEY-----"
    r"|(?:(?:[\s\"'>]|\\[nr])*+(?:[A-Z][A-Za-z0-9]*-[A-Z][A-Za-z-]*:[^\n]*|[A-Za-z0-9+/=]{16,}"
    r"|[A-Za-z0-9+/=]++(?=[ \t\"']*(?:\r?\n|\\[nr]|-----|\Z))))*)"
)
#: Public formats of well-known credentials.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----" + _KEY_BODY),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_password", r"[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/@]{1,64}@"),
)
RULES = BASE_RULES + MORE_RULES
REPLACEMENT = "[SECRET]"

SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
SPAN_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
        ]
    )
)

#: A query is True, a trigram, ("and", queries) or ("or", queries).
MOST_STRINGS = 64


def _all(queries: list):
    left = [q for q in queries if q is not True]
    return True if not left else left[0] if len(left) == 1 else ("and", left)


def _any(queries: list):
    return True if not queries or True in queries else queries[0] if len(queries) == 1 else ("or", queries)


def _of_strings(strings: set[str]):
    """Some one of the strings occurs."""
    each = []
    for s in sorted(strings):
        b = s.encode().translate(LOWER_TABLE)
        each.append(_all(sorted({b[i : i + 3] for i in range(len(b) - 2)})))
    return _any(each)


class Grammar:
    """The rules' regexes as trees: what demands nothing that an index could tell is ``("any",)``.

    Nodes: ("chars", characters), ("nothing",), ("any",), ("all", nodes), ("either", nodes), ("repeat", node, least, most).
    """

    def __init__(self, pattern: str):
        self.pattern, self.at = pattern, 0
        self.tree = self.either()

    def ahead(self) -> str:
        return self.pattern[self.at : self.at + 1]

    def take(self, expression: str) -> re.Match | None:
        found = re.compile(expression).match(self.pattern, self.at)
        self.at = found.end() if found else self.at
        return found

    def either(self):
        parts = [self.sequence()]
        while self.take(r"\|"):
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("either", parts)

    def sequence(self):
        nodes = []
        while self.ahead() not in ("", "|", ")"):
            node = self.atom()
            while bounds := self.take(r"([?*+])|\{(\d*)(,?)(\d*)\}"):
                sign, low, comma, high = bounds.groups()
                least = {"?": 0, "*": 0, "+": 1}[sign] if sign else int(low or 0)
                most = {"?": 1}.get(sign) if sign else (int(high) if high else None) if comma else least
                self.take(r"[?+]")  # lazy and possessive forms match no less
                node = ("repeat", node, least, most)
            nodes.append(node)
        return ("all", nodes)

    def atom(self):
        if group := self.take(r"\((\?(?:[=!]|<[=!]))?(?:\?:|\?P<\w+>)?"):
            inside = self.either()
            self.take(r"\)")
            return ("any",) if group[1] else inside
        if self.take(r"\[\^"):
            self.take(r"\]?(?:[^\]\\]|\\.)*\]")
            return ("any",)
        if members := self.take(r"\[(\]?(?:[^\]\\]|\\.)*)\]"):
            body = members[1]
            return ("any",) if re.search(r"\\[a-zA-Z]|.-.", body) else ("chars", set(re.sub(r"\\(.)", r"\1", body)))
        if self.take(r"[\^$]|\\[bBAZ]"):
            return ("nothing",)
        if code := self.take(r"\\x([0-9a-fA-F]{2})"):
            return ("chars", {chr(int(code[1], 16))})
        if self.take(r"\.|\\[dDsSwW]"):
            return ("any",)
        if escaped := self.take(r"\\(.)"):
            return ("chars", {{"n": "\n", "r": "\r", "t": "\t"}.get(escaped[1], escaped[1])})
        return ("chars", {self.take(r"(?s).")[0]})


def _demand(node, folded: bool) -> tuple[set[str] | None, object]:
    """The strings that a node matches, if few, and the query of what it demands otherwise."""
    kind = node[0]
    if kind == "chars":
        return (None, True) if folded and any(ord(c) > 127 for c in node[1]) else (node[1], True)
    if kind == "nothing":
        return {""}, True
    if kind == "either":
        parts = [_demand(x, folded) for x in node[1]]
        query = _any([q for _, q in parts])
        return (None, query) if any(s is None for s, _ in parts) else (set().union(*(s for s, _ in parts)), query)
    if kind == "repeat":
        _, body, least, most = node
        strings, query = _demand(body, folded)
        if strings is not None and most == 1:
            return strings | ({""} if least == 0 else set()), query if least else True
        return None, query if least else True
    if kind == "any":
        return None, True
    run, clauses, exact = {""}, [], True
    for x in node[1]:
        strings, query = _demand(x, folded)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        exact = False
        clauses += [_of_strings(run), query]
        run = strings if strings is not None and len(strings) <= MOST_STRINGS else {""}
    return (run, _of_strings(run)) if exact else (None, _all([*clauses, _of_strings(run)]))


def trigram_query(rule: Rule):
    """What must hold of a text's trigrams where the rule matches; True if nothing must."""
    return _demand(Grammar(rule.pattern).tree, bool(rule.flags & re.IGNORECASE))[1]


def trigrams_of(query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*(trigrams_of(q) for q in query[1]))


class Index:
    """Postings of the wanted trigrams over one segment after another."""

    def __init__(self, queries: list):
        self.wanted = sorted(set().union(*(trigrams_of(q) for q in queries)))
        self.number = np.zeros(1 << 24, dtype=np.uint16)
        for i, t in enumerate(self.wanted):
            self.number[t[0] << 16 | t[1] << 8 | t[2]] = i + 1

    def postings(self, texts: list[bytes]) -> dict[bytes, np.ndarray]:
        joined = np.frombuffer(b"\0\0\0".join(texts).translate(LOWER_TABLE), dtype=np.uint8)
        out = {t: np.zeros(len(texts), dtype=bool) for t in self.wanted}
        if len(joined) < 3:
            return out
        code = joined[:-2].astype(np.uint32) << 16
        code |= joined[1:-1].astype(np.uint32) << 8
        code |= joined[2:]
        number = self.number[code]
        places = np.flatnonzero(number)
        begins = np.cumsum([0] + [len(t) + 3 for t in texts[:-1]])
        docs, number = np.searchsorted(begins, places, side="right") - 1, number[places]
        for i, t in enumerate(self.wanted):
            out[t][docs[number == i + 1]] = True
        return out


def answer(query, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    if query is True:
        return np.ones(n, dtype=bool)
    if isinstance(query, bytes):
        return postings[query]
    parts = [answer(q, postings, n) for q in query[1]]
    return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)


def find(rule: Rule, compiled: re.Pattern, text: str):
    for m in compiled.finditer(text):
        if m.end(rule.group) - m.start(rule.group) >= rule.least:
            yield {"kind": rule.kind, "start": m.start(), "end": m.end()}


def redacted(text: str, spans: list[dict]) -> str:
    out, at = [], 0
    for span in spans:
        if span["start"] >= at:
            out += [text[at : span["start"]], REPLACEMENT]
        at = max(at, span["end"])
    return "".join([*out, text[at:]])


def _scanner(rules: tuple[Rule, ...], keep: list[str], redact: bool):
    def run(batches):
        queries = [trigram_query(r) for r in rules]
        compiled = [re.compile(r.pattern, r.flags) for r in rules]
        index = Index(queries)
        for batch, texts in chunks(batches):
            postings = index.postings(texts)
            spans: list[list[dict]] = [[] for _ in texts]
            decoded: dict[int, str] = {}
            for rule, regex, query in zip(rules, compiled, queries, strict=True):
                for doc in np.flatnonzero(answer(query, postings, len(texts))).tolist():
                    if doc not in decoded:
                        decoded[doc] = texts[doc].decode()
                    spans[doc] += find(rule, regex, decoded[doc])
            columns = {c: batch.column(c) for c in keep}
            dirty = [i for i, s in enumerate(spans) if s]
            for i in dirty:
                spans[i].sort(key=lambda x: x["start"])  # stable: ties stay in the rules' order
            if redact and dirty:
                clean = columns["text"].to_pylist()
                for i in dirty:
                    clean[i] = redacted(clean[i], spans[i])
                columns["text"] = pa.array(clean, batch.schema.field("text").type)
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(spans, SPAN)], [*keep, "secrets"])

    return run


def scan(
    docs: DataFrame, keep: list[str] | None = None, rules: tuple[Rule, ...] = RULES, redact: bool = False
) -> DataFrame:
    """``docs`` (text, ...) with secrets: array of (kind, start, end) by start, then in the rules' order.

    ``redact``: each run of found characters in ``text`` becomes ``[SECRET]``.
    ``keep``: columns to return, all by default (a column ``secrets`` is replaced).
    """
    keep = [c for c in (keep or docs.columns) if c != "secrets"]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("secrets", SPAN_TYPE)])
    through = list(dict.fromkeys([*keep, "text"]))
    return docs.select(*through).mapInArrow(_scanner(rules, keep, redact and "text" in keep), schema)
