"""Expressions on payloads of models and tools: tolerant JSON, keys, context blocks, replies, templates."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cues of a reply that asks instead of acting.
PERMISSION_CUES = (
    r"(?i)\b(would you like|do you want|should i|shall i|let me know if|can i (?:proceed|go ahead)|"
    r"is (?:that|this) (?:ok|okay|fine|alright))\b"
)
# Tags that make a script look like markup in code.
JSX_CUES = (
    r"<[A-Z][\w.]*[\s/>]|<(?:div|span|form|input|button|p|h[1-6]|ul|ol|li|a|img|section|header|footer|main|nav|"
    r"label|textarea|select)\b[^>]*/?>"
)
# Parts of speech that make a word a subject, and those that do not; others do not vote.
SUBJECT_POS, SUBJECT_POS_PREFIX = ("proper noun", "name"), "noun"
GLUE_POS = "article preposition pronoun conjunction auxiliary determiner particle adverb".split()
# The assistant's own tools, which are no topic to learn.
OWN_TOOLS = ("list_files", "read_file", "write_file", "edit_file", "verify")


#: Pieces of a payload: a string in quotes of either kind, a bracket or mark, a run of anything else, a stray quote.
_PIECE = r"""(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'|[{}\[\],:]|[^{}\[\],:"']++|["']"""


def loose_json(raw: Column) -> Column:
    """A variant of what a reply holds as JSON, or null.

    The reply itself may be JSON.  Else its first object or list is read piece by
    piece up to the bracket that closes it, whatever stands around it; strings in
    single quotes are put into double ones, and commas before a closing bracket go.
    """
    pieces = F.regexp_extract_all(F.regexp_extract(raw, r"(?s)[{\[].*", 0), F.lit(_PIECE), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("stop"))

    def walk(state, piece):
        depth = state["depth"] + F.when(piece.isin("{", "["), 1).when(piece.isin("}", "]"), -1).otherwise(0)
        stop = F.when((state["stop"] == 0) & (depth == 0), state["at"] + 1).otherwise(state["stop"])
        return F.struct(depth.alias("depth"), (state["at"] + 1).alias("at"), stop.alias("stop"))

    whole = F.slice(pieces, F.lit(1), F.aggregate(pieces, start, walk)["stop"])
    told = F.filter(whole, lambda p: F.trim(p) != "")
    quoted = lambda p: F.concat(
        F.lit('"'), F.replace(F.replace(F.substring(p, F.lit(2), F.length(p) - 2), F.lit("\\'"), F.lit("'")), F.lit('"'), F.lit('\\"')), F.lit('"')
    )
    kept = F.filter(told, lambda p, i: ~((p == ",") & F.coalesce(F.get(told, i + 1).isin("}", "]"), F.lit(False))))
    mended = F.transform(kept, lambda p: F.when(p.startswith("'") & (F.length(p) > 1), quoted(p)).otherwise(p))
    return F.coalesce(F.try_parse_json(F.trim(raw)), F.try_parse_json(F.array_join(mended, "")))


def masked_key(key: Column) -> Column:
    """How a credential may be shown: never whole; references to the environment are no secret."""
    return (
        F.when(key.isNull() | (key == ""), "(none)")
        .when(F.lower(key).startswith("env:"), key)
        .when(F.length(key) <= 8, "••••")
        .otherwise(F.concat(F.substring(key, 1, 3), F.lit("…"), F.substring(key, -4, 4)))
    )


def context_block(prompt: Column) -> Column:
    """What a prompt hands on as context: its fenced part, else what follows the context heading; or null."""
    blank = r"^\s+|\s+$"
    fenced = F.regexp_replace(F.regexp_extract(prompt, r"(?s)<<<UNTRUSTED\n(.*?)\nUNTRUSTED>>>", 1), blank, "")
    headed = F.regexp_replace(F.regexp_extract(prompt, r"(?s)# CONTEXT[^\n]*\n(.*)$", 1), blank, "")
    return F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(headed, F.lit("")))


def exposed_name(server: Column, tool: Column) -> Column:
    clean = [F.regexp_replace(x, r"[^a-zA-Z0-9_]", "_") for x in (server, tool)]
    return F.concat_ws("__", *clean)


def dumps_code(reply: Column) -> Column:
    """Does a reply hold more than 200 characters from its first code fence on, closed or not?"""
    body = F.regexp_replace(F.regexp_extract(reply, r"(?is)```[a-z]*\n(.*)", 1), r"^\s+|\s+$", "")
    return F.length(body) > 200


def asks_permission(reply: Column) -> Column:
    return reply.rlike(PERMISSION_CUES)


def looks_like_jsx(script: Column) -> Column:
    return script.rlike(JSX_CUES)


def pos_vote(pos: Column) -> Column:
    """True: a subject; false: glue; null: a part of speech that says nothing."""
    low = F.lower(pos)
    glue = reduce(lambda a, b: a | b, [low.startswith(x) for x in GLUE_POS])
    return F.when(low.startswith(SUBJECT_POS_PREFIX) | low.isin(*SUBJECT_POS), True).when(glue, False)


def escape_html(text: Column) -> Column:
    out = text
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def filled(skeleton: str, values: dict[str, Column], arrays: tuple[str, ...] = ()) -> Column:
    """The skeleton with each ``{{name}}`` replaced by its escaped value, or by nothing where there is none.

    ``arrays``: names of values that are arrays of strings.  A block ``{{#x}} ... {{/x}}`` is repeated for each element of the longest array that it names; other values
    are the same in each repetition.
    """
    def flat(part: str, at: Column | None) -> list[Column]:
        out = []
        for i, piece in enumerate(re.split(r"\{\{(\w+)\}\}", part)):
            if i % 2 == 0:
                out.append(F.lit(piece))
                continue
            value, array = values.get(piece), piece in arrays
            if value is None:
                continue
            value = F.get(value, F.lit(0) if at is None else at) if array else value
            out.append(escape_html(F.coalesce(value, F.lit(""))))
        return out

    def repeated(part: str):
        return lambda at: F.concat(*flat(part, at))

    parts: list[Column] = []
    for i, piece in enumerate(re.split(r"\{\{#\w+\}\}(.*?)\{\{/\w+\}\}", skeleton, flags=re.DOTALL)):
        if i % 2 == 0:
            parts += flat(piece, None)
            continue
        sizes = [F.size(values[k]) for k in re.findall(r"\{\{(\w+)\}\}", piece) if k in arrays]
        longest = F.greatest(*sizes, F.lit(0)) if sizes else F.lit(0)
        every = F.when(longest > 0, F.sequence(F.lit(0), longest - 1)).otherwise(F.array().cast("array<int>"))
        parts.append(F.array_join(F.transform(every, repeated(piece)), ""))
    return F.concat(*parts)


def short_count(n: Column) -> Column:
    """999, 1.2k, 3.4M; tenths are rounded half up."""

    def tenths(unit: int, mark: str) -> Column:
        t = F.floor((n + F.lit(unit // 20)) / F.lit(unit // 10)).cast("long")
        return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"), F.lit(mark))

    return (
        F.when(n >= 1_000_000, tenths(1_000_000, "M")).when(n >= 1_000, tenths(1_000, "k")).otherwise(n.cast("string"))
    )


def short_duration(ms: Column) -> Column:
    """999ms, 1.2s, 3m 4s."""
    t, s = F.floor((ms + 50) / 100).cast("long"), F.floor((ms % 60_000 + 500) / 1000).cast("string")
    seconds = F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"), F.lit("s"))
    minutes = F.concat(F.floor(ms / 60_000).cast("string"), F.lit("m "), s, F.lit("s"))
    return F.when(ms < 1_000, F.concat(ms.cast("string"), F.lit("ms"))).when(ms < 60_000, seconds).otherwise(minutes)


def bounded(text: Column) -> Column:
    """Lower-cased text with a mark at both ends of each run of ASCII letters and digits."""
    return F.regexp_replace(F.lower(text), r"([a-z0-9]+)", "\u0001$1\u0001")


def contains_term(text: Column, term: Column) -> Column:
    """Does the term stand in the text, not inside a longer word?"""
    return (F.trim(term) != "") & F.contains(bounded(text), bounded(F.trim(term)))


def embedding_text(*parts: Column) -> Column:
    """Non-blank parts, joined as they are embedded."""
    return F.concat_ws(" — ", *[F.when(F.trim(p) != "", p) for p in parts])
