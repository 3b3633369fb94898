"""Porter's stems of English words, for rows and as SQL, from the same tables of rules.

A word's vowels are ``aeiou`` and a ``y`` after a consonant.  ``m`` counts the
runs of vowels that consonants follow; conditions on it are patterns on what
stands before an ending.  Words of up to two letters, and words with other signs
than ``a-z``, stay as they are.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
M0 = f"^({_C})?{_V}{_C}"  # m > 0
M1 = f"^({_C})?{_V}{_C}{_V}{_C}"  # m > 1
JUST1 = f"^({_C})?{_V}{_C}({_V})?$"  # m = 1
VOWEL = f"^({_C})?[aeiouy]"
#: Consonant, vowel, consonant other than w, x, y at the end.
CVC = "^[^aeiou][^aeiouy]*[aeiouy][^aeiouwxy]$"
ANY = ""

# Porter's endings in the order of his paper (condition before the ending, ending, replacement).
# Of each table only the first rule with a fitting ending counts, whether its condition holds or not.
PLURALS = ((ANY, "sses", "ss"), (ANY, "ies", "i"), (ANY, "ss", "ss"), (ANY, "s", ""))
LONG = (
    (M0, "ational", "ate"), (M0, "tional", "tion"), (M0, "enci", "ence"), (M0, "anci", "ance"), (M0, "izer", "ize"),
    (M0, "bli", "ble"), (M0, "alli", "al"), (M0, "entli", "ent"), (M0, "eli", "e"), (M0, "ousli", "ous"),
    (M0, "ization", "ize"), (M0, "ation", "ate"), (M0, "ator", "ate"), (M0, "alism", "al"), (M0, "iveness", "ive"),
    (M0, "fulness", "ful"), (M0, "ousness", "ous"), (M0, "aliti", "al"), (M0, "iviti", "ive"), (M0, "biliti", "ble"),
    (M0, "logi", "log"),
)
SHORT = (
    (M0, "icate", "ic"), (M0, "ative", ""), (M0, "alize", "al"), (M0, "iciti", "ic"), (M0, "ical", "ic"),
    (M0, "ful", ""), (M0, "ness", ""),
)
LAST = (
    (M1, "al", ""), (M1, "ance", ""), (M1, "ence", ""), (M1, "er", ""), (M1, "ic", ""), (M1, "able", ""),
    (M1, "ible", ""), (M1, "ant", ""), (M1, "ement", ""), (M1, "ment", ""), (M1, "ent", ""), (M1, "ion", ""),
    (M1, "ou", ""), (M1, "ism", ""), (M1, "ate", ""), (M1, "iti", ""), (M1, "ous", ""), (M1, "ive", ""), (M1, "ize", ""),
)
AT_END = "[st]$"  # what stands before -ion
DOUBLES = "(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$"


class _Words:
    """Operations on a word by the names that the rules use."""

    case = staticmethod(lambda pairs, other: next((v for c, v in pairs if c), other))
    matches = staticmethod(lambda w, pattern: re.search(pattern, w) is not None)
    ends = staticmethod(lambda w, end: w.endswith(end))
    cut = staticmethod(lambda w, n: w[: max(len(w) - n, 0)])
    add = staticmethod(lambda w, end: w + end)
    both = staticmethod(lambda a, b: a and b)
    no = staticmethod(lambda a: not a)


class _Arrays:
    """The same for many words at once: a word is a function from the places of words to these words.

    A case asks a condition only of what no condition before it took, and makes its values only for what it takes.
    """

    matches = staticmethod(lambda w, pattern: lambda at: _mask(pc.match_substring_regex(w(at), pattern)))
    ends = staticmethod(lambda w, end: lambda at: _mask(pc.ends_with(w(at), end)))
    cut = staticmethod(lambda w, n: lambda at: pc.utf8_slice_codeunits(w(at), 0, -n))
    add = staticmethod(lambda w, end: lambda at: pc.binary_join_element_wise(w(at), end, ""))
    no = staticmethod(lambda a: lambda at: ~a(at))

    @staticmethod
    def both(a, b):
        def holds(at):
            found = a(at)
            found[found] = b(at[found])
            return found

        return holds

    @staticmethod
    def case(pairs, other):
        def chosen(at):
            left, places, values = np.arange(len(at)), [], []
            for condition, value in pairs:
                if not len(left):
                    break
                holds = condition(at[left])
                if holds.any():
                    places.append(left[holds])
                    values.append(value(at[left[holds]]))
                    left = left[~holds]
            places.append(left)
            values.append(other(at[left]))
            return pa.concat_arrays(values).take(pa.array(np.argsort(np.concatenate(places))))

        return chosen


def _mask(found: pa.Array) -> np.ndarray:
    return found.to_numpy(zero_copy_only=False).copy()


class _Sql:
    """The same as DuckDB's SQL."""

    case = staticmethod(lambda pairs, other: "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {other} END")
    matches = staticmethod(lambda w, pattern: f"regexp_matches({w}, '{pattern}')")
    ends = staticmethod(lambda w, end: f"ends_with({w}, '{end}')")
    cut = staticmethod(lambda w, n: f"left({w}, greatest(length({w}) - {n}, 0)::BIGINT)")
    add = staticmethod(lambda w, end: f"({w} || '{end}')")
    both = staticmethod(lambda a, b: f"({a} AND {b})")
    no = staticmethod(lambda a: f"(NOT {a})")


def _table(o, w, rules):
    """One step: the first fitting ending decides; the longest stands first where one ends in another."""
    pairs = []
    for condition, ending, replacement in sorted(rules, key=lambda r: -len(r[1])):
        stem = o.cut(w, len(ending))
        new = o.add(stem, replacement)
        fits = [o.matches(stem, condition)] if condition else []
        if ending == "ion":
            fits.append(o.matches(stem, AT_END))
        holds = fits[0] if len(fits) == 1 else o.both(*fits) if fits else None
        pairs.append((o.ends(w, ending), new if holds is None else o.case([(holds, new)], w)))
    return o.case(pairs, w)


def _mended(o, w):
    """After -ed and -ing: an e comes back, or a doubled consonant goes."""
    return o.case(
        [
            (o.matches(w, "(at|bl|iz)$"), o.add(w, "e")),
            (o.matches(w, DOUBLES), o.cut(w, 1)),
            (o.matches(w, CVC), o.add(w, "e")),
        ],
        w,
    )


def steps(o) -> list:
    """The steps as functions of a word, in order."""

    def past(w):
        eed, ed, ing = o.ends(w, "eed"), o.ends(w, "ed"), o.ends(w, "ing")
        return o.case(
            [
                (eed, o.case([(o.matches(o.cut(w, 3), M0), o.cut(w, 1))], w)),
                (o.both(ed, o.matches(o.cut(w, 2), VOWEL)), _mended(o, o.cut(w, 2))),
                (o.both(ing, o.matches(o.cut(w, 3), VOWEL)), _mended(o, o.cut(w, 3))),
            ],
            w,
        )

    def silent_e(w):
        stem = o.cut(w, 1)
        goes = o.case([(o.matches(stem, M1), stem), (o.both(o.matches(stem, JUST1), o.no(o.matches(stem, CVC))), stem)], w)
        return o.case([(o.ends(w, "e"), goes)], w)

    return [
        lambda w: _table(o, w, PLURALS),
        past,
        lambda w: o.case([(o.both(o.ends(w, "y"), o.matches(o.cut(w, 1), VOWEL)), o.add(o.cut(w, 1), "i"))], w),
        lambda w: _table(o, w, LONG),
        lambda w: _table(o, w, SHORT),
        lambda w: _table(o, w, LAST),
        silent_e,
        lambda w: o.case([(o.both(o.ends(w, "ll"), o.matches(w, M1)), o.cut(w, 1))], w),
    ]


PLAIN = "^[a-z][a-z][a-z]+$"


def stem(word: str) -> str:
    if re.search(PLAIN, word):
        for one in steps(_Words):
            word = one(word)
    return word


def stems(words: pa.Array) -> pa.Array:
    """``stem`` of each word; nulls stay."""
    plain = _mask(pc.fill_null(pc.match_substring_regex(words, PLAIN), False))
    found = words.filter(pa.array(plain))
    for one in steps(_Arrays):
        found = one(lambda at, known=found: known.take(pa.array(at)))(np.arange(len(found)))
    return pc.replace_with_mask(words, pa.array(plain), found)


def stemmed(words: DataFrame, column: str) -> DataFrame:
    """The rows of ``words`` with the column replaced by its stems.

    As a map over Arrow batches: as expressions the steps would be spelled out within each other wherever the optimizer
    puts a filter on the result.
    """
    place = words.columns.index(column)

    def run(batches):
        for batch in batches:
            coded = batch.column(place).dictionary_encode()
            found = stems(coded.dictionary).take(coded.indices)
            yield pa.RecordBatch.from_arrays([found if i == place else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return words.mapInArrow(run, words.schema)


def stem_sql(source: str, column: str, name: str) -> str:
    """CTEs ending in ``name`` (column, stem) over the words of ``source``."""
    ctes, before = [f"{name}_0 AS (SELECT DISTINCT {column}, {column} AS w FROM {source})"], f"{name}_0"
    for i, one in enumerate(steps(_Sql), 1):
        ctes.append(
            f"{name}_{i} AS (SELECT {column}, CASE WHEN regexp_matches({column}, '{PLAIN}') THEN {one('w')} ELSE {column} END AS w FROM {before})"
        )
        before = f"{name}_{i}"
    ctes.append(f"{name} AS (SELECT {column}, w AS stem FROM {before})")
    return ",\n".join(ctes)

