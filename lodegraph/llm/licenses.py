"""License scans by template-markup matching.

A template is a license's wording with two kinds of markup: ``<<opt>> ...
<</opt>>`` around words that may be left out, and ``<<var N>>`` where up to N
words of any kind may stand.  Each template compiles to a token automaton whose
states are places between words; a text is accepted where some run of its words
takes the automaton from start to end, so the mandatory wording must match word
for word.  A template's first words are mandatory; the automaton is started only
where they occur.

The map is narrow: no shuffle, no grouping, memory bounded by a chunk of texts.

Templates hold a license's whole mandatory wording or the whole notice that it
prescribes; words before and after a license are not judged.  The references to
GNU licenses and the proprietary reservation are shorter, as are all texts of
their kind.

Scores: 1 if a whole template is accepted, 0.5 if only a phrase names a
license, else 0.  Defined cases: null texts are empty and have no labels;
repeated rows are scanned each.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ALNUM_TABLE, chunks

#: The contract's phrases and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Pieces that several licenses share.
_LIABLE = (
    "whether in an action of contract tort or otherwise arising from out of or in connection with the software or "
    "the use or other dealings in the software"
)
_WARRANTY = (
    'the software is provided "as is" without warranty of any kind express or implied including but not limited to '
    "the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall "
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided "
    "that the following conditions are met <<opt>>1<</opt>> redistributions of source code must retain the "
    "above copyright notice this list of conditions and the following disclaimer <<opt>>2<</opt>> redistributions in "
    "binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in "
    "the documentation and or other materials provided with the distribution "
)
_BSD_ADVERTISING = (
    "<<opt>>3<</opt>> all advertising materials mentioning features or use of this software must display the "
    "following acknowledgement this product includes software developed by <<var 20>> "
)
_BSD_NAMES = (
    "<<opt>>3<</opt>> <<opt>>4<</opt>> neither the name of <<var 12>> nor the names of <<var 1>> contributors may be "
    "used to endorse or promote products derived from this software without specific prior written permission "
)
_BSD_DISCLAIMER = (
    'this software is provided by <<var 10>> "as is" and any express or implied warranties including but not limited '
    "to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event "
    "shall <<var 12>> be liable for any direct indirect incidental special exemplary or consequential damages "
    "including but not limited to procurement of substitute goods or services loss of use data or profits or business "
    "interruption however caused and on any theory of liability whether in contract strict liability or tort "
    "including negligence or otherwise arising in any way out of the use of this software even if advised of the "
    "possibility of such damage"
)
_GNU = (
    "is free software <<opt>>you can<</opt>> redistribute it and or modify it under the terms of the gnu {0} "
    "<<opt>>version <<var 2>><</opt>> as published by the free software foundation <<opt>>either<</opt>> "
    "<<opt>>version <<var 2>> of the license<</opt>> <<opt>>or at your option any later version<</opt>> "
    "<<var 3>> is distributed in the hope that it will be useful but without any warranty without even the implied "
    "warranty of merchantability or fitness for a particular purpose see the gnu {0} for more details"
)
_GNU_NAMES = (
    ("gpl", "general public license"),
    ("lgpl", "lesser general public license"),
    ("lgpl", "library general public license"),
    ("agpl", "affero general public license"),
)
_NC, _SA = ("noncommercial", "non commercial"), ("sharealike", "share alike")
_ND = ("noderivatives", "noderivs", "no derivatives", "no derivs", "no derivative works")
_CC_KINDS = (
    ("cc-by", ("",)),
    ("cc-by-nc", _NC),
    ("cc-by-sa", _SA),
    ("cc-by-nd", _ND),
    ("cc-by-nc-sa", tuple(f"{a} {b}" for a in _NC for b in _SA)),
    ("cc-by-nc-nd", tuple(f"{a} {b}" for a in _NC for b in _ND)),
)
_CC_PLACES = (
    "international", "unported", "generic", "igo", "united states", "us", "germany", "austria", "switzerland", "france",
    "italy", "spain", "portugal", "netherlands", "belgium", "luxembourg", "england wales", "england and wales", "uk",
    "scotland", "ireland", "denmark", "sweden", "norway", "finland", "poland", "czech republic", "greece", "romania",
    "croatia", "serbia", "estonia", "canada", "mexico", "brazil", "argentina", "chile", "australia", "new zealand",
    "japan", "south korea", "korea", "china mainland", "taiwan", "hong kong", "singapore", "india", "south africa",
)
_CC_VERSION = " ".join(f"<<opt>>{v}<</opt>>" for v in ("1 0", "2 0", "2 1", "2 5", "3 0", "4 0", *_CC_PLACES))


def spelled(wording: str) -> list[str]:
    """The wording without its quotes, as ASCII ones fall away, and with curly ones, which belong to their words."""
    curly = re.sub(r'"([^"]*)"', "\u201c\\1\u201d", wording)
    return list(dict.fromkeys([wording.replace('"', ""), curly]))


#: The whole mandatory wording of public licenses, or of the notice that a license prescribes, in lower
#: case without punctuation.
WORDINGS = (
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        'associated documentation files <<opt>>the "software"<</opt>> to deal in the software without restriction '
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or "
        "sell copies of the software and to permit persons to whom the software is furnished to do so subject to the "
        "following conditions the above copyright notice and this permission notice <<opt>>including the next "
        "paragraph<</opt>> shall be included in all copies or substantial portions of the software "
        + _WARRANTY
        + "<<var 8>> be liable for any claim damages or other liability "
        + _LIABLE,
    ),
    (
        "isc",
        "permission to use copy modify and <<opt>>or<</opt>> distribute this software for any purpose with or without "
        "fee is hereby granted provided that the above copyright notice and this permission notice appear in all "
        'copies the software is provided "as is" and <<var 6>> disclaims all warranties with regard to this software '
        "including all implied warranties of merchantability and fitness in no event shall <<var 6>> be liable for any "
        "special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or "
        "profits whether in an action of contract negligence or other tortious action arising out of or in connection "
        "with the use or performance of this software",
    ),
    ("bsd-2-clause", _BSD + _BSD_DISCLAIMER),
    ("bsd-3-clause", _BSD + _BSD_NAMES + _BSD_DISCLAIMER),
    ("bsd-4-clause", _BSD + _BSD_ADVERTISING + _BSD_NAMES + _BSD_DISCLAIMER),
    (
        "apache-2",
        'licensed under the apache license version 2 <<opt>>0<</opt>> the "license" you may not use '
        "<<var 4>> except in compliance with the license you may obtain a copy of the license at <<var 1>> www apache "
        "org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under "
        'the license is distributed on an "as is" basis without warranties or conditions of any kind either express or '
        "implied see the license for the specific language governing permissions and limitations under the license",
    ),
    *[(label, _GNU.format(name)) for label, name in _GNU_NAMES],
    *[(label, f"under the <<opt>>terms of the<</opt>> gnu {name}") for label, name in _GNU_NAMES],
    *[
        (label, f"licensed under <<var 1>> creative commons attribution {kind} {_CC_VERSION} license")
        for label, kinds in _CC_KINDS
        for kind in kinds
    ],
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish "
        "use compile sell or distribute this software either in source code form or as a compiled binary for any "
        "purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the "
        "author or authors of this software dedicate any and all copyright interest in the software to the public "
        "domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and "
        "successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and "
        "future rights to this software under copyright law "
        + _WARRANTY
        + "the authors be liable for any claim damages or other liability "
        + _LIABLE,
    ),
    ("proprietary", "all rights reserved <<var 6>> without <<var 2>> written permission"),
)
TEMPLATES = tuple((label, t) for label, wording in WORDINGS for t in spelled(wording))
ANY = None
MARKUP = re.compile(r"<<(/?opt|var)(?: (\d+))?>>")


class Automaton:
    """States 0 to ``end``; ``step[s]`` maps a word to the next state, ``free[s]`` is the state after any word."""

    def __init__(self, template: str):
        self.step: list[dict[bytes, int]] = [{}]
        self.free: list[int | None] = [ANY]
        self.skip: list[list[int]] = [[]]
        opened: list[int] = []
        at = 0
        for piece in re.split(r"(<<[^>]*>>)", template):
            mark = MARKUP.fullmatch(piece)
            if not mark:
                for word in piece.split():
                    self.step[at][word.encode()] = at = self._state()
            elif mark[1] == "opt":
                opened.append(at)
            elif mark[1] == "/opt":
                self.skip[opened.pop()].append(at)
            else:
                begin = [at]
                for _ in range(int(mark[2])):
                    self.free[at] = nxt = self._state()
                    at = nxt
                    begin.append(at)
                for s in begin[:-1]:
                    self.skip[s].append(at)
        self.end = at
        first = re.match(r"[^<]+", template)[0].split()
        self.anchor = " ".join(first).encode()

    def _state(self) -> int:
        self.step.append({})
        self.free.append(ANY)
        self.skip.append([])
        return len(self.step) - 1

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skip[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def accepts(self, words: list[bytes], start: int) -> int | None:
        """Where the shortest accepted run from ``start`` ends, or None."""
        states = self._closed({0})
        for i in range(start, len(words) + 1):
            if self.end in states:
                return i
            if i == len(words):
                break
            moved = {self.step[s][words[i]] for s in states if words[i] in self.step[s]}
            moved |= {self.free[s] for s in states if self.free[s] is not ANY}
            states = self._closed(moved)
            if not states:
                return None
        return None


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers where the phrase stands in `` w0 w1 ... ``."""
    out, at, needle = [], 0, b" " + phrase + b" "
    words, last = 0, 0
    while (at := joined.find(needle, at)) >= 0:
        words += joined.count(b" ", last, at)
        last = at
        out.append(words)
        at += 1
    return out


def scan_text(words: list[bytes], automata) -> tuple[list[tuple[int, str]], list[tuple[int, int, str]]]:
    """Phrase places (word, label) and accepted templates (start, end, label)."""
    joined = b" " + b" ".join(words) + b" "
    named = [(p, label) for phrase, label in PHRASES for p in places(joined, phrase.encode())]
    whole, starts = [], {}
    for label, automaton in automata:
        if automaton.anchor not in starts:
            starts[automaton.anchor] = places(joined, automaton.anchor)
        for start in starts[automaton.anchor]:
            if (end := automaton.accepts(words, start)) is not None:
                whole.append((start, end, label))
    return named, whole


MATCH = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())]))
MATCH_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("label", T.StringType()),
        ]
    )
)


def _scanner(templates, keep: list[str]):
    def run(batches):
        automata = [(label, Automaton(t)) for label, t in templates]
        size = {phrase: phrase.count(" ") + 1 for phrase, _ in PHRASES}
        by_label = {label: size[phrase] for phrase, label in PHRASES}
        for batch, texts in chunks(batches):
            counts = np.zeros(len(texts), dtype=np.int64)
            named, whole = [], []
            for i, text in enumerate(texts):
                words = text.translate(ALNUM_TABLE).split()
                counts[i] = len(words)
                a, b = scan_text(words, automata)
                named.append([{"start": p, "end": p + by_label[x], "label": x} for p, x in sorted(a)])
                whole.append([{"start": s, "end": e, "label": x} for s, e, x in sorted(b)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(counts), pa.array(named, MATCH), pa.array(whole, MATCH)],
                [*keep, "n_words", "phrases", "licenses"],
            )

    return run


def scan(docs: DataFrame, keep: list[str] | None = None, templates=TEMPLATES) -> DataFrame:
    """``docs`` (text, ...) with n_words, phrases and licenses: arrays of (start, end, label), in words, end exclusive."""
    new = ("n_words", "phrases", "licenses")
    keep = [c for c in (keep or docs.columns) if c not in new]
    schema = T.StructType(
        [docs.schema[c] for c in keep]
        + [
            T.StructField("n_words", T.LongType()),
            T.StructField("phrases", MATCH_TYPE),
            T.StructField("licenses", MATCH_TYPE),
        ]
    )
    through = list(dict.fromkeys([*keep, "text"]))
    return docs.select(*through).mapInArrow(_scanner(templates, keep), schema)


def template_regex(template: str) -> str:
    """The automaton's language over `` w0 w1 ... ``, as a regex for engines without automata."""
    out = []
    for piece in re.split(r"(<<[^>]*>>)", template):
        mark = MARKUP.fullmatch(piece)
        if not mark:
            out += [w + " " for w in piece.split()]
        elif mark[1] == "var":
            out.append("(?:[^ ]+ ){0,%s}" % mark[2])
        else:
            out.append("(?:" if mark[1] == "opt" else ")?")
    return " " + "".join(out)
