"""Main text of web pages: boosted trees over the nodes of the page, decoded along its tree.

Every node with text (see ``dom``) is one of three kinds: all of its text is
main text, none of it is, or it holds both.  Boosted trees (see ``boosting``)
give each node the probability of each kind, from the density of its subtree,
the words of its class, id and role, its depth, its siblings and its ancestors.
Decoding takes the most probable kinds of all nodes together under one rule:
below a node of a pure kind all nodes are of that kind.  So no node contradicts
its ancestors or descendants, and a text is main text if and only if all that
holds it agrees.  Ties go to the main text.

Training pages: (1) a bounded sample of the table's own pages (``fit_pages`` with
the smallest hashes, of at most ``fit_chars`` characters each), where landmarks
tell the kinds: text in ``article`` or ``main``, outside of nested menus, asides,
headers, footers and forms, is main text; pages without landmarks teach nothing;
(2) ``drawn_pages`` pages drawn from layouts of our own with known kinds and
words of the sample, so that layouts without landmarks, with side bars, notices,
forms and reader comments are known too.  In a share of both kinds of pages tags
and class words are hidden from the trees, so that densities and places count.

Defined cases: null and empty pages give an empty text; a page without main text
too; rows are independent of each other, repeated rows give the same text;
without pages to learn from the drawn ones have words of their own.  Only
``html`` is read besides the columns that are kept.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import boosting, dom

MAIN, APART, MIXED = range(3)
#: Bounds of the sample, and pages drawn.
FIT_PAGES, FIT_CHARS, DRAWN_PAGES = 150, 100_000, 400
#: Stands at the front of main text in drawn pages.
MARK = "\ue000"
ROWS = 256

#: Class and id words of drawn pages, by what the part is.
WORDS = {
    "content": "article content post entry story body text main article-body post-content entry-content page-content",
    "wrap": "container wrapper page site layout row inner outer grid col",
    "head": "header masthead site-header top-bar banner logo",
    "nav": "nav menu navigation navbar main-menu breadcrumb breadcrumbs pagination pager links toc",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner-ad adsense",
    "side": "sidebar aside widget side secondary related recommended popular trending tags share social",
    "comments": "comments comment comment-list replies discussion responses reader-comments respond",
    "notice": "cookie notice consent banner alert gdpr popup modal overlay newsletter subscribe privacy",
    "form": "form search login signup subscribe contact newsletter-form",
    "foot": "footer site-footer copyright colophon legal bottom",
}
SYLLABLES = "ba ce di fo gu ha je ki lo mu ne pi ra so tu ve wi xo za an er in on st".split()


class Drawn:
    """Draws pages; all text that is marked is main text."""

    def __init__(self, seed: int, words: list[str]):
        self.rng = random.Random(seed)
        self.words = words or ["".join(self.rng.choices(SYLLABLES, k=self.rng.randint(1, 4))) for _ in range(500)]

    def phrase(self, low: int, high: int) -> str:
        return " ".join(self.rng.choices(self.words, k=self.rng.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        made = [self.phrase(2, 18) for _ in range(self.rng.randint(low, high))]
        return " ".join(s[:1].upper() + s[1:].rstrip(".,") + self.rng.choice("...?!") for s in made)

    def named(self, part: str, tag: str, inner: str) -> str:
        """An element with words of its part, sometimes only one of them or none."""
        chosen = self.rng.choice(WORDS[part].split())
        style = self.rng.random()
        if style < 0.2 and tag != "div":
            return f"<{tag}>{inner}</{tag}>"
        key = "id" if style > 0.85 else "class"
        more = f" {self.phrase(1, 1).lower()}" if style > 0.6 and key == "class" else ""
        return f'<{tag} {key}="{chosen}{more}">{inner}</{tag}>'

    def links(self, low=3, high=9) -> str:
        items = [f'<a href="/{i}">{self.phrase(1, 3)}</a>' for i in range(self.rng.randint(low, high))]
        return f"<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>" if self.rng.random() < 0.7 else " | ".join(items)

    def block(self) -> str:
        kind = self.rng.random()
        if kind < 0.7:
            text = MARK + self.sentences(1, 7)
            if self.rng.random() < 0.2:
                text = f"<b>{text}<br>"
            elif self.rng.random() < 0.2:
                text += f' <a href="/x">{self.phrase(1, 3)}</a> {self.phrase(1, 5)}.'
            return f"<p>{text}" + ("</p>" if self.rng.random() < 0.8 else "")
        if kind < 0.78:
            return f"<h2>{MARK}{self.phrase(1, 7)}</h2>"
        if kind < 0.86:
            return "<ul>" + "".join(f"<li>{MARK}{self.phrase(2, 20)}</li>" for _ in range(self.rng.randint(2, 6))) + "</ul>"
        if kind < 0.92:
            return f"<blockquote><p>{MARK}{self.sentences(1, 3)}</p></blockquote>"
        if kind < 0.96:
            return f"<pre>{MARK}{self.phrase(3, 30)}</pre>"
        cells = "".join(f"<tr><td>{MARK}{self.phrase(1, 3)}</td><td>{MARK}{self.phrase(1, 4)}</td></tr>" for _ in range(3))
        return f"<table>{cells}</table>"

    def ad(self) -> str:
        return self.named("ad", "div", self.sentences(1, 3) if self.rng.random() < 0.7 else f'<a href="/buy">{self.phrase(2, 8)}</a>')

    def notice(self) -> str:
        return self.named("notice", self.rng.choice(["div", "div", "section", "noscript"]), f"<p>{self.sentences(1, 4)}</p>" + (f"<button>{self.phrase(1, 2)}</button>" if self.rng.random() < 0.6 else ""))

    def form(self) -> str:
        return self.named("form", "form", f"<label>{self.phrase(1, 4)}</label><input name=q><button>{self.phrase(1, 2)}</button>" + (f"<p>{self.sentences(1, 2)}</p>" if self.rng.random() < 0.4 else ""))

    def side(self) -> str:
        parts = [f"<h3>{self.phrase(1, 3)}</h3>{self.links()}" for _ in range(self.rng.randint(1, 3))]
        if self.rng.random() < 0.5:
            parts.append(f"<p>{self.sentences(1, 4)}</p>")
        return self.named("side", self.rng.choice(["aside", "div", "div", "section"]), "".join(parts))

    def comments(self) -> str:
        item = self.rng.choice(["div", "li", "article"])
        one = lambda: f"<{item} class=\"comment\"><span>{self.phrase(1, 2)}</span><p>{self.sentences(1, 5)}</p></{item}>"
        made = "".join(one() for _ in range(self.rng.randint(1, 8)))
        return self.named("comments", self.rng.choice(["div", "section", "ol"]), f"<h3>{self.phrase(1, 2)}</h3>{made}" + (self.form() if self.rng.random() < 0.4 else ""))

    def maybe(self, chance: float, part: str) -> str:
        return part if self.rng.random() < chance else ""

    def page(self) -> str:
        rng = self.rng
        blocks = [self.block() for _ in range(rng.choice([1, 1, 2, 3, 4, 6, 9, 14, 25]))]
        if rng.random() < 0.15:
            blocks = [MARK + self.sentences(1, 6) + "<br>"]
        for part, chance in ((self.ad, 0.15), (self.side, 0.1), (self.notice, 0.05)):
            if rng.random() < chance:
                blocks.insert(rng.randint(0, len(blocks)), part())
        title = self.maybe(0.8, f"<h1>{MARK}{self.phrase(1, 12)}</h1>")
        tag = rng.choice(["article", "article", "main", "div", "div", "section"])
        body = self.named("content", tag, title + "".join(blocks) + self.maybe(0.1, self.named("side", "div", self.links(2, 5))))
        if rng.random() < 0.3:
            body = self.named("content", rng.choice(["main", "div"]), body + self.maybe(0.3, self.comments()))
        first = [
            self.maybe(0.5, self.named("head", rng.choice(["header", "div"]), f'<a href="/">{self.phrase(1, 3)}</a>' + self.maybe(0.4, f"<p>{self.phrase(2, 8)}</p>"))),
            self.maybe(0.7, self.named("nav", rng.choice(["nav", "nav", "div"]), self.links())),
            self.maybe(0.4, self.ad()),
            self.maybe(0.25, self.notice()),
            self.maybe(0.15, self.form()),
            self.maybe(0.2, self.side()),
        ]
        last = [
            self.maybe(0.35, self.comments()),
            self.maybe(0.35, self.side()),
            self.maybe(0.2, self.ad()),
            self.maybe(0.15, self.notice()),
            self.maybe(0.15, self.form()),
        ]
        foot = self.maybe(0.8, self.named("foot", rng.choice(["footer", "footer", "div"]), f"&copy; {self.phrase(1, 2)} &middot; {self.sentences(1, 2)}" + self.maybe(0.3, self.links(2, 5))))
        rng.shuffle(last)
        inner = "".join(first) + body + "".join(last) + foot
        for _ in range(rng.choice([0, 0, 1, 2])):
            inner = self.named("wrap", "div", inner)
        return f"<html><head><title>{self.phrase(1, 6)}</title></head><body>{inner}" + self.maybe(0.9, "</body></html>")


def landmark_kinds(nodes: list[dom.Node]) -> list[int] | None:
    """MAIN or APART per run by landmarks; None for a page that has none."""
    inside, barred = [False] * len(nodes), [False] * len(nodes)
    for i, x in enumerate(nodes[1:], 1):
        inside[i] = inside[x.parent] or x.tag in ("article", "main")
        barred[i] = barred[x.parent] or x.tag in ("nav", "aside", "header", "footer", "form", "noscript", "button", "select", "dialog")
    if not any(inside):
        return None
    return [(MAIN if a and not b else APART) if x.tag == dom.TEXT else -1 for x, a, b in zip(nodes, inside, barred)]


def marked_kinds(nodes: list[dom.Node]) -> list[int]:
    """MAIN for runs that hold the mark, which is taken away."""
    kinds = []
    for x in nodes:
        kinds.append((MAIN if MARK in x.text else APART) if x.tag == dom.TEXT else -1)
        x.text = x.text.replace(MARK, "")
    return kinds


def node_kinds(nodes: list[dom.Node], kinds: list[int]) -> list[int]:
    """Kinds of all nodes from those of the runs."""
    found = list(kinds)
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        if found[i] >= 0:
            found[p] = found[i] if found[p] in (-1, found[i]) else MIXED
    return found


@dataclass(frozen=True)
class Model:
    trees: boosting.Boosted
    odds: dict[str, float]

    def kinds(self, pages: list[list[dom.Node]]) -> list[list[int]]:
        """Decoded kinds of the nodes of pages; -1 without text."""
        rows = [dom.features(nodes, self.odds) for nodes in pages]
        flat = [r for page in rows for r in page if r is not None]
        scores = self.trees.log_probabilities(np.array(flat)) if flat else np.zeros((0, 3))
        out, at = [], 0
        for nodes, page in zip(pages, rows):
            own = sum(r is not None for r in page)
            out.append(decode(nodes, page, scores[at : at + own].tolist()))
            at += own
        return out

    def text(self, nodes: list[dom.Node], kinds: list[int]) -> str:
        return "\n\n".join(x.text for x, kind in zip(nodes, kinds) if x.tag == dom.TEXT and kind == MAIN)


def decode(nodes: list[dom.Node], rows: list, scores: list[list[float]]) -> list[int]:
    """The kinds of greatest joint probability such that all below a pure node are of its kind."""
    n, found = len(nodes), iter(scores)
    own = [next(found) if r is not None else None for r in rows]
    pure = [[0.0, 0.0] for _ in range(n)]
    best, mixed = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        if own[i] is None:
            continue
        for kind in (MAIN, APART):
            pure[i][kind] += own[i][kind]
        mixed[i] = float("-inf") if nodes[i].tag == dom.TEXT else mixed[i] + own[i][MIXED]
        best[i] = max(*pure[i], mixed[i])
        p = nodes[i].parent
        if p >= 0:
            for kind in (MAIN, APART):
                pure[p][kind] += pure[i][kind]
            mixed[p] += best[i]
    kinds = [-1] * n
    for i, x in enumerate(nodes):
        if own[i] is None:
            continue
        above = kinds[x.parent] if x.parent >= 0 else MIXED
        kinds[i] = above if above != MIXED else MAIN if pure[i][MAIN] >= best[i] else APART if pure[i][APART] >= best[i] else MIXED
    return kinds


def train(own: list[str], drawn_pages: int = DRAWN_PAGES, seed: int = 11) -> Model:
    """A model from landmarks of ``own`` pages and from drawn pages; deterministic."""
    rng, labelled = random.Random(seed), []
    words: list[str] = []
    for page in own:
        nodes = dom.parse(page)
        words += [w for x in nodes if x.tag == dom.TEXT for w in x.text.split()[:200]]
        if (kinds := landmark_kinds(nodes)) is not None:
            labelled.append((nodes, kinds))
    drawn = Drawn(seed, sorted(set(words))[:: max(len(set(words)) // 5000, 1)])
    for _ in range(drawn_pages):
        nodes = dom.parse(drawn.page())
        labelled.append((nodes, marked_kinds(nodes)))
    counts = {MAIN: Counter(), APART: Counter(), MIXED: Counter()}
    labelled = [(nodes, node_kinds(nodes, kinds)) for nodes, kinds in labelled]
    for nodes, kinds in labelled:
        for x, kind in zip(nodes, kinds):
            if kind >= 0:
                counts[kind].update(x.tokens)
    odds = {
        t: float(np.log((counts[MAIN][t] + 0.5 * counts[MIXED][t] + 1) / (counts[APART][t] + 1)))
        for t in sorted(set().union(*counts.values()))
        if sum(c[t] for c in counts.values()) >= 3
    }
    rows, targets, weights = [], [], []
    for nodes, kinds in labelled:
        hidden = rng.random()
        known = {} if hidden < 0.25 else odds
        made = dom.features(nodes, known)
        for row, kind in zip(made, kinds):
            if row is not None and kind >= 0:
                if 0.15 < hidden < 0.35:  # tags are hidden, but for what a run and a paragraph are
                    row[len(dom.NUMBERS) :] = [0.0] * (len(row) - len(dom.NUMBERS))
                    row[dom.NUMBERS.index("apart")] = row[dom.NUMBERS.index("holds")] = 0.0
                rows.append(row)
                targets.append(kind)
                weights.append(1.0)
    trees = boosting.fit(np.array(rows), np.array(targets), np.array(weights), classes=3)
    return Model(trees, odds)


def fit(pages: DataFrame, fit_pages: int = FIT_PAGES, fit_chars: int = FIT_CHARS, drawn_pages: int = DRAWN_PAGES) -> Model:
    """Trains on the bounded sample of ``pages`` and on drawn pages; see the module."""
    whole = pages.select("html").where(F.length("html").between(1, fit_chars))
    chosen = whole.select(F.xxhash64("html").alias("hash"), "html").orderBy("hash", "html").limit(fit_pages)
    return train(list(dict.fromkeys(r["html"] for r in chosen.collect())), drawn_pages)


def extract(pages: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns of ``keep`` and ``text``, one row per page."""
    schema = T.StructType([*[pages.schema[c] for c in keep], T.StructField("text", T.StringType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                nodes = [dom.parse(x or "") for x in part.column(part.num_columns - 1).to_pylist()]
                texts = [model.text(n, k) for n, k in zip(nodes, model.kinds(nodes))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], [*keep, "text"])

    return pages.select(*keep, F.col("html").alias("_html")).mapInArrow(read, schema)
