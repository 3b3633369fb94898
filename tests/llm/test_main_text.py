"""Main text of pages: reader, trees, decoding and whole results."""

from __future__ import annotations

import html
import itertools
import math
import os
import random
import re

import numpy as np
import pytest

from lodegraph.llm import boosting, dom, main_text, queries
from lodegraph.llm.dom import TEXT

from ..conftest import DATA

SCHEMA = "page_id long, url string, html string, text string, _html string, nodes string"


def runs(page):
    return [x.text for x in dom.parse(page) if x.tag == TEXT]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("<p>a<p>b</p>c", ["a", "b", "c"]),
        ("<p><b>a<br><p>b", ["a", "b"]),
        ("<script>var t='</p>';</script><p>a <i>b</i>\n&nbsp; c&#8212;d</p>", ["a b c—d"]),
        ("<style>p{}</style><!-- <p>x</p> --><title>t</title>a<!-- open", ["a"]),
        ("<ul><li>a<li>b<ul><li>c</ul>d</ul>", ["a", "b", "c", "d"]),
        ("<table><tr><td>a<td>b<tr><td><div>c</td></table>d", ["a", "b", "c", "d"]),
        ("<b><p>one</b> two</p>", ["one two"]),
        ("a < b <3 <div x='>' class=\"q\">c</div", ["a < b <3", "c"]),
        ("</p></div></article>a</span>b", ["ab"]),
        ("<DIV><P>A</P></DIV><textarea><p>b</p></textarea>", ["A"]),
        ("<head><title>x</title><meta a=b></head><body>y", ["y"]),
        ("<h2>a</h3>b", ["a", "b"]),
    ],
)
def test_reader(page, want):
    assert runs(page) == want


def test_reader_of_deep_and_wide_pages_is_linear():
    assert runs("<div>" * 50_000 + "a" + "</p>" * 50_000 + "</div>" * 60_000 + "b") == ["a", "b"]
    assert len(runs("<p>x" * 50_000)) == 50_000


def test_attribute_tokens_and_links():
    nodes = dom.parse('<div class="siteHeader main_menu" id=top style="display: none"><a href=x>one</a> two</div>three')
    assert set(nodes[1].tokens) == {"site", "header", "main", "menu", "top", "hidden"}
    assert [(x.text, x.link) for x in nodes if x.tag == TEXT] == [("one two", 3), ("three", 0)]


def test_trees_learn_what_no_single_feature_tells():
    rng = np.random.default_rng(1)
    rows = rng.random((3000, 5))
    labels = ((rows[:, 0] > 0.5) ^ (rows[:, 1] > 0.5)).astype(int) + (rows[:, 2] > 0.9)
    model = boosting.fit(rows[:2000], labels[:2000], np.ones(2000), classes=3, share=0.8)
    p = np.exp(model.log_probabilities(rows[2000:]))
    assert np.allclose(p.sum(axis=1), 1)
    assert (p.argmax(axis=1) == labels[2000:]).mean() > 0.95
    same = boosting.fit(rows[:2000], labels[:2000], np.ones(2000), classes=3, share=0.8)
    assert np.array_equal(model.leaf, same.leaf) and np.array_equal(model.cut, same.cut)


@pytest.mark.parametrize("seed", range(25))
def test_decoding_is_the_best_without_contradictions(seed):
    """Against all labellings of a small tree."""
    rng = random.Random(seed)
    nodes = [dom.Node("html", -1, 0)]
    for i in range(1, 8):
        p = rng.choice([j for j in range(i) if nodes[j].tag != TEXT])
        nodes.append(dom.Node(TEXT if rng.random() < 0.5 else "div", p, 0, (), "x"))
        nodes[p].children.append(i)
    rows = [[0.0] if x.tag == TEXT or any(y.parent == i for y in nodes) or rng.random() < 0.5 else None for i, x in enumerate(nodes)]
    rows[0] = [0.0]
    for i in range(7, 0, -1):  # a node with a row has parents with rows
        rows[nodes[i].parent] = rows[nodes[i].parent] if rows[i] is None else [0.0]
    places = [i for i, r in enumerate(rows) if r is not None]
    scores = [[math.log(x / sum(w)) for x in w] for w in ([rng.random() + 0.01 for _ in range(3)] for _ in places)]
    found, best = main_text.decode(nodes, rows, scores), -math.inf
    value = lambda kinds: sum(s[k] for s, k in zip(scores, kinds))
    for kinds in itertools.product(range(3), repeat=len(places)):
        kind = dict(zip(places, kinds))
        fits = all(
            not (nodes[i].tag == TEXT and kind[i] == main_text.MIXED)
            and (i == 0 or kind[nodes[i].parent] in (main_text.MIXED, kind[i]))
            for i in places
        )
        best = max(best, value(kinds)) if fits else best
    assert value([found[i] for i in places]) == pytest.approx(best)
    assert all(found[i] == -1 for i in range(len(nodes)) if i not in places)


@pytest.fixture(scope="module")
def model(spark):
    return main_text.fit(spark.read.parquet(f"{DATA}/pages.parquet"))


def test_drawn_pages_not_learned_from(model):
    drawn, exact, wrong, total = main_text.Drawn(4711, []), 0, 0, 0
    for _ in range(200):
        nodes = dom.parse(drawn.page())
        want = main_text.marked_kinds(nodes)
        (got,) = model.kinds([nodes])
        miss = [a != b for x, a, b in zip(nodes, want, got) if x.tag == TEXT]
        exact, wrong, total = exact + (not any(miss)), wrong + sum(miss), total + len(miss)
    assert exact >= 180 and wrong / total < 0.01


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_query_gives_every_article_whole(spark):
    """Articles cut out of the tables' pages with plain expressions, text block by text block."""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    rows = queries.op11_main_text(spark, DATA).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search("<article>(.*?)(</article>|<footer|$)", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", body)]
        assert r["text"] == "\n\n".join(b for b in blocks if b)
        assert r["n_chars"] == len(r["text"])


def test_other_layouts(model):
    """Notices, forms, side bars and comments go, whatever tags hold them; the article stays whole."""
    words = main_text.Drawn(5, [])
    body = [words.sentences(2, 5) for _ in range(5)]
    page = (
        f'<body><div class="cookie-consent"><p>{words.sentences(2, 2)}</p><button>Ok</button></div>'
        f'<div id="header"><a href=/>{words.phrase(2, 2)}</a></div><div class="menu">{words.links(6, 6)}</div>'
        f'<div class="wrapper"><div class="post-content"><h1>{body[0]}</h1>'
        + "".join(f"<p>{x}</p>" for x in body[1:])
        + f'</div><div class="sidebar"><h3>{words.phrase(2, 2)}</h3>{words.links(5, 5)}</div></div>'
        f'<div class="comments"><div class="comment"><p>{words.sentences(2, 3)}</p></div><form>{words.phrase(3, 3)}</form></div>'
        f'<div class="footer">&copy; {words.sentences(1, 2)}</div>'
    )
    nodes = dom.parse(page)
    assert model.text(nodes, model.kinds([nodes])[0]) == "\n\n".join(body)


def test_edge_cases(spark, model):
    long_page = "<article>" + "<p>Long text it is, and on it goes.</p>" * 20_000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<"), (4, "u", "<div><nav>"), (5, "u", long_page), (5, "u", long_page), (None, None, None)]
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA).repartition(2)
    got = main_text.extract(df, model, ["page_id", "url"]).collect()
    assert sorted(str((r["page_id"], r["url"])) for r in got) == sorted(str(r[:2]) for r in rows)
    texts = {r["page_id"]: r["text"] for r in got}
    assert texts[1] == texts[2] == texts[4] == texts[None] == ""
    assert texts[5] == "\n\n".join(["Long text it is, and on it goes."] * 20_000)
    none = spark.createDataFrame([], SCHEMA)
    assert main_text.extract(none, main_text.fit(none, drawn_pages=40), ["page_id"]).collect() == []
