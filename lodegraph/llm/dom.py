"""Pages as trees of blocks: a tolerant reader of HTML and the features of its nodes.

Nodes are elements that break lines, and runs of text between such breaks.
Inline elements are no nodes, but text inside links is counted.  Comments,
scripts, styles, the head's title and other content that no page shows are left
out.  The reader never fails: tags left open are closed where HTML closes them,
stray end tags are passed over, a cut page ends where it ends.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content is no text of the page, up to the end tag.
UNSEEN = frozenset("script style title textarea iframe noembed noframes xmp template svg math object audio video canvas".split())
BLOCKS = frozenset(
    "html body address article aside blockquote button center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup legend li main menu nav noscript ol option p pre section select summary "
    "table tbody td tfoot th thead tr ul caption hr".split()
)
#: A start tag of these ends an open paragraph.
ENDS_P = BLOCKS - frozenset("html body button caption dd dt legend li noscript option select tbody td tfoot th thead tr".split())
#: What a start tag ends, and where the search for it stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: End tags do not reach beyond these.
WALLS = frozenset({"table", "td", "th", "caption"})
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_SPACES = re.compile(f"[{SPACE}]+")
_PIECE = re.compile(r"<!--|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>?")
_NAMING = re.compile(r"(class|id|role|itemprop|aria-label|style|hidden)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_TOKEN = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
#: Signs that end sentences, for the density of punctuation.
_STOPS = re.compile(r"[.!?。！？]")
TEXT = "#text"


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    tokens: tuple[str, ...] = ()
    text: str = ""
    link: int = 0  # characters inside links, of a run
    children: list[int] = field(default_factory=list)


def attribute_tokens(attributes: str) -> tuple[str, ...]:
    """Lower-case words of class, id, role, itemprop and aria-label; hidden elements have the word ``hidden``."""
    found: list[str] = []
    for m in _NAMING.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "style":
            if name == "hidden" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                found.append("hidden")
        else:
            found += [x.lower() for x in _TOKEN.findall(value)]
    return tuple(dict.fromkeys(found))


def parse(page: str) -> list[Node]:
    """Nodes in page order, parents first; node 0 is the page."""
    nodes = [Node("html", -1, 0)]
    stack, open_tags, pieces = [0], {"html": 1}, []
    link_depth, head = None, False  # depth of the block in which a link is open

    def flush():
        text = _SPACES.sub(" ", "".join(p for p, _ in pieces)).strip(" ")
        if text:
            linked = sum(len(p) for p, in_link in pieces if in_link)
            nodes[stack[-1]].children.append(len(nodes))
            nodes.append(Node(TEXT, stack[-1], len(stack), (), text, min(linked, len(text))))
        pieces.clear()

    def pop():
        nonlocal link_depth
        open_tags[nodes[stack.pop()].tag] -= 1
        if link_depth is not None and len(stack) < link_depth:
            link_depth = None

    def end(tags, walls):
        """Closes the nearest open element of ``tags`` that no wall hides."""
        if any(open_tags.get(t) for t in tags):
            for i in range(len(stack) - 1, 0, -1):
                tag = nodes[stack[i]].tag
                if tag in tags:
                    flush()
                    while len(stack) > i:
                        pop()
                    return True
                if tag in walls:
                    return False
        return False

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        text = page[at : lt if lt >= 0 else size]
        if text and not head:
            pieces.append((html.unescape(text), link_depth is not None))
        if lt < 0:
            break
        m = _PIECE.match(page, lt)
        if m is None:
            if not head:
                pieces.append(("<", link_depth is not None))
            at = lt + 1
            continue
        at = m.end()
        if m[0] == "<!--":
            stop = page.find("-->", lt + 2)
            at = size if stop < 0 else stop + 3
            continue
        name = m[2] or m[5]
        if name is None:
            continue
        closing, tag, attributes = m[1] or m[4], name.lower(), m[3] or m[6] or ""
        if tag in UNSEEN:
            if not closing and not attributes.endswith("/"):
                stop = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>?", re.I).search(page, at)
                at = size if stop is None else stop.end()
        elif tag == "head":
            head = not closing
        elif tag == "a":
            link_depth = None if closing else len(stack)
        elif tag == "br":
            pieces.append((" ", False))
        elif tag in ("html", "body"):
            head = False
            if not closing and tag == "body" and not open_tags.get("body"):
                flush()
                nodes[stack[-1]].children.append(len(nodes))
                nodes.append(Node("body", stack[-1], len(stack), attribute_tokens(attributes)))
                stack.append(len(nodes) - 1)
                open_tags["body"] = 1
        elif tag in BLOCKS:
            head = False
            if closing:
                if tag[0] == "h" and len(tag) == 2 and tag != "hr":
                    end({"h1", "h2", "h3", "h4", "h5", "h6"}, WALLS)
                else:
                    end({tag}, WALLS - {tag})
                flush()
                continue
            if tag in ENDS_P:
                end({"p"}, WALLS | {"button"})
            if tag in ENDS:
                end(*ENDS[tag])
            flush()
            if tag not in VOID:
                nodes[stack[-1]].children.append(len(nodes))
                nodes.append(Node(tag, stack[-1], len(stack), attribute_tokens(attributes) if attributes else ()))
                stack.append(len(nodes) - 1)
                open_tags[tag] = open_tags.get(tag, 0) + 1
    flush()
    return nodes


#: Tags that have a feature of their own.
NAMED_TAGS = (
    "article main section div p h1 h2 li ul nav header footer aside form table td blockquote pre figure figcaption button "
    "noscript dl body #text"
).split()
_HOLDS = ("article", "main")
_APART = ("nav", "header", "footer", "aside", "form", "noscript", "dialog", "button", "select")
NUMBERS = (
    "chars words mean_word link_share elements density stops blocks block_chars p_share h_count depth order siblings place "
    "parent_share before after largest start apart holds own_good own_bad near_good near_bad path_good path_bad sibling_tag"
).split()
FEATURES = (*NUMBERS, *NAMED_TAGS, *(f"in_{t}" for t in NAMED_TAGS))


def features(nodes: list[Node], odds: dict[str, float]) -> list[list[float]]:
    """One row per node: densities of its subtree, attribute tokens by their ``odds``, depth, and figures of its siblings.

    A node without any text below has no row (None).
    """
    n = len(nodes)
    chars, words, linked, stops = [0] * n, [0] * n, [0] * n, [0] * n
    runs, in_p, heads, elements, start = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    seen = 0
    for i, x in enumerate(nodes):
        start[i] = seen
        if x.tag == TEXT:
            chars[i], words[i], linked[i], runs[i] = len(x.text), x.text.count(" ") + 1, x.link, 1
            stops[i] = len(_STOPS.findall(x.text))
            in_p[i] = chars[i] if nodes[x.parent].tag == "p" else 0
            seen += chars[i]
        else:
            elements[i] = 1
            heads[i] = x.tag in ("h1", "h2", "h3")
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        for sums in (chars, words, linked, stops, runs, in_p, heads, elements):
            sums[p] += sums[i]
    log, rows = math.log1p, []
    apart, holds, good, bad = [0] * n, [0] * n, [0.0] * n, [0.0] * n
    place_of = {t: i for i, t in enumerate(NAMED_TAGS)}
    largest = [max([chars[c] for c in x.children], default=0) for x in nodes]
    order = [0] * n
    for x in nodes:
        for k, c in enumerate([c for c in x.children if chars[c]]):
            order[c] = k
    text_children = [sum(1 for c in x.children if chars[c]) for x in nodes]
    total = max(chars[0], 1)
    last_with_text: dict[int, int] = {}
    following = [0] * n
    for i in range(n - 1, 0, -1):
        following[i] = last_with_text.get(nodes[i].parent, 0)
        if chars[i]:
            last_with_text[nodes[i].parent] = chars[i]
    before: dict[int, tuple[int, str]] = {}
    for i, x in enumerate(nodes):
        p = x.parent
        known = [odds[t] for t in x.tokens if t in odds]
        own_good, own_bad = max(known, default=0.0), min(known, default=0.0)
        up = p if p >= 0 else i
        apart[i] = apart[up] + (x.tag in _APART) if i else 0
        holds[i] = holds[up] + (x.tag in _HOLDS) if i else 0
        good[i], bad[i] = (max(good[up], own_good), min(bad[up], own_bad)) if i else (own_good, own_bad)
        if not chars[i]:
            rows.append(None)
            continue
        size, count = chars[i], elements[i] + 1
        near = [odds[t] for t in nodes[up].tokens if t in odds]
        earlier, earlier_tag = before.get(p, (0, ""))
        before[p] = (size, x.tag)
        row = [
            log(size), log(words[i]), size / words[i], linked[i] / size, log(elements[i]), log(size / count),
            stops[i] / words[i], log(runs[i]), log(size / runs[i]), in_p[i] / size, log(heads[i]), x.depth,
            order[i], text_children[up], order[i] / max(text_children[up] - 1, 1), size / max(chars[up], 1),
            log(earlier), log(following[i]), size / max(largest[up], 1) if i else 1.0, start[i] / total,
            apart[i], holds[i], own_good, own_bad, max(near, default=0.0), min(near, default=0.0), good[i], bad[i],
            float(earlier_tag == x.tag),
        ]
        tags = [0.0] * (2 * len(NAMED_TAGS))
        if x.tag in place_of:
            tags[place_of[x.tag]] = 1.0
        if nodes[up].tag in place_of:
            tags[len(NAMED_TAGS) + place_of[nodes[up].tag]] = 1.0
        rows.append(row + tags)
    return rows
