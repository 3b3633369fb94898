"""Result pages of search engines as rows: one per result, in the page's order.

An engine is a row of facts: which element opens a result, in which element of it
the link stands (empty: anywhere), and which element holds the summary.  One
reader serves all engines: the page is cut at each opening tag, and of every
piece the first link and the summary are taken.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MARK
from ..functions.web import decode_entities, is_junk, strip_tags, unwrap_redirect


class Engine(NamedTuple):
    name: str
    result: tuple[str, str]
    within: str
    summary: tuple[str, str]


# Element and class names of the engines' pages.
ENGINES = (
    Engine("duckduckgo", ("a", "result__a"), "", ("a", "result__snippet")),
    Engine("bing", ("li", "b_algo"), "h2", ("div", "b_caption")),
    Engine("mojeek", ("a", "title"), "", ("p", "s")),
)
LONGEST_SUMMARY = 300


def opening(tag: str, name: str) -> str:
    """A regex for the opening tag of an element that has the class ``name`` among its classes."""
    return rf'(?i:<{tag}\s)[^>]*(?<=\s)class="(?:[^"]*\s)?{name}(?:\s[^"]*)?"[^>]*>'


def inner(html: Column, start: str, tag: str) -> Column:
    """What stands between the first match of ``start`` and the next closing ``tag``."""
    return F.regexp_extract(html, rf"(?s){start}(.*?)(?i:</{tag}\s*>)", 1)


def plain(html: Column) -> Column:
    return F.trim(F.regexp_replace(decode_entities(strip_tags(html)), r"\s+", " "))


def _read(engine: Engine):
    def row(piece: Column) -> Column:
        place = inner(piece, rf"(?i:<{engine.within}\b)[^>]*>", engine.within) if engine.within else piece
        link = F.regexp_extract(place, r"(?is)<a\s[^>]*>", 0)
        return F.struct(
            unwrap_redirect(F.regexp_extract(link, r'(?i)\shref="([^"]+)"', 1)).alias("url"),
            plain(inner(place, r"(?i:<a\s)[^>]*>", "a")).alias("title"),
            F.substring(plain(inner(piece, opening(*engine.summary), engine.summary[0])), 1, LONGEST_SUMMARY).alias("snippet"),
        )

    return row


def _pieces(html: Column, engine: Engine) -> Column:
    """The page from each result's opening tag to the next one's: one pass marks the tags, then the page is cut at the marks."""
    marked = F.split(F.regexp_replace(html, f"({opening(*engine.result)})", f"{MARK}$1"), MARK)
    return F.slice(marked, 2, 2**30)


def results(pages: DataFrame, engine: Column, html: Column) -> DataFrame:
    """The columns of ``pages`` but the html, with rank (from 1), url, title and snippet of each result.

    Links without a title and junk links are no results; a page of an unknown engine has none.
    """
    found = F.lit(None)
    for e in ENGINES:
        found = F.when(engine == e.name, F.transform(_pieces(html, e), _read(e))).otherwise(found)
    good = F.filter(found, lambda r: (r["title"] != "") & (r["url"] != "") & ~is_junk(r["url"]))
    keep = [c for c in pages.columns if c != "html"]
    # an outer explode: the plain one lets the optimizer repeat the reading in a filter below
    cut = pages.select(*keep, F.posexplode_outer(good).alias("place", "r")).where("r is not null")
    return cut.select(*keep, (F.col("place") + 1).alias("rank"), "r.url", "r.title", "r.snippet")
