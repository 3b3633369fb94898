"""Registry of the library's own queries and their SQL oracles."""

from __future__ import annotations

from . import checks, events, fittings, graphs, indexed, learned, routing, lexical, payloads, stores, streams, texts  # noqa: F401
from .registry import ORACLES, QUERIES


def flagship(spark, sf_dir):
    return routing.routed(spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
