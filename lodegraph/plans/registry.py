"""Queries and their oracles, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tok(c: str) -> str:
    """DuckDB: the tokens of a text."""
    return (
        rf"list_filter(list_transform(string_split_regex(lower({c}), '[^\p{{L}}\p{{N}}_+#.\-]+'), "
        r"lambda x: regexp_replace(x, '^[-.]+|[-.]+$', '', 'g')), lambda x: length(x) >= 2)"
    )


def first_distinct(c: str, most: int) -> str:
    """DuckDB: a list's first distinct elements in their order."""
    return f"list_filter({c}, lambda x, i: list_position({c}, x) = i)[:{most}]"
