"""Tool calls that a model wrote into its prose."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|$)|\\.|[{}]', re.DOTALL)
CALLS = pa.list_(pa.struct([("name", pa.string()), ("arguments", pa.string())]))


def objects(text: str):
    """Outermost ``{...}`` of a text; braces inside strings do not count, and one that never closes ends the scan."""
    depth = begin = 0
    for token in _TOKEN.finditer(text):
        if depth == 0 and token[0] != "{":
            continue
        if token[0] == "{":
            begin, depth = (token.start() if depth == 0 else begin), depth + 1
        elif token[0] == "}":
            depth -= 1
            if depth == 0:
                yield text[begin : token.end()]


def calls_of(text: str, names: frozenset[str]) -> list[dict]:
    found = []
    for part in objects(text):
        try:
            said = json.loads(part, strict=False)  # raw line ends in strings are forgiven
        except ValueError:
            continue
        inner = said.get("function") if isinstance(said.get("function"), dict) else {}
        name = said["name"] if isinstance(said.get("name"), str) else inner.get("name")
        given = said.get("arguments") if said.get("arguments") is not None else inner.get("arguments")
        if isinstance(name, str) and name in names:
            found.append({"name": name, "arguments": None if given is None else given if isinstance(given, str) else json.dumps(given)})
    return found


def recovered(rows: DataFrame, key: str, text: Column, names: tuple[str, ...]) -> DataFrame:
    """key, place (from 1), name, arguments (JSON): every call of a tool in ``names``, in the order of the text."""
    known = frozenset(names)

    def run(batches):
        for batch in batches:
            calls = [calls_of(t or "", known) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(calls, CALLS)], [key, "calls"])

    kind = dict(rows.dtypes)[key]
    found = rows.select(key, text.alias("_text")).mapInArrow(run, f"{key} {kind}, calls array<struct<name:string,arguments:string>>")
    cut = found.select(key, F.posexplode("calls").alias("at", "c"))
    return cut.select(key, (F.col("at") + 1).alias("place"), "c.name", "c.arguments")


def picked(arguments: Column, *keys: str) -> Column:
    """The first of ``keys`` that the arguments have (an object, or a string that holds one), as text; or null."""
    return F.coalesce(*[F.get_json_object(arguments, f"$.{k}") for k in keys])
