"""Arithmetic of endpoints and machines: addresses, placement, memory, lines of a report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# By kind of endpoint, the port and the path that are meant where none is given.
ENDPOINT_DEFAULTS = {"ollama": (11434, ""), "openai": (443, "/v1"), "anthropic": (443, "")}
# What a model needs beside its weights, and what else takes memory (MB).
WEIGHTS_FACTOR, CACHE_MB_PER_1000, BROWSER_MB = 1.2, 80.0, 450.0
PRIVATE_HOST = r"^(localhost|127\.0\.0\.1|10\..*|192\.168\..*|172\.(1[6-9]|2[0-9]|3[01])\..*)$"


def base_url(raw: Column, kind: Column) -> Column:
    """struct<url, warning>: scheme, port and path filled in by the kind; null where it is no http address."""
    port, path = (F.element_at(F.create_map(*[F.lit(x) for k, v in ENDPOINT_DEFAULTS.items() for x in (k, v[i])]), kind) for i in (0, 1))
    text = F.trim(raw)
    had = text.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://")
    rest = F.regexp_replace(text, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    authority = F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    typed = F.nullif(F.regexp_extract(authority, r":([0-9]+)$", 1), F.lit(""))
    scheme = F.when(had, F.lower(F.regexp_extract(text, r"^([^:]*)", 1))).otherwise(
        F.when(F.coalesce(typed.try_cast("int"), port) == 443, "https").otherwise("http")
    )
    host = F.regexp_replace(authority, r":[0-9]+$", "")
    usual = F.when(scheme == "https", "443").otherwise("80")
    given = F.coalesce(typed, F.when(~had & (port != 443), port.cast("string")), usual)
    shown = F.when(given == usual, F.lit("")).otherwise(F.concat(F.lit(":"), given))
    own = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    tail = F.when(own.isin("", "/"), path).otherwise(own)
    url = F.regexp_replace(F.concat(scheme, F.lit("://"), host, shown, tail), r"/+$", "")
    warning = F.when((scheme == "http") & ~host.rlike(PRIVATE_HOST), "the key would cross the network in clear text")
    return F.when(scheme.isin("http", "https") & (host != ""), F.struct(url.alias("url"), warning.alias("warning")))


def fits(model_gb: Column, gpu_gb: Column) -> Column:
    return F.coalesce((gpu_gb > 0) & (model_gb * WEIGHTS_FACTOR <= gpu_gb), F.lit(False))


def threads(percent: Column, cores: Column) -> Column:
    """Threads for a share of cores; null: let the server choose.  Clamped only where the cores are known."""
    want = F.greatest(F.lit(1), F.floor(percent / 100 + 0.5).cast("int"))
    return F.when(percent > 0, F.when(cores > 0, F.least(want, cores)).otherwise(want))


def order_matches(want: Column, have: Column) -> Column:
    nothing = want.isNull() | (F.size(want) == 0)
    return F.when(nothing, True).otherwise(F.coalesce(want == have, F.lit(False)))


def order_variable(order: Column, backend: Column) -> Column:
    name = F.when(backend.isin("rocm", "hip"), "ROCR_VISIBLE_DEVICES").otherwise("CUDA_VISIBLE_DEVICES")
    return F.when(F.size(order) > 0, F.concat(name, F.lit("="), F.array_join(order.cast("array<string>"), ",")))


def cache_mb(context: Column) -> Column:
    return context / 1000 * CACHE_MB_PER_1000


def memory(weights_mb: Column, context: Column, browser: Column, total_mb: Column, free_mb: Column) -> Column:
    """struct<total, fraction, over>: demand, its share of the machine, and whether what is still to be taken is free."""
    more = cache_mb(context) + F.when(browser, BROWSER_MB).otherwise(0.0)
    total = weights_mb + more
    return F.struct(total.alias("total"), (total / total_mb).alias("fraction"), (more > free_mb).alias("over"))


def left(text: Column, width: int) -> Column:
    return F.rpad(text, F.greatest(F.length(text), F.lit(width)), F.lit(" "))


def right(text: Column, width: int) -> Column:
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit(" "))


def health_line(engine: Column, ok: Column, results: Column, latency_ms: Column, error: Column) -> Column:
    parts = [
        F.concat(left(engine, 12), F.lit(" "), left(F.when(ok, "ok").otherwise("FAIL"), 5)),
        F.concat(right(results.cast("string"), 2), F.lit(" results")),
        F.concat(right(latency_ms.cast("string"), 5), F.lit("ms")),
        F.concat(F.lit("— "), error),
    ]
    return F.concat_ws(" ", *parts)
