"""Arithmetic of the router: association, weights, penalties, contrast."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds of association, specificity and contrast.
MIN_CORPUS_DOCS = 8
HUB_SHARE, HUB_WEIGHT = 0.6, 0.25
FREE_BREADTH, BREADTH_SLOPE = 0.06, 15.0


def npmi(n: Column, df_a: Column, df_b: Column, both: Column) -> Column:
    """Normalised pointwise mutual information in [-1, 1]; 0 while the corpus is too small."""
    n, df_a, df_b = (c.cast("double") for c in (n, df_a, df_b))
    joint = F.least(both.cast("double"), df_a, df_b, n)
    scale = -F.ln(joint / n)
    value = F.ln((joint / n) / ((df_a / n) * (df_b / n))) / scale
    return (
        F.when((n < MIN_CORPUS_DOCS) | (df_a <= 0) | (df_b <= 0), 0.0)
        .when(both <= 0, -1.0)
        .when(scale < 1e-9, 0.0)
        .otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))
    )


def npmi_to_weight(value: Column, df_dst: Column, n: Column) -> Column:
    """Negative association counts nothing; a hub in most documents is held down."""
    hub = df_dst.cast("double") / n.cast("double") > HUB_SHARE
    return F.when(value <= 0, 0.0).when(hub, F.least(value, F.lit(HUB_WEIGHT))).otherwise(value)


def rescale_weight(weight: Column, c: float) -> Column:
    if c >= 1:
        return F.lit(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (weight - F.lit(c)) / F.lit(1.0 - c)))


def specificity(breadth: Column) -> Column:
    over = breadth - F.lit(FREE_BREADTH)
    return F.when(over <= 0, 1.0).otherwise(F.lit(1.0) / (F.lit(1.0) + F.lit(BREADTH_SLOPE) * over))


def evidence_factor(n_docs: Column) -> Column:
    return F.lit(1.0) + F.lit(0.08) * F.log1p(n_docs.cast("double"))


def luminance(r: Column, g: Column, b: Column) -> Column:
    def linear(v: Column) -> Column:
        s = v / F.lit(255.0)
        return F.when(s <= 0.03928, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * linear(r) + 0.7152 * linear(g) + 0.0722 * linear(b)


def contrast(a: Column, b: Column) -> Column:
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def penalty(*costs: Column) -> Column:
    total = F.lit(0)
    for c in costs:
        total = total + c
    return F.greatest(F.lit(0), F.lit(100) - total)
