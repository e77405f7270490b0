"""Numbers derived from other numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Expected share of clicks by position, the last for everything beyond.
CTR_STEPS = [(1, 0.28), (2, 0.15), (3, 0.11), (4, 0.08), (5, 0.06), (7, 0.04), (10, 0.025), (20, 0.012), (None, 0.005)]


def single(x: float) -> Column:
    """A single-precision number widened to double."""
    return F.lit(x).cast("float").cast("double")


def expected_ctr(position: Column) -> Column:
    """Expected share of clicks at an average position, single precision widened."""
    out = single(CTR_STEPS[-1][1])
    for top, ctr in reversed(CTR_STEPS[:-1]):
        out = F.when(position <= top, single(ctr)).otherwise(out)
    return F.when(position.isNotNull(), out)


def recoverable_clicks(impressions: Column, clicks: Column, position: Column) -> Column:
    """Expected clicks, rounded, less the actual ones; not below 0."""
    lost = F.round(impressions * expected_ctr(position)).cast("long") - clicks
    return F.when(lost.isNotNull(), F.greatest(lost, F.lit(0)))


def percent_delta(now: Column, before: Column) -> Column:
    """Change in percent, truncated toward zero; null without a base."""
    return F.when(before != 0, ((now - before) * 100 / before).cast("long"))


def demand(impressions: Column) -> Column:
    """Impressions by ten, at most 100."""
    return F.when(impressions.isNotNull(), F.least(F.floor(impressions / 10), F.lit(100))).cast("int")


def position_gap(best: Column) -> Column:
    """Five per place beyond the tenth, at most 100; 0 up to it or without a position."""
    return F.when(best > 10, F.round(F.least((best - 10) * 5, F.lit(100.0)))).otherwise(0).cast("int")


def expected_value(clicks: Column, value: Column, confidence: Column, effort: Column) -> Column:
    """Clicks x value x confidence by effort, whole numbers; defaults 50, effort at least 1."""
    v, c = F.least(F.coalesce(value, F.lit(50)), F.lit(100)), F.least(F.coalesce(confidence, F.lit(50)), F.lit(100))
    e = F.least(F.greatest(F.coalesce(effort, F.lit(50)), F.lit(1)), F.lit(100))
    return F.floor(clicks * v * c / e).cast("long")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / F.nullif(norm, F.lit(0.0)))


def trust_rank(confidence: Column, risk: Column) -> Column:
    """3 if confidence (40 or more) and risk (70 or less) are known and good, 2 if one is
    and the other unknown, 1 if neither is known, else 0."""
    sure, safe = confidence >= 40, risk <= 70
    return F.when(sure & safe, 3).when(sure & risk.isNull(), 2).when(confidence.isNull() & safe, 2).when(confidence.isNull() & risk.isNull(), 1).otherwise(0)
