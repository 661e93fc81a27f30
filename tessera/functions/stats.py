"""Ratios and confidence intervals as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

Z = 1.959963984540054


def ratio(hits: Column, total: Column, empty: float = 1.0) -> Column:
    """hits / total; ``empty`` where the total is 0."""
    return F.when(total == 0, F.lit(empty)).otherwise(hits / F.nullif(total, F.lit(0)))


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn)


def harmonic(a: Column, b: Column) -> Column:
    """0 if either is 0 or less."""
    return F.when((a <= 0) | (b <= 0), F.lit(0.0)).otherwise(2 * a * b / F.nullif(a + b, F.lit(0.0)))


def wilson(hits: Column, total: Column, z: float = Z) -> Column:
    """struct<point, lower, upper, total>: the Wilson score interval, within 0 to 1; 0 and [0, 1] without any trial."""
    n = F.nullif(total.cast("double"), F.lit(0.0))
    p = hits / n
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    centre, scale = p + z * z / (2 * n), 1 + z * z / n
    return F.struct(
        F.coalesce(p, F.lit(0.0)).alias("point"),
        F.coalesce(F.greatest(F.lit(0.0), (centre - spread) / scale), F.lit(0.0)).alias("lower"),
        F.coalesce(F.least(F.lit(1.0), (centre + spread) / scale), F.lit(1.0)).alias("upper"),
        total.alias("total"),
    )


def rate_interval(rate: Column, total: Column) -> Column:
    """The interval of a measured rate; the count is rounded half to even."""
    return wilson(F.bround(rate * total).cast("long"), total)


def f1_interval(p: Column, r: Column) -> Column:
    """From two intervals: point and bounds are the harmonic means of theirs, the total is the smaller."""
    return F.struct(
        harmonic(p["point"], r["point"]).alias("point"), harmonic(p["lower"], r["lower"]).alias("lower"), harmonic(p["upper"], r["upper"]).alias("upper"), F.least(p["total"], r["total"]).alias("total")
    )
