"""Severity as a small dimension: rank (critical is smallest), quality weight and attention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Name, rank, weight in the quality score, attention in the history.
SEVERITIES = (("critical", 0, 25, 5.0), ("high", 1, 15, 4.0), ("medium", 2, 5, 3.0), ("low", 3, 2, 2.0), ("info", 4, 0, 1.0))


def dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SEVERITIES), "severity string, rank int, weight int, attention double")


def _lookup(column: Column, at: int, default) -> Column:
    out = None
    for row in SEVERITIES:
        out = F.when(column == row[0], row[at]) if out is None else out.when(column == row[0], row[at])
    return out.otherwise(F.lit(default))


def parse(column: Column) -> Column:
    """Lenient: trimmed, any case; anything else is info."""
    lowered = F.lower(F.trim(column))
    return F.when(lowered.isin(*[s[0] for s in SEVERITIES]), lowered).otherwise("info")


def rank(column: Column) -> Column:
    return _lookup(column, 1, 4)


def weight(column: Column) -> Column:
    return _lookup(column, 2, 0)


def attention(column: Column) -> Column:
    return _lookup(column, 3, 1.0)


def by_rank(column: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s[0]) for s in SEVERITIES]), column + 1)
