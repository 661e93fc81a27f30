"""The history and the metrics kept up to date from streams; on closed input they equal the batch results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.functions import severity
from tessera.operators.history import IDENTITY


def history_updates(sightings: DataFrame) -> DataFrame:
    """A stateful aggregate by identity (output mode update or complete): what ``consolidate`` gives, but for reasons."""
    return sightings.groupBy(*IDENTITY).agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), severity.by_rank(F.min(severity.rank(F.col("severity")))).alias("severity"), F.sum("occurrences").alias("occurrences")
    )


def windowed_counts(events: DataFrame, time: str, late: str = "10 minutes", width: str = "1 hour", *by: str) -> DataFrame:
    """Counts per tumbling window, with a watermark so that state is dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))
