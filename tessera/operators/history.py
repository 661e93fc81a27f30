"""Accumulated history: merge by identity, time-decayed salience, top-N and recall."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions import severity
from tessera.functions.text import directory

IDENTITY = ("kind", "file_path", "rule_id")
HALF_LIFE_DAYS, FLOOR = 30.0, 0.15


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by ``order``, which must be total. Nothing is collected: ``min_by`` combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])


def deduplicate_findings(findings: DataFrame, arrival: str) -> DataFrame:
    """Per (rule_id, file_path, line_number) the most severe, then the earliest."""
    return first_of(findings, ["rule_id", "file_path", "line_number"], [severity.rank(F.col("severity")), F.col(arrival)])


def deduplicate(df: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    return first_of(df, keys, [F.col(arrival)])


def consolidate(*histories: DataFrame) -> DataFrame:
    """One row per identity: occurrences add up, first and last date widen, the worst severity and the latest written reason stay.

    Of several reasons with the latest date, the largest in text order is kept, so the result does not depend on row order.
    """
    rows = reduce(lambda a, b: a.unionByName(b), histories)
    written = F.col("reason") != ""
    merged = rows.groupBy(*IDENTITY).agg(
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        severity.by_rank(F.min(severity.rank(F.col("severity")))).alias("severity"),
        F.sum("occurrences").alias("occurrences"),
        F.coalesce(F.max(F.when(written, F.struct("last_seen", "reason")))["reason"], F.lit("")).alias("reason"),
    )
    return merged


def salience(today: Column) -> Column:
    """Occurrences x attention, halved for every 30 days since the last sighting; the future counts as today."""
    age = F.greatest(F.lit(0), F.datediff(today, F.col("last_seen")))
    return F.col("occurrences") * severity.attention(F.col("severity")) * F.pow(F.lit(0.5), age / F.lit(HALF_LIFE_DAYS))


def forget(history: DataFrame, today: Column, floor: float = FLOOR) -> DataFrame:
    return history.filter(salience(today) >= floor)


def retain(history: DataFrame, today: Column, limit: int) -> DataFrame:
    """The most salient, ties by identity: a distributed top-k."""
    return history.withColumn("salience", salience(today)).orderBy(F.desc("salience"), *IDENTITY).limit(max(0, limit))


def recall_for(paths: DataFrame, history: DataFrame, today: Column, limit: int = 8) -> DataFrame:
    """For each ``path``: its own history by salience, then that of its directory (the root is none), up to ``limit`` in all.

    The two tiers are two equi-joins. No file lends more than ``limit`` rows; of what all files of a directory lend, the best
    ``2 * limit`` hold ``limit`` that are not the asking file's own. So each path meets that many rows, however large its directory is;
    both cuts are taken in each task before rows move.
    """
    scored = history.withColumns({"salience": salience(today), "directory": directory(F.col("file_path"))})
    asked = paths.select("path", directory(F.col("path")).alias("asked_directory")).distinct()
    own = asked.join(scored, F.col("path") == F.col("file_path")).withColumn("tier", F.lit(0))
    per_file = Window.partitionBy("file_path").orderBy(F.desc("salience"), *IDENTITY)
    crowd = scored.filter("directory <> ''").withColumn("__of_file", F.row_number().over(per_file)).filter(F.col("__of_file") <= limit).drop("__of_file")
    per_directory = Window.partitionBy("directory").orderBy(F.desc("salience"), *IDENTITY)
    crowd = crowd.withColumn("__of_all", F.row_number().over(per_directory)).filter(F.col("__of_all") <= 2 * limit).drop("__of_all")
    near = asked.join(crowd, (F.col("asked_directory") == F.col("directory")) & (F.col("path") != F.col("file_path"))).withColumn("tier", F.lit(1))
    order = Window.partitionBy("path").orderBy("tier", F.desc("salience"), *IDENTITY)
    return own.unionByName(near).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).drop("asked_directory", "directory")


def recurrence(findings: DataFrame, history: DataFrame, kind: str = "finding") -> DataFrame:
    """Adds how often each finding was seen before; null where it is new. ``history`` is that of before the run."""
    past = history.filter(F.col("kind") == kind).groupBy("file_path", "rule_id").agg(F.sum("occurrences").alias("seen_before"))
    return findings.join(past, ["file_path", "rule_id"], "left")
