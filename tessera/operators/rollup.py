"""Roll-ups: dense counts, scores, gates, verdict lattices, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions import severity

# The order of verdicts.
VERDICTS = ("pass", "warn", "fail")
SCORE_WARN, SCORE_FAIL = 60, 50


def verdict_rank(column: Column) -> Column:
    return F.when(column == "fail", 2).when(column == "warn", 1).otherwise(0)


def verdict_of(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in VERDICTS]), rank.cast("int") + 1)


def dense_counts(df: DataFrame, column: str, values: list[str], *by: str) -> DataFrame:
    """Counts with a row for every value, 0 where there is none. One pass: a conditional sum per value, then unpivoted."""
    wide = df.groupBy(*by).agg(*[F.count_if(F.col(column) == v).alias(f"v{i}") for i, v in enumerate(values)])
    pairs = F.array(*[F.struct(F.lit(v).alias(column), F.col(f"v{i}").alias("n")) for i, v in enumerate(values)])
    return wide.select(*by, F.inline(pairs))


def score(severities: Column) -> Column:
    """Aggregate: 100 less the weights, at least 0."""
    return F.greatest(F.lit(0), 100 - F.coalesce(F.sum(severity.weight(severities)), F.lit(0)))


def worst_severity(severities: Column) -> Column:
    """Aggregate: info when empty."""
    return severity.by_rank(F.coalesce(F.min(severity.rank(severities)), F.lit(4)))


def penalty_score(severities: Column, charges: dict[str, int], default: int = 0) -> Column:
    """Aggregate: 100 less a charge per finding, at least 0."""
    charge = F.lit(default)
    for name, cost in charges.items():
        charge = F.when(severities == name, cost).otherwise(charge)
    return F.greatest(F.lit(0), 100 - F.coalesce(F.sum(F.when(severities.isNotNull(), charge)), F.lit(0)))


# What a finding costs in the analyzers' own scores.
QUALITY_CHARGES, PERFORMANCE_CHARGES, PERFORMANCE_DEFAULT = {"high": 10, "medium": 5, "low": 2}, {"critical": 20, "high": 10, "medium": 5, "low": 2}, 5


def risk(severities: Column) -> tuple[Column, Column]:
    """Aggregates: the risk score (weights, at most 100) and its level."""
    total = F.least(F.lit(100), F.coalesce(F.sum(severity.weight(severities)), F.lit(0)))
    crit, high = F.count_if(severities == "critical"), F.count_if(severities == "high")
    level = F.when((total >= 100) | (crit > 0), "critical").when((total >= 50) | (high >= 3), "high").when((total >= 20) | (high >= 1), "medium").when(total > 0, "low").otherwise("safe")
    return total, level


def gate(files: DataFrame, findings: DataFrame, blocking: str = "critical", warn_below: int = SCORE_WARN, fail_below: int = SCORE_FAIL) -> DataFrame:
    """Per file: n_findings (null where it was not analysed), quality (of the prose there, if it has one) and result.

    files: file_path, analysed, prose_blocks, prose_warns, and prose_quality if there is any. Findings at least as severe as ``blocking``
    fail; high and medium ones warn; a score under ``warn_below`` warns, one that is also under ``fail_below`` fails. A file that
    was analysed and is clean differs from one that was not.
    """
    bar = dict((s[0], s[1]) for s in severity.SEVERITIES)[blocking]
    sev = F.col("severity")
    counts = [F.count("*").alias("n"), score(sev).alias("quality"), F.count_if(severity.rank(sev) <= bar).alias("blocks"), F.count_if(sev.isin("high", "medium") & (severity.rank(sev) > bar)).alias("warns")]
    told = F.col("prose_quality") if "prose_quality" in files.columns else F.lit(None).cast("int")
    rows = files.join(findings.groupBy("file_path").agg(*counts), "file_path", "left").withColumns(
        {
            "n_findings": F.when(F.col("analysed"), F.coalesce("n", F.lit(0))),
            "quality": F.when(F.col("analysed"), F.coalesce("quality", F.lit(100))).otherwise(told.cast("long")),
        }
    )
    yes = lambda c: F.coalesce(c, F.lit(False))
    low = yes(F.col("quality") < warn_below)
    fails = yes(F.col("prose_blocks")) | (F.col("analysed") & (F.coalesce("blocks", F.lit(0)) > 0)) | (low & (F.col("quality") < fail_below))
    warns = yes(F.col("prose_warns")) | (F.col("analysed") & (F.coalesce("warns", F.lit(0)) > 0)) | low
    return rows.select("file_path", "n_findings", "quality", F.when(fails, "fail").when(warns, "warn").otherwise("pass").alias("result"))


# What a review says in its own words.
SCAN_FAILED, RISK_TOLD, QUALITY_TOLD, BREAKS = r"(?i)SAST\s+Scan\s+Result\**\s*:\s*\**\s*\[?\s*FAIL", r"Risk Assessment\*\*:\s*\[?(\w+)\]?", r"SOLID Compliance\*\*:\s*\[?(\d+)/100\]?", "Breaking Changes**: Yes"


def gate_reviews(
    reviews: DataFrame, findings: DataFrame, blocking: str = "critical", warn_below: int = SCORE_WARN, fail_below: int = SCORE_FAIL, critical_blocks: bool = True, tell_breaking: bool = True
) -> DataFrame:
    """The gate of reviewed files (file_path, review, analysed).

    Where an analysis ran, the review's prose can only warn. Where none ran, a failed scan or (``critical_blocks``) a critical risk that it
    tells blocks, its own score is judged, and a missing score warns. ``tell_breaking``: breaking changes that it tells warn.
    """
    text, analysed = F.coalesce("review", F.lit("")), F.col("analysed")
    failed = text.rlike(SCAN_FAILED)
    critical = (F.lower(F.regexp_extract(text, RISK_TOLD, 1)) == "critical") & F.lit(critical_blocks)
    quality = F.regexp_extract(text, QUALITY_TOLD, 1).try_cast("int")
    breaks = F.contains(text, F.lit(BREAKS)) & F.lit(tell_breaking)
    columns = {"prose_blocks": ~analysed & (failed | critical), "prose_warns": failed | critical | breaks | (~analysed & quality.isNull()), "prose_quality": quality}
    return gate(reviews.withColumns(columns), findings, blocking, warn_below, fail_below)


def outcome(gates: DataFrame, failed: DataFrame, unanalysed: DataFrame) -> DataFrame:
    """One row: the worst verdict. A file that failed to be reviewed is at least a warning, an unanalysed one a failure; nothing passes."""
    ranks = gates.select(verdict_rank(F.col("result")).alias("v")).unionByName(failed.select(F.lit(1).alias("v"))).unionByName(unanalysed.select(F.lit(2).alias("v")))
    return ranks.agg(verdict_of(F.coalesce(F.max("v"), F.lit(0))).alias("result"))


def exit_code(result: Column, n_unanalysed: Column, n_failed: Column, n_blocking: Column, on_critical: bool = True, on_analysis_error: bool = True, on_review_error: bool = False) -> Column:
    """0 or 1, by what the policy lets fail."""
    return F.when(
        (F.lit(on_analysis_error) & (n_unanalysed > 0)) | (F.lit(on_critical) & (result == "fail") & (n_blocking > 0)) | (F.lit(on_review_error) & (n_failed > 0)), 1
    ).otherwise(0)


def map_totals(df: DataFrame, column: str, *by: str) -> DataFrame:
    """The key-wise sum of a map column, as a map. Keys are summed before maps are built."""
    summed = df.select(*by, F.explode(column).alias("key", "n")).groupBy(*by, "key").agg(F.sum("n").alias("n"))
    return summed.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "n")))).alias(column))


def metrics(files: DataFrame, *by: str) -> DataFrame:
    """Sums, the slowest file, the worst gate and the least non-null quality score per group."""
    return files.groupBy(*by).agg(
        F.count("*").alias("files_analyzed"),
        F.sum("lines_analyzed").alias("lines_analyzed"),
        F.sum("duration_ms").alias("duration_ms"),
        F.max("duration_ms").alias("slowest_file_ms"),
        F.sum("recurring_findings").alias("recurring_findings"),
        verdict_of(F.max(verdict_rank(F.col("gate_result")))).alias("gate_result"),
        F.min("quality_score").alias("quality_score"),
    )


def agent_totals(reports: DataFrame) -> DataFrame:
    return reports.groupBy("agent").agg(F.count("*").alias("runs"), F.count_if("failed").alias("failures"), F.sum("tool_calls").alias("tool_calls"), F.sum("tokens").alias("tokens"), F.sum("duration_ms").alias("duration_ms"))


def prometheus(totals: DataFrame, helps: dict[str, tuple[str, str]]) -> DataFrame:
    """OpenMetrics lines (position, line). totals: name, labels map<string,string>, value. HELP and TYPE come once per series."""
    label = F.concat_ws(",", F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))))
    lines = totals.select("name", F.lit(2).alias("kind"), F.concat("name", F.lit("{"), label, F.lit("} "), F.col("value").cast("string")).alias("line"))
    heads = totals.select("name").distinct()
    spec = F.create_map(*[F.lit(x) for n, (h, t) in helps.items() for x in (n, f"{h}\n{t}")])
    text = F.split(F.element_at(spec, F.col("name")), "\n")
    helped = heads.select("name", F.lit(0).alias("kind"), F.concat(F.lit("# HELP "), "name", F.lit(" "), text[0]).alias("line"))
    typed = heads.select("name", F.lit(1).alias("kind"), F.concat(F.lit("# TYPE "), "name", F.lit(" "), text[1]).alias("line"))
    return lines.unionByName(helped).unionByName(typed).orderBy("name", "kind", "line").select("line")


def readiness(checks: DataFrame) -> DataFrame:
    """One row: ready, and the failures in order."""
    return checks.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("ready"), F.sort_array(F.collect_list(F.when(~F.col("passed"), F.col("check")))).alias("failures"))
