"""Apportionment, specialist routing, hand-offs, job states and tiered memory."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

# Composition order with weights, routing of categories, allowed transitions, memory buckets with their caps.
SPECIALISTS = (("architecture", 3), ("security", 4), ("performance", 2), ("dependency", 2))
CATEGORY_ROUTING = {"security": "security", "performance": "performance", "dependency": "dependency"}
TRANSITIONS = (("queued", "running"), ("running", "succeeded"), ("running", "failed"), ("queued", "failed"))
BUCKETS = (("critical", None), ("high", 20), ("normal", 15), ("low", 0))
TAGS = {
    "SECURITY": "critical", "BREAKING": "critical", "CRITICAL": "critical", "RISK": "high", "DEPENDENCY": "high", "AFFECTED_CODE": "high",
    "PERFORMANCE": "normal", "PATTERN": "normal", "QUALITY": "normal", "TODO": "low", "GENERAL": "low",
}
# Affected places that a context shows, free tokens that it needs to show normal insights; per bucket that is
# summarised, in order: insights it must exceed, insights that stay, and the share of the budget that must be exceeded.
AFFECTED, ROOM = 10, 5000
SUMMARIES = (("low", 3, 2, 0.0), ("normal", 5, 3, 0.8), ("high", 10, 5, 0.95))


def split_budget(parts: DataFrame, group: str, order: str, weight: str, total: str) -> DataFrame:
    """Adds share: one each, the rest by weight, what is left over by the largest remainder (ties: weight, then order).

    Shares sum to the group's total; a total under the head-count is refused when it is run.
    """
    g = Window.partitionBy(group)
    rest = F.col(total) - F.count("*").over(g)
    checked = parts.withColumn("__quota", F.when(F.assert_true(rest >= 0, "a budget must reach all").isNull(), rest * F.col(weight) / F.sum(weight).over(g)))
    based = checked.withColumn("__base", 1 + F.floor("__quota"))
    rank = Window.partitionBy(group).orderBy(F.round(F.floor("__quota") - F.col("__quota"), 9), F.desc(weight), order)
    ranked = based.withColumns({"__n": F.row_number().over(rank), "__left": F.col(total) - F.sum("__base").over(g)})
    return ranked.withColumn("share", F.col("__base") + F.when(F.col("__n") <= F.col("__left"), 1).otherwise(0)).drop("__quota", "__base", "__n", "__left")


def plan_assignments(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Per file the specialists that its findings' categories ask for, in fixed order; the generalist always, dependency for manifests."""
    routed = F.create_map(*[F.lit(x) for pair in CATEGORY_ROUTING.items() for x in pair])
    asked = findings.groupBy("file_path").agg(F.collect_set(F.element_at(routed, F.col("category"))).alias("asked"))
    joined = files.join(asked, "file_path", "left")
    wanted = F.concat(F.coalesce("asked", F.array().cast("array<string>")), F.array(F.lit("architecture")), F.when(F.col("is_manifest"), F.array(F.lit("dependency"))).otherwise(F.array().cast("array<string>")))
    order = F.array(*[F.lit(s[0]) for s in SPECIALISTS])
    return joined.select("file_path", F.filter(order, lambda s: F.array_contains(wanted, s)).alias("specialists"))


def accept_handoffs(requests: DataFrame, already: DataFrame, depth: int) -> DataFrame:
    """requests: file_path, to. Adds refused (null: accepted): too deep, unknown, or already run."""
    known = [s[0] for s in SPECIALISTS]
    ran = already.select("file_path", "to", F.lit(True).alias("__ran")).distinct()
    joined = requests.join(ran, ["file_path", "to"], "left")
    reason = F.when(F.lit(depth > 0), "depth").when(~F.col("to").isin(*known), "unknown").when(F.col("__ran"), "already_run")
    return joined.withColumn("refused", reason).drop("__ran")


def compose(reports: DataFrame) -> DataFrame:
    """Per file one text: the specialists' sections in fixed order, each under its name. reports: file_path, agent, body."""
    place = F.array_position(F.array(*[F.lit(s[0]) for s in SPECIALISTS]), F.col("agent"))
    parts = reports.filter(F.length(F.trim("body")) > 0).groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct(place.alias("at"), "agent", "body"))).alias("parts"))
    return parts.select("file_path", F.array_join(F.transform("parts", lambda p: F.concat(F.lit("## "), F.initcap(p["agent"]), F.lit("\n\n"), p["body"])), "\n\n").alias("text"))


def submit(jobs: DataFrame, new: DataFrame, max_queued: int) -> DataFrame:
    """new: key, submitted. Those that are not in flight, each key once, as long as the queue has room, oldest first."""
    flying = jobs.filter(F.col("state").isin("queued", "running")).select("key").distinct()
    once = new.groupBy("key").agg(F.min("submitted").alias("submitted"))
    queued = jobs.filter("state = 'queued'").count()
    return once.join(flying, "key", "left_anti").orderBy("submitted", "key").limit(max(0, max_queued - queued))


def claim_next(jobs: DataFrame) -> DataFrame:
    """The oldest queued job."""
    return jobs.filter("state = 'queued'").orderBy("submitted", "key").limit(1)


def illegal_transitions(moves: DataFrame) -> DataFrame:
    """Moves (before, after) that no rule allows."""
    allowed = moves.sparkSession.createDataFrame(list(TRANSITIONS), "before string, after string")
    return moves.join(F.broadcast(allowed), ["before", "after"], "left_anti")


def forget_old(jobs: DataFrame, keep: int, state: str, finished: tuple[str, ...], order: list[Column]) -> DataFrame:
    """All jobs, less the oldest finished ones by which their number exceeds ``keep``; unfinished ones always stay."""
    done = F.col(state).isin(*finished)
    excess = max(0, jobs.count() - keep)
    dropped = jobs.filter(done).orderBy(*order).limit(excess).select("key")
    return jobs.join(dropped, "key", "left_anti")


def bucket_of(insight: Column) -> Column:
    """The bucket of a leading tag: low without one, normal for an unknown one."""
    tag = F.upper(F.regexp_extract(insight, r"^\[(\w+)\]", 1))
    known = F.create_map(*[F.lit(x) for pair in TAGS.items() for x in pair])
    return F.when(tag == "", "low").otherwise(F.coalesce(F.try_element_at(known, tag), F.lit("normal")))


def remember(insights: DataFrame, *by: str) -> DataFrame:
    """Each (bucket, content) once, when it was first told. insights: content, at, and the columns that tell memories apart."""
    return insights.withColumn("bucket", bucket_of(F.col("content"))).groupBy(*by, "bucket", "content").agg(F.min("at").alias("at"))


def tokens_of(content: Column) -> Column:
    return F.floor(F.length(content) / 4)


def load_context(memory: DataFrame, affected: DataFrame | None = None, summary: str = "", budget: int = 100_000) -> DataFrame:
    """One text: all critical insights, then the first of each bucket within its cap, oldest first; affected places (path, symbol,
    reason, at) stand behind the high ones. Normal insights are shown while more than ROOM tokens are free; low ones never are."""

    def section(rows: DataFrame, rank: int, head: str, order: list[str], line: Column, cap: int | None) -> DataFrame:
        """(r, text) of the first ``cap`` rows, a top-k of each task's; no row where there are none."""
        first = rows if cap is None else rows.orderBy(*order).limit(cap)
        listed = first.agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))).alias("x")).filter(F.size("x") > 0)
        return listed.select(F.lit(rank).alias("r"), F.concat(F.lit(f"## {head}\n"), F.array_join(F.transform("x", lambda x: x["line"]), "\n")).alias("text"))

    sections = [section(memory.filter(F.col("bucket") == name), rank, name.upper(), ["at", "content"], F.concat(F.lit("- "), "content"), cap) for (name, cap, *_), rank in zip(BUCKETS, (0, 1, 3, 4), strict=True) if cap != 0]
    if affected is not None:
        told = F.concat(F.lit("- `"), "path", F.lit(":"), "symbol", F.lit("` - "), "reason")
        sections.append(section(affected, 2, "AFFECTED CODE", ["at", "path", "symbol"], told, AFFECTED))
    parts = functools.reduce(DataFrame.unionByName, sections)
    total = parts.agg(F.array_sort(F.collect_list(F.struct("r", "text"))).alias("parts"))
    used = F.aggregate(F.filter("parts", lambda p: p["r"] < 3), F.lit(0).cast("long"), lambda s, p: s + tokens_of(p["text"]))
    kept = F.filter("parts", lambda p: (p["r"] < 3) | (budget - used > ROOM))
    tail = F.array(*[F.lit(f"## SUMMARY\n{summary}")] if summary else []).cast("array<string>")
    return total.select(F.array_join(F.concat(F.transform(kept, lambda p: p["text"]), tail), "\n\n").alias("context"))


def memory_stats(memory: DataFrame, budget: int) -> DataFrame:
    counts = [F.count_if(F.col("bucket") == b[0]).alias(b[0]) for b in BUCKETS]
    return memory.agg(*counts, F.round(100 * F.coalesce(F.sum(tokens_of(F.col("content"))), F.lit(0)) / budget, 2).alias("used_percent"))


def summary_of(contents: list[str]) -> str:
    """The contents' lines; of more than ten the first and the last three."""
    lines = "\n".join(contents).split("\n")
    return "\n".join(lines if len(lines) <= 10 else [*lines[:3], "...[summarized]...", *lines[-3:]])


def summarise(memory: DataFrame, group: str, budget: int) -> DataFrame:
    """The memory (group, bucket, content, at) after it was pressed into its budget: from 80 % of it on, the older insights of the
    low, then the normal, then the high bucket become one row of bucket ``summary``; critical ones stay.

    Whether a bucket is pressed depends on what the ones before have freed, so a group, whose size its budget bounds, is a fold.
    """
    names = memory.columns

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "content"], kind="stable")
        cost = lambda: int((pdf["content"].str.len() // 4).sum())
        if cost() < int(budget * 0.8):
            return pdf[names]
        for bucket, least, stay, share in SUMMARIES:
            old = pdf[pdf["bucket"] == bucket]
            if len(old) <= least or cost() <= int(budget * share):
                continue
            told = old.iloc[:1].assign(bucket="summary", content=f"{bucket}: " + summary_of(old["content"].tolist()))
            pdf = pd.concat([pdf.drop(index=old.index[:-stay]), told], ignore_index=True)
        return pdf[names]

    return memory.groupBy(group).applyInPandas(fold, memory.schema)
