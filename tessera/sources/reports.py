"""Markdown renderings of results that are small by construction: one row per check, rule, control, case or section.

Each report is an expression over aggregates of its tables, one row with column ``text``; nothing is collected to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions import severity

MARKER, LISTED, MAX_CHARS = "<!-- review-report -->", 10, 60_000


def _gathered(rows: DataFrame, line: Column, order: list, name: str, limit: int | None = None) -> DataFrame:
    """One row: the lines of a table in order, joined, and their number as ``name``_n; of more than ``limit`` the first, then a count."""
    held = rows.agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("__line")))).alias("h"))
    lines = F.transform("h", lambda x: x["__line"])
    text = F.array_join(lines if limit is None else F.slice(lines, 1, limit), "\n")
    if limit is not None:
        text = F.when(F.size("h") > limit, F.concat(text, F.lit("\n- and "), (F.size("h") - limit).cast("string"), F.lit(" more"))).otherwise(text)
    return held.select(text.alias(name), F.size("h").alias(f"{name}_n"))


def _together(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b), parts)  # each is one row


def _block(title: str, body: str, always: bool = False) -> Column:
    """A titled block, absent (null) where it has no lines."""
    block = F.concat(F.lit(f"## {title}\n\n"), F.col(body))
    return block if always else F.when(F.col(f"{body}_n") > 0, block)


def _share(column: str) -> Column:
    return F.format_string("%.2f [%.2f, %.2f]", f"{column}.point", f"{column}.lower", f"{column}.upper")


def _met(lower: Column, floor: float) -> Column:
    return F.concat(F.lit(f"(floor {floor:.2f} on the lower bound): "), F.when(lower >= floor - 1e-9, "met").otherwise("BELOW THE FLOOR"))


def table_text(rows: DataFrame, title: str, order: list[str]) -> DataFrame:
    """A Markdown table of all rows, for results without a report of their own."""
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]), F.lit(" |"))
    return _gathered(rows, line, order, "body").select(F.concat(F.lit(f"## {title}\n\n{head}\n"), "body").alias("text"))


def evidence(chunks: DataFrame, by: list[str], order: list[str], separator: str = "\n\n---\n\n") -> DataFrame:
    """Chunks under their citation, in order, one text per group."""
    body = F.concat(F.lit("### "), "path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit("\n\n"), "text")
    rows = F.array_sort(F.collect_list(F.struct(*order, body.alias("__body"))))
    return chunks.groupBy(*by).agg(F.array_join(F.transform(rows, lambda x: x["__body"]), separator).alias("text"))


def evaluation_report(total: DataFrame, rules: DataFrame, errors: DataFrame, ungraded: DataFrame, floors: dict[str, float]) -> DataFrame:
    """total: one row of ``evaluation.scored``; rules: the same per rule_id; errors: case_name, reason; ungraded: rule_id, n."""
    table = F.concat(F.lit("| `"), "rule_id", F.lit("` | "), F.concat_ws(" | ", "tp", "fp", "fn", F.format_string("%.2f", "precision"), F.format_string("%.2f", "recall")), F.lit(" |"))
    by_rule = _gathered(rules, table, ["rule_id"], "rules")
    failed = _gathered(errors, F.concat(F.lit("- `"), "case_name", F.lit("`: "), "reason"), ["case_name"], "errors")
    left = _gathered(ungraded, F.concat(F.lit("- `"), "rule_id", F.lit("`: "), F.col("n").cast("string")), ["rule_id"], "left")
    lines = [F.concat(F.lit(f"- {name}: "), _share(c), F.lit(" "), _met(F.col(f"{c}.lower"), floors.get(name, 0.0))) for name, c in (("precision", "p"), ("recall", "r"), ("f1", "f"))]
    counts = F.concat(F.col("tp").cast("string"), F.lit(" matched, "), F.col("fp").cast("string"), F.lit(" unexpected, "), F.col("fn").cast("string"), F.lit(" missed"))
    head = F.concat_ws("\n", F.lit("# Analyzer evaluation\n"), counts, *lines)
    ungraded_block = F.when(F.col("left_n") == 0, "Every finding was graded.").otherwise(F.concat(F.lit("## Not graded\n\n"), "left"))
    rules_block = F.when(F.col("rules_n") > 0, F.concat(F.lit("## By rule\n\n| rule | tp | fp | fn | precision | recall |\n|---|---:|---:|---:|---:|---:|\n"), "rules"))
    return _together(total, by_rule, failed, left).select(F.concat_ws("\n\n", head, rules_block, ungraded_block, _block("Cases that could not be graded", "errors")).alias("text"))


def evaluation_summary(total: DataFrame, errors: DataFrame, floors: dict[str, float]) -> DataFrame:
    """The same scores as one JSON object (``value``)."""
    four = lambda c: F.round(F.col(c), 4)
    met = reduce(lambda a, b: a & b, [F.col(f"{c}.lower") >= floors.get(n, 0.0) - 1e-9 for n, c in (("precision", "p"), ("recall", "r"), ("f1", "f"))])
    rows = total.join(errors.agg(F.count("*").alias("errors")))
    return rows.select(F.to_json(F.struct("tp", "fp", "fn", four("precision").alias("precision"), four("recall").alias("recall"), four("f1").alias("f1"), "errors", (met & (F.col("errors") == 0) & (F.col("tp") + F.col("fp") + F.col("fn") > 0)).alias("met"))).alias("value"))


def narration_report(score: DataFrame, coverage: DataFrame, disagreements: DataFrame, stale: DataFrame, floor: float) -> DataFrame:
    """score: of ``evaluation.narration_score``; coverage: of ``check_coverage``; disagreements: case_name, check; stale: case_name."""
    checks = _gathered(coverage, F.concat(F.lit("| `"), "check", F.lit("` | "), F.concat_ws(" | ", F.when(F.col("rate").isNotNull(), F.format_string("%.2f", "rate")).otherwise("-"), "passing", "firing"), F.lit(" |")), ["check"], "checks")
    wrong = _gathered(disagreements, F.concat(F.lit("- `"), "case_name", F.lit("`: `"), "check", F.lit("`")), ["case_name", "check"], "wrong")
    old = _gathered(stale, F.concat(F.lit("- `"), "case_name", F.lit("`")), ["case_name"], "old")
    head = F.concat(F.lit("# Narration evaluation\n\n"), F.col("cases").cast("string"), F.lit(" case(s). Agreement "), F.format_string("%.2f", "score"), F.lit(", whole cases "), _share("interval"), F.lit(" "), _met(F.col("interval.lower"), floor))
    return _together(score, checks, wrong, old).select(F.concat_ws("\n\n", head, F.concat(F.lit("| check | rate | passing | firing |\n|---|---:|---:|---:|\n"), "checks"), _block("Disagreements", "wrong"), _block("Recorded under another prompt", "old")).alias("text"))


def recall_report(ranks: DataFrame, share: DataFrame, limit: int, floor: float, first_floor: float) -> DataFrame:
    """ranks: query, rank (0: missed, null: broken); share: of ``retrieval.recall_share``."""
    name = F.concat(F.lit("`"), F.col("query").cast("string"), F.lit("`"))
    rows = _gathered(ranks.filter("rank is not null"), F.concat(F.lit("| "), name, F.lit(" | "), F.when(F.col("rank") > 0, F.col("rank").cast("string")).otherwise("-"), F.lit(" |")), ["query"], "rows")
    missed = _gathered(ranks.filter("rank = 0"), F.concat(F.lit("- "), name), ["query"], "missed")
    broken = _gathered(ranks.filter("rank is null"), F.concat(F.lit("- "), name), ["query"], "broken")
    head = F.concat(F.lit("# Retrieval recall\n\n"), F.col("cases").cast("string"), F.lit(f" case(s), the first {limit} places.\n\nRecall "), _share("recall"), F.lit(" "), _met(F.col("recall.lower"), floor), F.lit("\n\nFirst place "), _share("first_place"), F.lit(" "), _met(F.col("first_place.lower"), first_floor))
    return _together(share.drop("broken", "found", "first"), rows, missed, broken).select(F.concat_ws("\n\n", head, F.when(F.col("rows_n") > 0, F.concat(F.lit("| case | rank |\n|---|---:|\n"), "rows")), _block("Missed", "missed"), _block("Not run: the expected document is not in the case", "broken")).alias("text"))


def coverage_report(catalogue: dict[str, str], controls: DataFrame, unmapped: DataFrame) -> DataFrame:
    """controls: control, description, n_findings; unmapped: namespace."""
    seen = _gathered(controls.filter("n_findings > 0"), F.concat(F.lit("| `"), "control", F.lit("` | "), F.col("n_findings").cast("string"), F.lit(" | "), "description", F.lit(" |")), ["control"], "seen")
    silent = _gathered(controls.filter("n_findings = 0"), F.concat(F.lit("- `"), "control", F.lit("`: "), "description"), ["control"], "silent")
    others = _gathered(unmapped, F.concat(F.lit("- `"), "namespace", F.lit("`")), ["namespace"], "others")
    head = "# Control coverage\n\n" + "{name}, version {version}, by {publisher} ({reference}).".format(**catalogue) + "\n\nThese are findings that concern a control; whether it is met is not said here."
    table = F.when(F.col("seen_n") > 0, F.concat(F.lit("## With findings\n\n| control | findings | about |\n|---|---:|---|\n"), "seen"))
    return _together(seen, silent, others).select(F.concat_ws("\n\n", F.lit(head), table, _block("Without findings", "silent"), _block("In no control", "others")).alias("text"))


def comparison_report(compared: DataFrame, prompt_changed: bool, model_changed: bool) -> DataFrame:
    """compared: check, before, after, delta, change, of ``evaluation.compare``."""
    moved = F.concat(F.lit("- `"), "check", F.lit("`: "), F.format_string("%.2f", "before"), F.lit(" to "), F.format_string("%.2f", "after"), F.format_string(" (%+.2f)", "delta"))
    part = lambda word: _gathered(compared.filter(F.col("change") == word), moved if word in ("rose", "fell", "unchanged") else F.concat(F.lit("- `"), "check", F.lit("`")), ["check"], word)
    words = ("rose", "fell", "unchanged", "unmeasured", "gone")
    titles = {"rose": "Rose", "fell": "Fell", "unchanged": "Unchanged", "unmeasured": "Not in the baseline", "gone": "No longer measured"}
    says = [f"The {what} {'changed' if changed else 'is the same'}." for what, changed in (("prompt", prompt_changed), ("model", model_changed))]
    return _together(*map(part, words)).select(F.concat_ws("\n\n", F.lit("# Against the baseline\n\n" + " ".join(says)), *[_block(titles[w], w) for w in words]).alias("text"))


def cut(body: Column, limit: int = MAX_CHARS) -> Column:
    """The head of a text that is longer than ``limit``, and how much is missing, within the limit; shorter ones as they are."""
    note = lambda n: F.concat(F.lit("\n\n---\n\n_The report was cut: "), n.cast("string"), F.lit(" characters are missing. What decides stands above._"))
    at = F.greatest(F.lit(0), limit - F.length(note(F.length(body))))
    return F.when(F.length(body) > limit, F.concat(F.substring(body, F.lit(1), at), note(F.length(body) - at))).otherwise(body)


def review_comment(verdict: DataFrame, blocking: DataFrame, unanalysed: DataFrame, failed: DataFrame, warnings: DataFrame, findings: DataFrame, recurring: DataFrame, documentation: DataFrame, sections: DataFrame, policy: str, trace: str = "", identity: dict[str, str] | None = None, suggestions: int = 0, limit: int = MAX_CHARS) -> DataFrame:
    """The comment on a change, one row: the verdict and what decided it, what was not looked at, what was silenced, then the files.

    verdict: result, files; blocking, warnings: reason; unanalysed, failed: file_path, reason; findings: file_path, line_number,
    rule_id, severity, directive, directive_line, directive_reason; recurring: file_path, line_number, rule_id, seen_before,
    first_seen; documentation: file_path, line_number, rule_id, verified; sections: ordinal, text.
    """
    place = F.concat(F.lit("`"), "file_path", F.lit(":"), F.col("line_number").cast("string"), F.lit("`"))
    about = F.concat(F.lit("- `"), "file_path", F.lit("`: "), "reason")
    silenced = F.concat(F.lit("- `"), "file_path", F.lit("` line "), F.col("directive_line").cast("string"), F.lit(": `"), "directive", F.lit("`, "), F.when(F.coalesce("directive_reason", F.lit("")) != "", F.col("directive_reason")).otherwise("no reason given"))
    again = F.concat(F.lit("- "), place, F.lit(" `"), "rule_id", F.lit("`: "), F.col("seen_before").cast("string"), F.lit(" time(s) before, first on "), F.col("first_seen").cast("string"))
    stale = F.concat(F.lit("- "), place, F.lit(" `"), "rule_id", F.lit("`"))
    stands = findings.filter("directive is null").groupBy("severity").agg(F.count("*").alias("n"))
    by_place = ["file_path", "line_number"]
    parts = _together(
        verdict,
        _gathered(blocking, F.concat(F.lit("- "), "reason"), ["reason"], "blocking"),
        _gathered(unanalysed, about, ["file_path"], "unseen"),
        _gathered(failed, about, ["file_path"], "failed"),
        _gathered(warnings, F.concat(F.lit("- "), "reason"), ["reason"], "warnings"),
        _gathered(findings.filter("directive is not null").dropDuplicates(["file_path", "directive_line", "directive"]), silenced, ["file_path", "directive_line"], "silenced"),
        _gathered(stands, F.concat(F.lit("- "), F.col("n").cast("string"), F.lit(" "), "severity"), [severity.rank(F.col("severity")).alias("__r")], "counts"),
        _gathered(recurring, again, [*by_place, "rule_id"], "again"),
        _gathered(documentation.filter("verified"), stale, [*by_place, "rule_id"], "proved", LISTED),
        _gathered(documentation.filter("not verified"), stale, [*by_place, "rule_id"], "guessed", LISTED),
        _gathered(sections, F.col("text"), ["ordinal"], "sections"),
    )
    who = F.lit("## What produced this\n\n" + "\n".join(f"- {k}: `{v}`" for k, v in identity.items())) if identity else F.lit(None).cast("string")
    foot = F.concat(F.lit(f"Policy {policy}, "), F.col("files").cast("string"), F.lit(" file(s) considered" + (f", trace `{trace}`" if trace else "")))
    body = F.concat_ws(
        "\n\n", F.lit(MARKER), F.when(F.col("result") == "fail", "# Review: blocked").otherwise("# Review: passed"), _block("Blocked by", "blocking"), _block("Not analysed (no finding here means that nothing was examined)", "unseen"),
        _block("Not reviewed", "failed"), _block("Warnings", "warnings"), _block("Suppressed", "silenced"), _block("Static analysis", "counts"), _block("Seen in this project before", "again"),
        F.lit(f"{suggestions} suggestion(s) stand on the changed lines; none is applied.") if suggestions else F.lit(None).cast("string"),
        _block("Documentation that the change proves wrong", "proved"), _block("Documentation that may be stale (not verified, decides nothing)", "guessed"), who, foot, F.when(F.col("sections_n") > 0, F.concat(F.lit("---\n\n"), "sections")),
    )
    return parts.select(cut(body, limit).alias("text"))


def chain_line(verified: DataFrame) -> DataFrame:
    """One line per chain, with positions and never content."""
    count = F.format_string("%d record(s)", "n")
    end = F.concat(F.lit(", "), F.col("signed").cast("string"), F.lit(" signed, up to sequence "), F.col("n").cast("string"))
    text = (
        F.when(F.col("status") == "intact", F.concat(F.lit("intact: "), count, end))
        .when(F.col("status") == "unverifiable", F.concat(F.lit("unverifiable: "), count, end, F.when(F.size("unheld") > 0, F.concat(F.lit("; no key for "), F.array_join("unheld", ", "))).otherwise("")))
        .otherwise(F.concat(F.lit("TAMPERED at record "), F.col("broken_at").cast("string"), F.lit(": "), "reason"))
    )
    return verified.withColumn("line", text)
