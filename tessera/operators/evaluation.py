"""Scoring annotated corpora: grading, confusion matrices, shortfalls, baselines, alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions import stats
from tessera.operators import code, documentation, scan


def confusion(rows: DataFrame, actual: Column, predicted: Column, *by: str) -> DataFrame:
    """tp, fp, fn per group, and with no group overall."""
    count = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    return rows.groupBy(*by).agg(count(actual & predicted).alias("tp"), count(~actual & predicted).alias("fp"), count(actual & ~predicted).alias("fn"))


def total(matrices: DataFrame) -> DataFrame:
    return matrices.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])


def scored(matrices: DataFrame) -> DataFrame:
    """Adds precision, recall (1 when empty), f1 and their Wilson intervals."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = matrices.withColumns({"precision": stats.precision(tp, fp), "recall": stats.recall(tp, fn), "p": stats.wilson(tp, tp + fp), "r": stats.wilson(tp, tp + fn)})
    return out.withColumns({"f1": stats.harmonic(F.col("precision"), F.col("recall")), "f": stats.f1_interval(F.col("p"), F.col("r"))})


_FOUND = "struct<rule_id:string,line_number:int,severity:string>"
_VERDICT = "struct<verdict:string,rule_id:string,line_number:int,expected_severity:string,found_severity:string,found_line:int>"


def _claimed(left: Column, want: Column, tolerance: Column) -> Column:
    """The place in ``left`` of the finding that an expectation claims, from 0: of its rule and near enough, by its severity, then
    the nearest, then the first line; null without any."""
    none = F.lit(None).cast("int")
    distance = lambda f: F.abs(f["line_number"] - want["line_number"])
    other = lambda f: want["severity"].isNotNull() & ~f["severity"].eqNullSafe(want["severity"])
    near = lambda f: (f["rule_id"] == want["rule_id"]) & (distance(f) <= tolerance)
    ranked = F.transform(left, lambda f, i: F.when(near(f), F.struct(other(f).alias("other"), distance(f).alias("distance"), f["line_number"].alias("line"), i.alias("at"))))
    return F.coalesce(F.array_min(F.filter(ranked, lambda r: r.isNotNull()))["at"], none)


def grade(expected: DataFrame, findings: DataFrame, forbidden: DataFrame, cases: DataFrame) -> DataFrame:
    """One row per expectation (matched, mismatched, missed) and per unclaimed finding (forbidden, spurious, ungraded).

    expected: case_name, ordinal, rule_id, line_number, severity (null: any). findings: case_name, rule_id, line_number,
    severity. forbidden: case_name, rule_id, line_number (0: anywhere). cases: case_name, scope array<string>, line_tolerance.
    Within a case expectations claim in order the best finding left: severity match, then distance, then line. That is sequential, so
    a case, which is small, is one row of sorted arrays, and the claim a fold over them.
    """

    def per_case(rows: DataFrame, out: str, *columns) -> DataFrame:
        return rows.groupBy("case_name").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(out))

    line, sev = F.col("line_number").cast("int").alias("line_number"), F.col("severity").cast("string").alias("severity")
    joined = cases.select("case_name", "scope", F.col("line_tolerance").cast("int").alias("tolerance"))
    joined = joined.join(per_case(expected, "wants", F.col("ordinal").cast("int").alias("ordinal"), "rule_id", line, sev), "case_name", "left")
    joined = joined.join(per_case(findings, "found", "rule_id", line, sev), "case_name", "left").join(per_case(forbidden, "barred", "rule_id", line), "case_name", "left")
    empty = lambda kind: F.array().cast(f"array<{kind}>")

    def said(verdict, rule, at, wanted, got, got_line) -> Column:
        text = lambda c: F.lit(c) if c is None or isinstance(c, str) else c
        return F.struct(
            text(verdict).cast("string").alias("verdict"), rule.alias("rule_id"), at.alias("line_number"), text(wanted).cast("string").alias("expected_severity"), text(got).cast("string").alias("found_severity"), text(got_line).cast("int").alias("found_line")
        )

    def claim(state: Column, want: Column) -> Column:
        at = _claimed(state["left"], want, F.col("tolerance"))
        best = F.get(state["left"], at)
        fits = want["severity"].isNull() | want["severity"].eqNullSafe(best["severity"])
        told = F.when(at.isNull(), said("missed", want["rule_id"], want["line_number"], want["severity"], None, None)).otherwise(
            said(F.when(fits, "matched").otherwise("mismatched"), want["rule_id"], want["line_number"], want["severity"], best["severity"], best["line_number"])
        )
        left = F.when(at.isNull(), state["left"]).otherwise(F.filter(state["left"], lambda f, i: i != at))
        return F.struct(left.alias("left"), F.concat(state["told"], F.array(told)).alias("told"))

    start = F.struct(F.coalesce("found", empty(_FOUND)).alias("left"), empty(_VERDICT).alias("told"))
    done = joined.withColumn("done", F.aggregate(F.coalesce("wants", F.array().cast(joined.schema["wants"].dataType)), start, claim))
    asked = F.transform(F.coalesce("wants", F.array().cast(joined.schema["wants"].dataType)), lambda w: w["rule_id"])
    banned = lambda f: F.coalesce(F.exists("barred", lambda b: (b["rule_id"] == f["rule_id"]) & b["line_number"].isin(0, f["line_number"])), F.lit(False))
    scoped = lambda f: F.exists("scope", lambda s: (s == "*") | (s == f["rule_id"]) | (s.endswith(".*") & f["rule_id"].startswith(F.regexp_replace(s, r"\*$", ""))))
    inside = lambda f: (F.size(F.coalesce("scope", F.array().cast("array<string>"))) == 0) | F.array_contains(asked, f["rule_id"]) | F.coalesce(scoped(f), F.lit(False))
    rest = F.transform(F.col("done.left"), lambda f: said(F.when(banned(f), "forbidden").when(inside(f), "spurious").otherwise("ungraded"), f["rule_id"], f["line_number"], None, f["severity"], f["line_number"]))
    return done.select("case_name", F.inline(F.concat("done.told", rest)))


def grade_exact(expected: DataFrame, findings: DataFrame) -> DataFrame:
    """Grading at tolerance 0 in SQL terms: the n-th expectation of a (case, rule, line) claims its n-th finding. Counts per rule."""
    keys = ["case_name", "rule_id", "line_number"]
    want, got = expected.groupBy(*keys).agg(F.count("*").alias("wanted")), findings.groupBy(*keys).agg(F.count("*").alias("found"))
    both = want.join(got, keys, "full").fillna(0, ["wanted", "found"])
    tp = F.least("wanted", "found")
    return both.groupBy("rule_id").agg(F.sum(tp).alias("tp"), F.sum(F.col("found") - tp).alias("fp"), F.sum(F.col("wanted") - tp).alias("fn"))


def by_rule(graded: DataFrame) -> DataFrame:
    """The confusion matrix per rule. A mismatched severity is both a miss and a false positive."""
    v = F.col("verdict")
    return graded.groupBy("rule_id").agg(
        F.count_if(v == "matched").alias("tp"), F.count_if(v.isin("mismatched", "spurious", "forbidden")).alias("fp"), F.count_if(v.isin("missed", "mismatched")).alias("fn")
    )


def shortfalls(scores: DataFrame, floors: DataFrame) -> DataFrame:
    """Measures whose lower bound is under their floor. scores: measure, lower, total; an empty run fails."""
    return floors.join(scores, "measure", "left").filter((F.coalesce(F.col("total"), F.lit(0)) == 0) | (F.col("lower") < F.col("floor") - 1e-9))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per check: delta and rose / fell / unchanged / unmeasured / gone. Both have check, rate."""
    joined = before.select("check", F.col("rate").alias("before")).join(after.select("check", F.col("rate").alias("after")), "check", "full")
    delta = F.col("after") - F.col("before")
    word = F.when(F.col("before").isNull(), "unmeasured").when(F.col("after").isNull(), "gone").when(delta > 1e-9, "rose").when(delta < -1e-9, "fell").otherwise("unchanged")
    return joined.withColumns({"delta": delta, "change": word})


def comparable(before: DataFrame, after: DataFrame, key: str = "case_name") -> None:
    """Raises where two runs cover different cases: their difference would be no movement."""
    other = same_cases(before, after, key).limit(20).collect()
    if other:
        raise ValueError(f"the runs cover different cases: {sorted((r['side'], r[key]) for r in other)}")


def same_cases(before: DataFrame, after: DataFrame, key: str = "case_name") -> DataFrame:
    """Cases that only one run has; runs are comparable where this is empty."""
    one, two = before.select(key).distinct(), after.select(key).distinct()
    return one.join(two, key, "left_anti").withColumn("side", F.lit("before")).unionByName(two.join(one, key, "left_anti").withColumn("side", F.lit("after")))


def alignment(demanded: DataFrame, checked: DataFrame, declined: DataFrame) -> DataFrame:
    """(heading, state) of each heading that a prompt demands or the code names: declined or graded (demanded), ungoverned (demanded,
    neither checked nor declined), ungrounded (named, not demanded). All have column heading. One that is both checked and
    declined contradicts itself and is refused when it is run."""
    asked, tested, waived = (d.select("heading").distinct().withColumn(n, F.lit(True)) for d, n in ((demanded, "asked"), (checked, "tested"), (declined, "waived")))
    joined = asked.join(tested, "heading", "full").join(waived, "heading", "full")
    clear = F.assert_true(~(F.coalesce("tested", F.lit(False)) & F.coalesce("waived", F.lit(False))), "a heading is both graded and declined").isNull()
    state = F.when(F.col("asked") & F.col("waived"), "declined").when(F.col("asked") & F.col("tested"), "graded").when(F.col("asked"), "ungoverned").otherwise("ungrounded")
    return joined.filter(clear).select("heading", state.alias("state"))


def backed_checks(expectations: DataFrame, prompts: DataFrame) -> DataFrame:
    """(prompt, check, missing, state): which checks a prompt has an instruction for. expectations: check, phrases, any_of. prompts: prompt, text."""
    pairs = prompts.join(F.broadcast(expectations))  # a check per rule of the output, which the code names
    missing = scan.absent(F.col("phrases"), F.col("text"), F.col("any_of"))
    return pairs.select("prompt", "check", missing.alias("missing")).withColumn("state", F.when(F.size("missing") == 0, "aligned").otherwise("unbacked"))


def recipe_coverage(rules: DataFrame, recipes: DataFrame, declined: DataFrame) -> DataFrame:
    """Each rule: recipe, declined or unaccounted."""
    joined = rules.join(recipes.select("rule_id", F.lit(1).alias("r")).distinct(), "rule_id", "left").join(declined.select("rule_id", F.lit(1).alias("d")).distinct(), "rule_id", "left")
    return joined.select("rule_id", F.when(F.col("r") == 1, "recipe").when(F.col("d") == 1, "declined").otherwise("unaccounted").alias("state"))


def check_agreement(results: DataFrame) -> DataFrame:
    """Adds agrees: a check passes exactly where it is not expected to fail. results: case_name, check, passed, expect_failure."""
    return results.withColumn("agrees", F.col("passed") != F.col("expect_failure"))


def narration_score(agreed: DataFrame) -> DataFrame:
    """One row: the share of agreeing checks (0 for no checks), the cases, and the Wilson interval over cases that agree throughout."""
    per_case = agreed.groupBy("case_name").agg(F.bool_and("agrees").alias("whole"), F.count("*").alias("n"), F.count_if("agrees").alias("right"))
    total = per_case.agg(F.coalesce(F.sum("right") / F.sum("n"), F.lit(0.0)).alias("score"), F.count("*").alias("cases"), F.count_if("whole").alias("whole"))
    return total.withColumn("interval", stats.wilson(F.col("whole"), F.col("cases"))).withColumn("measured_nothing", F.col("cases") == 0)


def check_coverage(agreed: DataFrame, checks: list[str]) -> DataFrame:
    """Per check, with zeros: cases that pass, cases that fire, and the share that agrees."""
    known = agreed.sparkSession.createDataFrame([(c,) for c in checks], "check string")
    counts = agreed.groupBy("check").agg(F.count_if("passed").alias("passing"), F.count_if(~F.col("passed")).alias("firing"), F.avg(F.col("agrees").cast("int")).alias("rate"))
    return known.join(counts, "check", "left").fillna(0, ["passing", "firing"])


def baseline(agreed: DataFrame, model: str, fingerprint: str, at: str) -> DataFrame:
    """One row: rates per check as a map, the cases, and who made them when."""
    rates = agreed.groupBy("check").agg(F.avg(F.col("agrees").cast("int")).alias("rate"))
    named = rates.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("check", "rate")))).alias("rates"))
    cases = agreed.agg(F.sort_array(F.collect_set("case_name")).alias("cases"))
    return named.join(cases).select("rates", "cases", F.lit(model).alias("model"), F.lit(fingerprint).alias("fingerprint"), F.lit(at).alias("at"))


def stale(cases: DataFrame, fingerprint: str) -> DataFrame:
    """Adds stale: whether a case was recorded under another prompt, or nobody knows which."""
    return cases.withColumn("stale", F.coalesce(F.col("prompt_fingerprint") != fingerprint, F.lit(True)))


def evaluate_narration(cases: DataFrame, fingerprint: str) -> DataFrame:
    """(case_name, check, passed, expect_failure, stale): the five checks on each case. cases: case_name, review, file_path, line_count,
    findings, prompt_fingerprint, expect_failures (check names)."""
    judged = stale(scan.narration_checks(cases), fingerprint)
    pairs = F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("passed")) for c in scan.CHECKS])
    rows = judged.select("case_name", "expect_failures", "stale", F.inline(pairs))
    return rows.select("case_name", "check", "passed", F.coalesce(F.array_contains("expect_failures", F.col("check")), F.lit(False)).alias("expect_failure"), "stale")


def evaluate(cases: DataFrame, expected: DataFrame, forbidden: DataFrame, limits: dict[str, int] = code.LIMITS) -> tuple[DataFrame, DataFrame]:
    """(graded, errors): the analyzers over the file of each case, suppressed findings left out, graded against its annotations.

    cases: case_name, file_path, content, diff, scope, line_tolerance. A case without content can't be graded; neither can one
    that an analyzer crashed on. Both are errors (case_name, reason), not misses.
    """
    files = cases.filter(F.col("content").isNotNull()).select(F.concat("case_name", F.lit("/"), "file_path").alias("file_path"), "content", "diff")
    found, crashed = code.analyse_files(files, limits)
    case = F.substring_index("file_path", "/", 1).alias("case_name")
    errors = crashed.select(case, "reason").unionByName(cases.filter(F.col("content").isNull()).select("case_name", F.lit("no such file").alias("reason")))
    good = lambda df: df.join(F.broadcast(errors.select("case_name").distinct()), "case_name", "left_anti")
    rows = found.filter("directive is null").select(case, "rule_id", "line_number", "severity")
    return grade(good(expected), good(rows), good(forbidden), good(cases)), errors


def evaluate_documentation(cases: DataFrame, claims: DataFrame, index: DataFrame, changes: DataFrame, expected: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Grades what ``documentation.defects`` reports per case. claims: case_name and those of ``documentation.claims``; index: case_name,
    kind, name, params; changes: case_name, path, diff. Names get their case in front, so that one join serves all cases."""
    mark = lambda c: F.concat("case_name", F.lit("\x01"), c)
    scopes = changes.select("case_name", "path", documentation.scope_of(F.col("diff")).alias("s"))
    named = lambda side: scopes.select("case_name", F.explode(f"s.{side}").alias("name")).select(mark(F.col("name")).alias("name"))
    asked = claims.withColumns({"path": mark(F.col("path")), "subject": mark(F.col("subject"))})
    found = documentation.defects(asked, index.withColumn("name", mark(F.col("name"))).drop("case_name"), named("removed"), named("touched"), scopes.select(mark(F.col("path")).alias("path")))
    rows = found.select(F.substring_index("path", "\x01", 1).alias("case_name"), F.col("rule").alias("rule_id"), F.col("line").alias("line_number"), F.lit("low").alias("severity"))
    return grade(expected, rows, forbidden, cases)
