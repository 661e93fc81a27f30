"""Lookup joins: suppression, control coverage, attribution, documentation claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.operators import search
from tessera.operators.history import first_of

# Fixed value: the form of an ignore directive. Group 1: -file, 2: rules, 3: reason.
DIRECTIVE = r"(?i)(?:#|//)\s*review-ignore(-file)?\s*:\s*([A-Za-z_][A-Za-z0-9_.*]*(?:\s*,\s*[A-Za-z_][A-Za-z0-9_.*]*)*)(?:\s*[-—:]\s*(.*))?$"


def namespace(rule: Column) -> Column:
    return F.substring_index(rule, ".", 1)


def lines_of(files: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per line of ``text``: line (from 1) and body."""
    return files.select(*keep, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line", "body")).withColumn("line", F.col("line") + 1)


def directives(files: DataFrame, text: str = "content") -> DataFrame:
    """(file_path, ordinal, line, target_line, file_level, rule, reason): a standalone comment covers the next line, a bare * nothing."""
    rows = lines_of(files, text, "file_path").filter(F.col("body").rlike(DIRECTIVE))
    rules = F.transform(F.split(F.regexp_extract("body", DIRECTIVE, 2), ","), lambda x: F.trim(x))
    file_level = F.regexp_extract("body", DIRECTIVE, 1) != ""
    standalone = F.ltrim("body").startswith("#") | F.ltrim("body").startswith("//")
    out = rows.select("file_path", "line", file_level.alias("file_level"), F.when(standalone & ~file_level, F.col("line") + 1).otherwise(F.col("line")).alias("target_line"), F.trim(F.regexp_extract("body", DIRECTIVE, 3)).alias("reason"), F.posexplode(F.filter(rules, lambda r: r != "")).alias("ordinal", "rule"))
    return out.filter("rule <> '*'")


def suppress(findings: DataFrame, directive_rows: DataFrame, key: str) -> DataFrame:
    """Every finding with the directive that covers it, or nulls. File-level directives come first, then the first written.

    Two equi-joins instead of one with an OR: on (file, rule or namespace), then kept where the line fits. ``key`` names a
    column that identifies a finding.
    """
    rules = directive_rows.withColumns({"glob": F.col("rule").endswith(".*"), "target": F.when(F.col("rule").endswith(".*"), F.expr("substr(rule, 1, length(rule) - 2)")).otherwise(F.col("rule"))})
    slim = rules.select("file_path", "target", "glob", F.struct((~F.col("file_level")).cast("int").alias("late"), "line", "ordinal", "rule", "reason", "file_level", "target_line").alias("d"))
    asked = findings.select(F.col(key).alias("__of"), "file_path", "line_number", F.explode(F.array(F.struct(F.col("rule_id").alias("target"), F.lit(False).alias("glob")), F.struct(namespace(F.col("rule_id")).alias("target"), F.lit(True).alias("glob")))).alias("t"))
    hits = asked.select("__of", "file_path", "line_number", "t.target", "t.glob").join(slim, ["file_path", "target", "glob"]).filter(F.col("d.file_level") | (F.col("d.target_line") == F.col("line_number")))
    best = hits.groupBy("__of").agg(F.min("d").alias("d"))
    return findings.join(best, findings[key] == best["__of"], "left").select(*findings.columns, F.col("d.rule").alias("directive"), F.col("d.line").alias("directive_line"), F.col("d.reason").alias("directive_reason"))


def control_coverage(controls: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(control, namespaces, n_findings) with zeros, and the namespaces of findings that no control maps (namespace, n_findings).

    Findings are counted per namespace first, so what is joined is as small as the catalogue.
    """
    counts = findings.groupBy(namespace(F.col("rule_id")).alias("namespace")).agg(F.count("*").alias("n"))
    mapped = controls.select("control", F.explode("namespaces").alias("namespace"))
    covered = mapped.join(counts, "namespace", "left").groupBy("control").agg(F.count("*").alias("namespaces"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_findings"))
    return covered, counts.join(mapped, "namespace", "left_anti").withColumnRenamed("n", "n_findings")


def attribute(claims: DataFrame, producers: DataFrame) -> DataFrame:
    """Adds producer and may_block; an unknown namespace is the agent's, which can't block."""
    known = producers.select("namespace", F.col("producer").alias("__p"))
    joined = claims.withColumn("namespace", namespace(F.col("rule_id"))).join(known, "namespace", "left")
    producer = F.coalesce("__p", F.lit("agent"))
    return joined.select(*claims.columns, producer.alias("producer"), (producer != "agent").alias("may_block"))


def deterministic_only(attributed: DataFrame) -> DataFrame:
    return attributed.filter("may_block")


def usage_class(context: Column, symbol: Column) -> Column:
    """import > inheritance > call > type > data_structure, by what stands around the symbol."""
    around = lambda before, after: F.regexp_like(context, F.concat(F.lit(before + r"\Q"), symbol, F.lit(r"\E" + after)))
    return (
        F.when(context.rlike(r"^\s*(?:import|from)\s"), "import")
        .when(around(r"class\s+\w+\s*\([^)]*\b", r"\b"), "inheritance")
        .when(around(r"\b", r"\s*\("), "call")
        .when(around(r":\s*[^=]*\b", r"\b") | around(r"->\s*[^:]*\b", r"\b"), "type")
        .otherwise("data_structure")
    )


def usages(symbols: DataFrame, files: DataFrame, cap: int = 50) -> DataFrame:
    """(symbol, path, line, usage): up to ``cap`` lines of files (path, content) per symbol that hold it, in path order; see :mod:`search`.

    A symbol is found as it is spelled, also inside a longer word.
    """
    hits = search.first_hits(search.search(files, symbols), cap)
    return hits.select("symbol", "path", "line", usage_class(F.col("body"), F.col("symbol")).alias("usage"))


def impact(usage_rows: DataFrame) -> DataFrame:
    """Per symbol: files that use it and the risk, over 10 / 5 / 2 files."""
    n = F.countDistinct("path")
    return usage_rows.groupBy("symbol").agg(n.alias("files"), F.when(n > 10, "critical").when(n > 5, "high").when(n > 2, "medium").otherwise("low").alias("risk"))


def containing(rows: DataFrame, functions: DataFrame) -> DataFrame:
    """Adds the outermost function (path, name, start, end) that holds each (path, line); null outside. Ties: the earlier start, then name."""
    spans = functions.select("path", "name", "start", "end")
    inside = rows.select("path", "line").distinct().join(spans, "path").filter("line between start and end")
    best = inside.groupBy("path", "line").agg(F.min_by("name", F.struct(F.expr("start - end"), "start", "name")).alias("function"))
    return rows.join(best, ["path", "line"], "left")


def ripple(edges: DataFrame, first_cap: int = 50, second_cap: int = 5) -> DataFrame:
    """Two hops over (source, target): the first hop's rows, and up to ``second_cap`` of the second per row of the first."""
    from pyspark.sql import Window

    one = edges.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("target"))).filter(F.col("n") <= first_cap).select(F.col("source").alias("root"), "target", F.lit(1).alias("hop"))
    next_ = edges.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("target"))).filter(F.col("n") <= second_cap + 1)
    second = one.select("root", F.col("target").alias("via")).join(next_.select(F.col("source").alias("via"), "target"), "via").filter("target <> root")
    kept = second.withColumn("k", F.row_number().over(Window.partitionBy("root", "via").orderBy("target"))).filter(F.col("k") <= second_cap).select("root", "target", F.lit(2).alias("hop"))
    return one.unionByName(kept)


def impact_summary(usage_rows: DataFrame) -> DataFrame:
    """(symbol, usage, n, place): how often a symbol is used in which way, most often first, ties by name."""
    from pyspark.sql import Window

    counts = usage_rows.groupBy("symbol", "usage").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("n"), "usage")))


def call_graph(edges: DataFrame, entries: DataFrame, depth: int = 3, fan: int = 10, deeper: int = 5) -> DataFrame:
    """(entry, name, level, callers, callees): the functions reached from each entry over calls (caller, callee), level by level.

    A function shows up to ``fan`` callers and callees, in name order; the first ``deeper`` callees are followed, none twice per entry.
    """
    from pyspark.sql import Window

    once = edges.select("caller", "callee").distinct()
    first = lambda by, of: once.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(of))).filter(F.col("n") <= fan)
    out_of, into = first("caller", "callee"), first("callee", "caller")
    front = entries.select(F.col("name").alias("entry"), "name").distinct().withColumn("level", F.lit(0))
    seen = front
    for level in range(1, depth):
        step = front.join(out_of.filter(F.col("n") <= deeper), F.col("name") == F.col("caller")).select("entry", F.col("callee").alias("name")).distinct()
        front = step.join(seen, ["entry", "name"], "left_anti").withColumn("level", F.lit(level))
        seen = seen.unionByName(front)
    held = lambda rows, by, of, out: rows.groupBy(F.col(by).alias("name")).agg(F.array_sort(F.collect_list(of)).alias(out))
    found = seen.join(held(into, "callee", "caller", "callers"), "name", "left").join(held(out_of, "caller", "callee", "callees"), "name", "left")
    none = F.array().cast("array<string>")
    return found.select("entry", "name", "level", F.coalesce("callers", none).alias("callers"), F.coalesce("callees", none).alias("callees"))


def first_symbols(entries: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    return first_of(entries, keys, [F.col(arrival)])
