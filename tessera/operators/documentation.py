"""Documents against code: what Markdown claims, what a change removed or touched, and where the two contradict each other.

A document is read where it lies, in one Arrow pass; whether a line stands in a fence depends on all lines before it, and a
document is one row. Claims, scope and index are tables, and a defect is a join of the three.
"""

from __future__ import annotations

import ast
import re
import textwrap

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# The shapes of headings, fences, spans and what they name; fences that hold Python.
HEADING = re.compile(r"^\s{0,3}(#{1,6})\s+(.+?)\s*#*\s*$")
FENCE, SPAN = re.compile(r"^\s*```([A-Za-z0-9_+-]*)\s*$"), re.compile(r"`([^`\n]+)`")
OPTION, ENVIRONMENT = r"^--[A-Za-z][A-Za-z0-9-]*$", r"^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$"
DOTTED = r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*"
CALL, CAMEL, PARAMETER = rf"^({DOTTED})\((.*)\)$", r"^[A-Z][a-z0-9]+[A-Z]", r"^[A-Za-z_][A-Za-z0-9_]*$"
PYTHON_FENCES = ("python", "py", "python3")
# What a line of a diff defines or spells.
DEFINES, CONSTANT = r"^\s*(async\s+def|def|class)\s+([A-Za-z_][A-Za-z0-9_]*)", r"^([A-Z][A-Z0-9_]*)\s*(?::[^=]+)?="
QUOTED = r"""["'](--[A-Za-z][A-Za-z0-9-]*|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)["']"""

CLAIMS = "path string, ordinal int, line int, kind string, subject string, params array<string>, heading string, parses boolean"


def _read(text: str):
    """(line, token, heading, whether a Python fence parses) of a document's spans and Python fences, in order."""
    heading, fence, start, held = "", None, 0, []
    for number, line in enumerate(text.splitlines(), 1):
        if mark := FENCE.match(line):
            if fence is None:
                fence, start, held = mark[1].lower(), number, []
                continue
            if fence in PYTHON_FENCES:
                try:
                    ast.parse(textwrap.dedent("".join(f"{x}\n" for x in held)))
                    yield start, None, heading, True
                except (SyntaxError, ValueError):
                    yield start, None, heading, False
            fence = None
        elif fence is not None:
            held.append(line)
        elif title := HEADING.match(line):
            heading = title[2]
        else:
            for token in SPAN.findall(line):
                if token.strip():
                    yield number, token.strip(), heading, None


def claims(documents: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """(path, ordinal, line, kind, subject, params, heading, parses) of Markdown documents.

    kind: example (a Python fence, which parses or not), option, environment, signature (a call with plain parameter names),
    symbol (dotted, snake or camel case, or a call with other arguments), word (any other name: a symbol only where a change
    names it). Other spans claim nothing.
    """

    def run(batches):
        for pdf in batches:
            rows = [(p, i, *row) for p, t in zip(pdf["path"], pdf["content"], strict=True) for i, row in enumerate(_read(t or ""))]
            yield pd.DataFrame(rows, columns=["path", "ordinal", "line", "token", "heading", "parses"])

    spans = documents.select(F.col(path).alias("path"), F.col(text).alias("content")).mapInPandas(run, "path string, ordinal int, line int, token string, heading string, parses boolean")
    t = F.col("token")
    inside = F.trim(F.regexp_extract(t, CALL, 2))
    params = F.transform(F.split(inside, ","), lambda x: F.trim(x))
    plain = (inside != "") & F.forall(params, lambda x: x.rlike(PARAMETER))
    called = t.rlike(CALL)
    kind = (
        F.when(t.isNull(), "example").when(t.rlike(OPTION), "option").when(t.rlike(ENVIRONMENT), "environment").when(called & plain, "signature").when(called, "symbol")
        .when(~t.rlike(f"^{DOTTED}$"), None).when(F.contains(t, F.lit(".")) | F.contains(t, F.lit("_")) | t.rlike(CAMEL), "symbol").otherwise("word")
    )
    subject = F.when(t.isNull(), "").when(called & ~t.rlike(OPTION) & ~t.rlike(ENVIRONMENT), F.regexp_extract(t, CALL, 1)).otherwise(t)
    shaped = spans.withColumns({"kind": kind, "subject": subject}).withColumn("params", F.when(F.col("kind") == "signature", params))
    return shaped.filter("kind is not null").select(*[c.split()[0] for c in CLAIMS.split(", ")])


def _sides(diff: Column) -> tuple[Column, Column]:
    """The removed and the added lines of a diff, without file and hunk headers."""
    lines = F.filter(F.split(F.coalesce(diff, F.lit("")), "\r\n|\n|\r"), lambda x: ~(x.startswith("---") | x.startswith("+++") | x.startswith("@@")))
    side = lambda sign: F.transform(F.filter(lines, lambda x: x.startswith(sign)), lambda x: F.substring(x, 2, 1 << 30))
    return side("-"), side("+")


def declarations_on(lines: Column) -> Column:
    """array<struct<kind, name>> that lines define (function, class, constant) or spell in quotes (option, environment), each once."""
    pair = lambda kind, name: F.struct(kind.alias("kind"), name.alias("name"))
    defined = F.transform(F.filter(lines, lambda x: x.rlike(DEFINES)), lambda x: pair(F.when(F.regexp_extract(x, DEFINES, 1) == "class", "class").otherwise("function"), F.regexp_extract(x, DEFINES, 2)))
    constants = F.transform(F.filter(lines, lambda x: ~x.rlike(DEFINES) & x.rlike(CONSTANT)), lambda x: pair(F.lit("constant"), F.regexp_extract(x, CONSTANT, 1)))
    quoted = F.flatten(F.transform(lines, lambda x: F.transform(F.regexp_extract_all(x, F.lit(QUOTED), 1), lambda v: pair(F.when(v.startswith("--"), "option").otherwise("environment"), v))))
    return F.array_distinct(F.concat(defined, constants, quoted))


def scope_of(diff: Column) -> Column:
    """struct<removed, touched>: names that only removed lines have; all names on either side. Sorted."""
    names = lambda side: F.array_distinct(F.transform(declarations_on(side), lambda d: d["name"]))
    removed, added = _sides(diff)
    return F.struct(F.array_sort(F.array_except(names(removed), names(added))).alias("removed"), F.array_sort(F.array_union(names(removed), names(added))).alias("touched"))


def merged_scope(scopes: DataFrame, *by: str) -> DataFrame:
    """The union of scopes (removed, touched) per group: a change is many files and one scope."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    return scopes.groupBy(*by).agg(union("removed"), union("touched"))


def rename_of(diff: Column) -> Column:
    """struct<old, new> where a diff takes away exactly one declaration and brings exactly one, of the same kind; else null."""
    removed, added = (declarations_on(side) for side in _sides(diff))
    gone, new = F.array_except(removed, added), F.array_except(added, removed)
    one, other = F.get(gone, F.lit(0)), F.get(new, F.lit(0))
    fits = (F.size(gone) == 1) & (F.size(new) == 1) & (one["kind"] == other["kind"]) & (one["name"] != other["name"])
    return F.when(fits, F.struct(one["name"].alias("old"), other["name"].alias("new")))


def tail(name: Column) -> Column:
    """The last part of a dotted name; what stands before \\x01 marks whose name it is, and stays."""
    owner = F.when(F.contains(name, F.lit("\x01")), F.concat(F.substring_index(name, "\x01", 1), F.lit("\x01"))).otherwise("")
    return F.concat(owner, F.substring_index(F.substring_index(name, "\x01", -1), ".", -1))


def defects(claim_rows: DataFrame, index: DataFrame, removed: DataFrame, touched: DataFrame, edited: DataFrame) -> DataFrame:
    """(path, line, heading, rule, subject) of claims that a change proves wrong.

    index: kind (symbol, option, environment), name, params (null: none are known). removed, touched: name. edited: path of
    documents that the change itself edits. A name is dead if the change removed it and the index has neither it nor its last
    part. A signature is compared where the change touched its name, or the last part of it and only one dotted symbol ends so,
    or the document is edited. An empty index proves nothing but examples.
    """
    known = index.select("kind", "name").distinct()
    names = known.filter("kind = 'symbol'").select("name")
    by_tail = names.filter(F.col("name") != tail(F.col("name"))).groupBy(tail(F.col("name")).alias("tail")).agg(F.count(F.lit(1)).alias("owners"))
    held = names.select(F.col("name").alias("subject"), F.lit(True).alias("whole"))
    resolved = names.select(F.col("name").alias("tail"), F.lit(True).alias("ends"))
    defined = index.filter("kind = 'symbol' and params is not null").groupBy(F.col("name").alias("subject")).agg(F.min("params").alias("defined"))
    literal = known.filter("kind <> 'symbol'").select("kind", F.col("name").alias("subject"), F.lit(True).alias("spelled"))
    gone = removed.select(F.col("name").alias("subject"), F.lit(True).alias("gone")).distinct()
    hit = touched.select(F.col("name").alias("subject"), F.lit(True).alias("hit")).distinct()
    hit_tail = touched.select(F.col("name").alias("tail"), F.lit(True).alias("hit_tail")).distinct()
    mine = edited.select("path", F.lit(True).alias("mine")).distinct()
    some = index.agg((F.count(F.lit(1)) > 0).alias("some"))
    rows = claim_rows.withColumn("tail", tail(F.col("subject")))
    for side, on in ((held, "subject"), (resolved, "tail"), (defined, "subject"), (literal, ["kind", "subject"]), (gone, "subject"), (hit, "subject"), (hit_tail, "tail"), (by_tail, "tail"), (mine, "path")):
        rows = rows.join(side, on, "left")
    rows = rows.join(F.broadcast(some))  # one row
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    named = F.col("kind").isin("symbol", "signature") | ((F.col("kind") == "word") & (yes("gone") | yes("hit")))
    covered = yes("hit") | ((F.col("tail") != F.col("subject")) & yes("hit_tail") & (F.col("owners") == 1))
    rule = (
        F.when((F.col("kind") == "example") & yes("mine") & ~F.col("parses"), "DOCS.BROKEN_EXAMPLE")
        .when(F.col("some") & named & yes("gone") & ~yes("whole") & ~yes("ends"), "DOCS.DEAD_REFERENCE")
        .when(F.col("some") & (F.col("kind") == "signature") & (yes("mine") | F.coalesce(covered, F.lit(False))) & (F.col("params") != F.col("defined")), "DOCS.SIGNATURE_MISMATCH")
        .when(F.col("some") & (F.col("kind") == "option") & yes("gone") & ~yes("spelled"), "DOCS.UNKNOWN_OPTION")
        .when(F.col("some") & (F.col("kind") == "environment") & yes("gone") & ~(yes("spelled") | yes("whole") | yes("ends")), "DOCS.UNKNOWN_OPTION")
    )
    return rows.withColumn("rule", rule).filter("rule is not null").select("path", "line", "heading", "rule", "subject")


def renamed_line(line: Column, old: Column, new: Column) -> Column:
    """The line with every whole word ``old`` replaced; null where it has none."""
    quoted = F.concat(F.lit(r"\b\Q"), old, F.lit(r"\E\b"))
    made = F.regexp_replace(line, quoted, new)
    return F.when(made != line, made)
