"""Edits: rewrites of a cited line by rule, applied bottom-up."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tessera.operators.joins import lines_of, namespace

# Rewrites by rule.
DIGEST, YAML, RANDOM, EXCEPT = r"\bhashlib\.(?:md5|sha1)\s*\(", r"\byaml\.load\s*\((?![^)]*Loader\s*=)", r"\brandom\.(random|randint|choice|randrange|shuffle|uniform)\(", r"^(\s*)except\s*:\s*$"
HTTP, SECRET = r"(['\"])http://(?!(?:localhost|127\.0\.0\.1|\[::1\])(?:[:/]|\1))([^'\"]*)\1", r"^(\s*)([A-Z][A-Z0-9_]*)\s*=\s*['\"][^'\"]+['\"]\s*$"


RECIPES = ("SAST.WEAK_CRYPTO", "SAST.INSECURE_DESERIALIZATION", "SAST.HARDCODED_SECRET", "SAST.INSECURE_RANDOM", "SAST.INSECURE_HTTP", "QUALITY.ERROR_HANDLING")


def rewritten(rule: Column, line: Column, has_os: Column, raises_soon: Column) -> Column:
    """The line after its rule's recipe; null where there is none, it declines, or nothing changes."""
    outside = ~F.substring_index(line, "random.", 1).rlike(r"#|['\"][^'\"]*$")
    once = F.concat(F.regexp_extract(line, "^(.*?)" + RANDOM, 1), F.lit("secrets.SystemRandom()."), F.regexp_extract(line, RANDOM, 1), F.lit("("), F.regexp_extract(line, RANDOM + "(.*)$", 2))
    made = (
        F.when(rule == "SAST.WEAK_CRYPTO", F.regexp_replace(line, DIGEST, "hashlib.sha256("))
        .when(rule == "SAST.INSECURE_DESERIALIZATION", F.regexp_replace(line, YAML, "yaml.safe_load("))
        .when((rule == "SAST.HARDCODED_SECRET") & has_os, F.regexp_replace(line, SECRET, '$1$2 = os.environ["$2"]'))
        .when((rule == "SAST.INSECURE_RANDOM") & line.rlike(RANDOM) & outside, once)
        .when(rule == "SAST.INSECURE_HTTP", F.regexp_replace(line, HTTP, "$1https://$2$1"))
        .when((rule == "QUALITY.ERROR_HANDLING") & ~raises_soon, F.regexp_replace(line, EXCEPT, "$1except Exception:"))
    )
    return F.when(made != line, made)


# Who may author an edit.
DETERMINISTIC = ("SAST", "QUALITY", "PERFORMANCE", "SEMANTIC", "DOCS")


def suggest(findings: DataFrame, files: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """(file_path, line, rule_id, before, after): at most one edit per line of Python files, on changed lines if these are given.

    findings: file_path, line_number, rule_id. files: file_path, content. changed: file_path, line. Only rules of analyzers
    propose edits, and a file that parses must parse with its edit. An edit that needs a module comes without the import:
    ``import_anchor`` says where that belongs.
    """
    lines = lines_of(files, "content", "file_path")
    os_files = files.select("file_path", F.col("content").rlike(r"(?m)^\s*(?:import\s+os\b|from\s+os\s+import\b)").alias("has_os"))
    soon = lines.filter(F.col("body").rlike(r"^\s*raise\b")).select("file_path", F.explode(F.sequence(F.col("line") - 3, F.col("line") - 1)).alias("line"), F.lit(True).alias("soon")).distinct()
    asked = findings.filter(F.col("file_path").endswith(".py") & namespace(F.col("rule_id")).isin(*DETERMINISTIC)).withColumnRenamed("line_number", "line")
    if changed is not None:
        asked = asked.join(changed, ["file_path", "line"], "left_semi")
    rows = asked.join(lines, ["file_path", "line"]).join(os_files, "file_path").join(soon, ["file_path", "line"], "left")
    edits = rows.withColumn("after", rewritten(F.col("rule_id"), F.col("body"), F.col("has_os"), F.coalesce("soon", F.lit(False)))).filter("after is not null")
    best = edits.groupBy("file_path", "line").agg(F.min(F.struct("rule_id", F.col("body").alias("before"), "after")).alias("e"))
    return _still_parsing(best.select("file_path", "line", "e.*"), files)


def _parses(source: str) -> bool:
    try:
        ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


def _still_parsing(edits: DataFrame, files: DataFrame) -> DataFrame:
    """The edits that do not break a file which parses without them."""

    @F.pandas_udf("boolean")
    def holds(content: pd.Series, line: pd.Series, after: pd.Series) -> pd.Series:
        def one(text, n, new):
            lines = text.split("\n")
            lines[n - 1] = new
            return _parses("\n".join(lines)) or not _parses(text)

        return pd.Series([one(*row) for row in zip(content, line, after, strict=True)], dtype=bool)

    return edits.join(files.select("file_path", "content"), "file_path").filter(holds(F.col("content"), F.col("line"), F.col("after"))).drop("content")


def import_anchor(source: Column, module: str) -> Column:
    """The line behind which ``import module`` belongs: the last import, else the docstring's end, else 0, the top; null where the
    module is imported anywhere, or the file is empty or does not parse."""

    @F.pandas_udf("int")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([_anchor(t or "", module) for t in texts], dtype="Int32")

    return made(source)


def _anchor(source: str, module: str) -> int | None:
    if not source.strip() or not _parses(source):
        return None
    tree = ast.parse(source)
    for node in ast.walk(tree):
        names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
        if any(n == module or (isinstance(node, ast.Import) and n.startswith(f"{module}.")) for n in names):
            return None
    if held := [n.end_lineno for n in tree.body if isinstance(n, (ast.Import, ast.ImportFrom))]:
        return max(held)
    return tree.body[0].end_lineno if tree.body and ast.get_docstring(tree, clean=False) is not None else 0


def applied(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(file_path, content): files with all their edits (line, after); null where an edit is out of range. A last newline stays."""
    wanted = edits.groupBy("file_path").agg(F.map_from_entries(F.collect_list(F.struct("line", "after"))).alias("edits"))
    lines = F.split("content", "\n")
    fits = F.forall(F.map_keys("edits"), lambda n: (n >= 1) & (n <= F.size(lines)))
    text = F.array_join(F.transform(lines, lambda x, i: F.coalesce(F.try_element_at("edits", i + 1), x)), "\n")
    return files.join(wanted, "file_path", "left").select("file_path", F.when(F.col("edits").isNull(), F.col("content")).when(fits, text).alias("content"))
