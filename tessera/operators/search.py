"""Fixed-string search of many patterns at once, with the deny-list and the limits of the safe search.

All patterns are found in one pass over each file by an Aho-Corasick automaton, which every task builds once. Patterns that do
not fit one automaton of a checked size are dealt into several, each with a pass of its own.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.text import basename, stripped

# What a pattern looks like, and what is never searched.
VALID_PATTERN, MAX_PATTERN, MAX_COUNT = r"^[A-Za-z0-9_][A-Za-z0-9_.:/-]*$", 200, 200
EXCLUDED_DIRS = (".git", ".gradle", ".idea", ".mypy_cache", ".pytest_cache", ".tox", ".venv", "__pycache__", "build", "dist", "node_modules", "venv")
EXCLUDED_FILES = (".env", ".env.*", ".netrc", ".npmrc", ".pypirc", "*.pem", "*.key", "*.p12", "*.pfx", "id_rsa", "id_*", "*.lock", "*.min.js")

#: Patterns of one automaton: at most so many of at most MAX_PATTERN characters each, so what is broadcast has a bound.
AUTOMATON_PATTERNS = 50_000
BATCH_BYTES = 4 << 20
_EXCLUDED = "^(" + "|".join(g.replace(".", r"\.").replace("*", ".*") for g in EXCLUDED_FILES) + ")$"


def valid_search(pattern: Column) -> Column:
    """Whether a pattern, trimmed, may be searched: a symbol or a file name, not long, no flag, no climbing path."""
    text = stripped(pattern)
    return F.coalesce((F.length(text) <= MAX_PATTERN) & ~F.contains(text, F.lit("..")) & text.rlike(VALID_PATTERN), F.lit(False))


def searchable(path: Column, content: Column) -> Column:
    """Whether a file is searched: not binary, not in an excluded directory, not of an excluded name (in its exact case)."""
    parents = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    return ~F.arrays_overlap(parents, F.array(*map(F.lit, EXCLUDED_DIRS))) & ~basename(path).rlike(_EXCLUDED) & ~F.contains(content, F.lit("\x00"))


def _automaton(patterns: list[str]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for i, pattern in enumerate(patterns):
        made.add_word(pattern, i)
    made.make_automaton()
    return made


def _matches(automaton, content: str, n_patterns: int, per_file: int) -> Iterator[tuple[int, int, str]]:
    """(pattern, line, body) of each line that holds a pattern, up to ``per_file`` lines of each pattern, in the order of lines."""
    starts, at = [0], content.find("\n")
    while at >= 0:
        starts.append(at + 1)
        at = content.find("\n", at + 1)
    last, lines = {}, Counter()
    for end, pattern in automaton.iter(content):
        line = bisect.bisect_right(starts, end)
        if last.get(pattern) != line and lines[pattern] < per_file:
            last[pattern] = line
            lines[pattern] += 1
            yield pattern, line, content[starts[line - 1] : starts[line] - 1 if line < len(starts) else len(content)]


def search(files: DataFrame, patterns: DataFrame, per_file: int = MAX_COUNT) -> DataFrame:
    """(symbol, path, line, body): lines of ``files`` (path, content) that hold a pattern of ``patterns`` (symbol) as it is spelled.

    Patterns are trimmed; those that may not be searched (:func:`valid_search`) find nothing. Of each pattern the first
    ``per_file`` lines of a file are returned, which is the search's own limit. Excluded and binary files have no lines.
    """
    wanted = patterns.filter(valid_search(F.col("symbol"))).select(stripped(F.col("symbol")).alias("symbol")).distinct()
    blocks = max(1, math.ceil(wanted.count() / (AUTOMATON_PATTERNS * 0.8))) if wanted.count() > AUTOMATON_PATTERNS else 1
    texts = files.filter(searchable(F.col("path"), F.col("content"))).select("path", "content")
    found = None
    for block in range(blocks):
        mine = wanted if blocks == 1 else wanted.filter(F.pmod(F.xxhash64("symbol"), F.lit(blocks)) == block)
        part = _searched(texts, sorted(row.symbol for row in mine.toLocalIterator()), per_file)
        found = part if found is None else found.unionByName(part)
    return found


def _searched(texts: DataFrame, patterns: list[str], per_file: int) -> DataFrame:
    schema = f"symbol string, path {texts.schema['path'].dataType.simpleString()}, line int, body string"
    shared = texts.sparkSession.sparkContext.broadcast(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value
        automaton = _automaton(names) if names else None
        kind = None
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            kinds = [pa.string(), kind, pa.int32(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["symbol", "path", "line", "body"])

        for texts_ in batches:
            kind = texts_.schema.field(0).type
            for path, content in zip(texts_.column(0).to_pylist(), texts_.column(1), strict=True):
                for pattern, line, body in _matches(automaton, content.as_py(), len(names), per_file) if automaton else ():
                    rows.append((names[pattern], path, line, body))
                    held += len(body) + 100
                    if held > BATCH_BYTES:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()

    return texts.filter("content is not null").mapInArrow(run, schema)


def first_hits(hits: DataFrame, cap: int) -> DataFrame:
    """Of each symbol the first ``cap`` hits in the order of path and line. The limit is taken in each task before rows move."""
    order = Window.partitionBy("symbol").orderBy("path", "line")
    return hits.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= cap).drop("n")
