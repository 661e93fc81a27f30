"""Chunking of sources and Markdown, duplicate blocks, greedy packing of lines."""

from __future__ import annotations

import ast
import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tessera.functions.text import INK, text_lines
from tessera.session import materialised

WINDOW, OVERLAP, SECTION_LINES, DUPLICATE_LINES = 40, 10, 80, 8
HEADING = r"^\s{0,3}#{1,6}\s+(.+?)\s*#*\s*$"
CHUNK = "path string, start_line int, end_line int, text string, name string"


def _windows(n_lines: Column, window: int, overlap: int) -> Column:
    """Array of (first, last, name): windows from line 1 on until the last line is covered."""
    step = max(1, window - overlap)
    last = F.greatest(F.lit(0), F.ceil((n_lines - window) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * step + 1).alias("first"), F.least(i * step + window, n_lines).alias("last"), F.lit("").alias("name")))


def _cut(rows: DataFrame) -> DataFrame:
    """One chunk for each span of each row (path, lines, spans); blank ones are left out. Chunks are cut before they become rows, so
    a file's lines are never copied into each of them."""
    held = F.filter("spans", lambda s: s["last"] >= s["first"])
    block = lambda s: F.array_join(F.slice("lines", s["first"], s["last"] - s["first"] + 1), "\n")
    cut = F.transform(held, lambda s: F.struct(s["first"].alias("start_line"), s["last"].alias("end_line"), block(s).alias("text"), s["name"].alias("name")))
    return rows.select("path", F.inline(cut)).filter(F.col("text").rlike(INK))


def windows(files: DataFrame, path: str = "path", text: str = "content", window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """Overlapping windows of lines until the end is covered; blank ones are left out. A file is cut where it lies, without a shuffle."""
    cut = files.filter(F.col(text).isNotNull()).select(F.col(path).alias("path"), text_lines(F.col(text)).alias("lines"))
    return _cut(cut.withColumn("spans", _windows(F.size("lines"), window, overlap)))


def per_file(files: DataFrame, path: str, text: str, cut: Callable[[str], Iterator[tuple]], schema: str) -> DataFrame:
    """One row per tuple that ``cut`` makes of each file's text, behind its path. A file is read where it lies, in one Arrow pass."""

    def run(batches):
        for pdf in batches:
            rows = [(p, *row) for p, t in zip(pdf["path"], pdf["content"], strict=True) for row in cut(t or "")]
            yield pd.DataFrame(rows, columns=names)

    names = ["path", *(c.split()[0] for c in schema.split(", "))]
    kind = dict(files.dtypes)[path]
    return files.select(F.col(path).alias("path"), F.col(text).alias("content")).mapInPandas(run, f"path {kind}, {schema}")


_HEADING, _FENCE = re.compile(HEADING, re.ASCII), re.compile(r"\s*```", re.ASCII)


def _sections(text: str, max_lines: int) -> Iterator[tuple]:
    lines, fenced, starts = text.splitlines(), False, [(0, "")]
    for i, line in enumerate(lines):
        fenced ^= bool(_FENCE.match(line))
        title = None if fenced else _HEADING.match(line)
        if title:
            starts.append((i, title[1]))
    for (first, name), (end, _) in zip(starts, [*starts[1:], (len(lines), "")], strict=True):
        for at in range(first, end, max_lines):
            block = "\n".join(lines[at : min(at + max_lines, end)])
            if re.search(r"\S", block, re.ASCII):
                yield at + 1, min(at + max_lines, end), block, name


def markdown(files: DataFrame, path: str = "path", text: str = "content", max_lines: int = SECTION_LINES) -> DataFrame:
    """Sections: a heading outside fences and all up to the next, in blocks of ``max_lines``; blank blocks are left out."""
    return per_file(files, path, text, lambda t: _sections(t, max_lines), CHUNK.removeprefix("path string, "))


def _below(body: list[ast.stmt], owner: str = "") -> Iterator[tuple[int, int, str]]:
    """(first line with decorators, last line, name) of the definitions of a module, and of the methods of its classes."""
    for node in body:
        is_class = isinstance(node, ast.ClassDef)
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) or (is_class and not owner):
            yield min(part.lineno for part in (node, *node.decorator_list)), node.end_lineno, owner + node.name
        if is_class and not owner:
            yield from _below(node.body, f"{node.name}.")


def _spans(source: str | None) -> list[tuple[int, int, str]] | None:
    """Where the chunks of a Python file lie: what is above the first definition (all, if there is none), then each definition."""
    try:
        tree = ast.parse(source) if source is not None else None
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    if tree is None:
        return None
    firsts = [n.lineno for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
    return [(1, min(firsts) - 1 if firsts else len(source.splitlines()), ""), *_below(tree.body)]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("name", T.StringType())])))
def _python_spans(sources: pd.Series) -> pd.Series:
    return sources.map(_spans, na_action=None)


def sources(files: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """Python files by definition (imports and constants first, classes, methods, functions); files that don't parse, and others, by windows.

    The tree gives line numbers only; lines are cut and joined where the file lies, in one pass.
    """
    cut = files.select(F.col(path).alias("path"), text_lines(F.col(text)).alias("lines"), _python_spans(F.when(F.col(path).endswith(".py"), F.col(text))).alias("spans"))
    return _cut(cut.withColumn("spans", F.coalesce("spans", _windows(F.size("lines"), WINDOW, OVERLAP))))


def _repeats(text: str, size: int) -> Iterator[tuple]:
    code = [(i, tidy) for i, line in enumerate(text.split("\n"), 1) if (tidy := " ".join(line.split())) and not tidy.startswith(("#", "//"))]
    seen: dict[str, list[int]] = {}
    for at in range(len(code) - size + 1):
        block = "\n".join(tidy for _, tidy in code[at : at + size])
        seen.setdefault(hashlib.md5(block.encode(), usedforsecurity=False).hexdigest(), []).append(code[at][0])
    yield from ((digest, starts) for digest, starts in seen.items() if len(starts) > 1)


def duplicate_blocks(files: DataFrame, path: str = "path", text: str = "content", size: int = DUPLICATE_LINES) -> DataFrame:
    """(path, hash, starts array<int>): runs of ``size`` normalised lines that a file has more than once. Comments and blanks are no lines."""
    return per_file(files, path, text, lambda t: _repeats(t, size), "hash string, starts array<int>")


def _greedy(text: str, budget: int) -> Iterator[tuple]:
    part, held, size = 0, [], 0
    for line in text.split("\n"):
        if held and size + len(line) + 1 > budget:
            yield part, "\n".join(held)
            part, held, size = part + 1, [], 0
        held.append(line)
        size += len(line) + 1
    yield part, "\n".join(held)


def greedy(files: DataFrame, path: str = "path", text: str = "content", budget: int = 2000) -> DataFrame:
    """(path, part, text): consecutive lines of up to ``budget`` characters, each with its newline; a longer line stands alone."""
    return per_file(files, path, text, lambda t: _greedy(t, budget), "part int, text string")


#: Rounds of running totals before what is left of each group is decided in order, row by row.
BUDGET_ROUNDS = 4


def _running(rows: DataFrame) -> DataFrame:
    """Adds ``upto``: the sum of ``size`` in a group (group, ordinal, path), up to and with each row.

    Rows are dealt to blocks by ranges of their order, so a group of any size is many blocks; blocks are summed, their sums are
    added up in order, and each block continues from the sum before it.
    """
    placed = materialised(rows.repartitionByRange("group", "ordinal", "path").withColumn("block", F.spark_partition_id()))
    earlier = Window.partitionBy("group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("group", "block").agg(F.sum("size").alias("all")).withColumn("before", F.coalesce(F.sum("all").over(earlier), F.lit(0))).drop("all")
    inside = Window.partitionBy("group", "block").orderBy("ordinal", "path").rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(sums, ["group", "block"]).withColumn("upto", F.col("before") + F.sum("size").over(inside)).drop("block", "before")


def _in_order(rows: DataFrame) -> DataFrame:
    """(group, ordinal, path) of the rows (group, ordinal, path, size, room) that are taken one after the other, as long as there is room.

    A group is read in order by one task, which holds one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, room = None, 0
        for batch in batches:
            taken = []
            for name, size, start in zip(*(batch.column(c).to_pylist() for c in ("group", "size", "room")), strict=True):
                if (name,) != group:
                    group, room = (name,), start
                taken.append(size <= room)
                room -= size if taken[-1] else 0
            yield batch.select(["group", "ordinal", "path"]).filter(pa.array(taken, pa.bool_()))

    ordered = rows.repartition("group").sortWithinPartitions("group", "ordinal", "path")
    return ordered.mapInArrow(run, ordered.select("group", "ordinal", "path").schema)


def read_within(files: DataFrame, per_file: int, total: int) -> DataFrame:
    """files: group, ordinal, path, content. Texts are cut to ``per_file``; in order, one that would exceed the group's ``total``
    is refused and adds nothing. Adds text (null: refused). Rows without a group are refused.

    Only sizes are ordered. All rows up to a group's first refusal are taken at once, by running totals; what is too large for the room
    that is left is refused for good, and the rest is asked again with that room, in rounds, and at last row by row.
    """
    sized = files.withColumn("size", F.least(F.length(F.coalesce("content", F.lit(""))), F.lit(per_file)).cast("long"))
    open_, taken = sized.select("group", "ordinal", "path", "size", F.lit(total).cast("long").alias("room")), []
    for _ in range(BUDGET_ROUNDS):
        run = materialised(_running(open_))
        fits = F.col("upto") <= F.col("room")
        taken.append(run.filter(fits).select("group", "ordinal", "path"))
        rooms = run.groupBy("group").agg((F.first("room") - F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0))).alias("room"))
        open_ = run.filter(~fits).drop("upto", "room").join(rooms, "group").filter("size <= room")
        if open_.isEmpty():
            break
    else:
        taken.append(materialised(_in_order(open_)))
    kept = functools.reduce(DataFrame.unionByName, taken).withColumn("ok", F.lit(True))
    return sized.join(kept, ["group", "ordinal", "path"], "left").select("group", "ordinal", "path", F.when(F.col("ok"), F.substring(F.coalesce("content", F.lit("")), 1, per_file)).alias("text"))
