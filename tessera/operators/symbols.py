"""The names that a code base defines: Python by syntax tree, with scopes; Go, JavaScript, TypeScript and Java by declaration.

Each file gives rows where it lies; the index is an aggregation of those, so of any number of files. A name may be defined often;
its signature is the first writer's, in the order of files and of depth, while a qualified name (``Class.method``) is the last one's.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.text import stripped, text_lines

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
# Declarations by suffix, tried in this order on a trimmed line; what marks a comment; what holds the environment.
SCRIPT = (
    r"^(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)\s*\(",
    r"^(?:export\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)\b",
    r"^(?:export\s+)?interface\s+([A-Za-z_$][\w$]*)\b",
    r"^(?:export\s+)?type\s+([A-Za-z_$][\w$]*)\s*=",
    r"^(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\b",
)
GO = (r"^func\s+([A-Za-z_]\w*)\s*\(", r"^func\s+\([^)]*\)\s*([A-Za-z_]\w*)\s*\(", r"^type\s+([A-Za-z_]\w*)\b", r"^(?:const|var)\s+([A-Za-z_]\w*)\b")
JAVA = (
    r"^(?:public\s+|private\s+|protected\s+|abstract\s+|final\s+|static\s+)*(?:class|interface|enum|record)\s+([A-Za-z_]\w*)\b",
    r"^(?:public\s+|private\s+|protected\s+|static\s+|final\s+|synchronized\s+)+[A-Za-z_][\w<>\[\],.\s]*\s+([A-Za-z_]\w*)\s*\(",
)
DECLARATIONS = {".go": GO, ".js": SCRIPT, ".jsx": SCRIPT, ".ts": SCRIPT, ".tsx": SCRIPT, ".java": JAVA}
PYTHON, COMMENTS = (".py", ".pyi"), ("//", "#", "*", "/*")
ENVIRONMENTS = frozenset({"environ", "env", "environment"})

ROWS = "path string, kind string, name string, params array<string>, depth int"
BATCH_ROWS = 4000


def _text(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def _last_name(node: ast.AST) -> str:
    return node.attr if isinstance(node, ast.Attribute) else node.id if isinstance(node, ast.Name) else ""


def _params(function: ast.AST) -> list[str]:
    a = function.args
    return [x.arg for group in (a.posonlyargs, a.args, a.kwonlyargs) for x in group if x.arg not in ("self", "cls")]


def _told(node: ast.AST, owner: ast.AST | None) -> Iterator[tuple[str, str, list[str] | None]]:
    """(kind, name, params) of what a node defines or reads; ``owner`` is the node right above it."""
    match node:
        case ast.ClassDef(name=name):
            yield "class", name, None
        case ast.FunctionDef(name=name) | ast.AsyncFunctionDef(name=name):
            yield "function", name, _params(node)
            if isinstance(owner, ast.ClassDef) and node in owner.body:
                yield "method", f"{owner.name}.{name}", _params(node)
        case ast.Assign(targets=targets):
            yield from (("assigned", t.id, None) for t in targets if isinstance(t, ast.Name))
        case ast.AnnAssign(target=ast.Name(id=name)):
            yield "assigned", name, None
        case ast.Call(func=function, args=args) if _last_name(function) == "add_argument":
            yield from (("option", text, None) for a in args if (text := _text(a)) and text.startswith("-"))
        case ast.Call(func=function, args=[first, *_]) if (name := _text(first)) is not None:
            read = isinstance(function, ast.Attribute) and function.attr == "get" and _last_name(function.value) in ENVIRONMENTS
            if read or _last_name(function) == "getenv":
                yield "environment", name, None
        case ast.Subscript(value=value, slice=key) if _last_name(value) in ENVIRONMENTS and _text(key) is not None:
            yield "environment", _text(key), None


def python_names(source: str) -> list[tuple[str, str, list[str] | None, int]]:
    """(kind, name, params, depth) of one file, from left to right; nothing, if it does not parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    found, open_ = [], [(tree, None, 0)]
    while open_:
        node, owner, depth = open_.pop()
        found += [(*told, depth) for told in _told(node, owner)]
        open_ += [(child, node, depth + 1) for child in reversed(list(ast.iter_child_nodes(node)))]
    return found


def _of_suffix(path: Column, suffixes: tuple[str, ...]) -> Column:
    return F.regexp_extract(path, r"(\.[^./]*)$", 1).isin(*suffixes)


def declared(files: DataFrame) -> DataFrame:
    """The same rows for files of the other languages: the first declaration of each line that is no comment."""

    def named(patterns: tuple[str, ...]) -> Callable[[Column], Column]:
        return lambda line: F.coalesce(*[F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in patterns])

    lines = F.transform(text_lines(F.col("content")), stripped)
    code = F.filter(lines, lambda x: ~F.exists(F.array(*map(F.lit, COMMENTS)), lambda mark: x.startswith(mark)))
    by_suffix = F.lit(None).cast("array<string>")
    for patterns in (GO, SCRIPT, JAVA):
        suffixes = tuple(s for s, p in DECLARATIONS.items() if p is patterns)
        by_suffix = F.when(_of_suffix(F.col("path"), suffixes), F.transform(code, named(patterns))).otherwise(by_suffix)
    rows = files.filter(_of_suffix(F.col("path"), tuple(DECLARATIONS))).select("path", F.explode(F.array_distinct(by_suffix)).alias("name"))
    return rows.filter("name is not null").select("path", F.lit("declaration").alias("kind"), "name", F.lit(None).cast("array<string>").alias("params"), F.lit(0).alias("depth"))


def names(files: DataFrame) -> DataFrame:
    """(path, kind, name, params, depth) of every file (path, content): class, function, method (qualified), assigned, declaration, option,
    environment. Files of other suffixes, and Python that does not parse, have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows += [(path, *told) for told in python_names(content.as_py() or "")]
                if len(rows) >= BATCH_ROWS:
                    yield as_batch(rows)
                    rows = []
            yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["path", "kind", "name", "params", "depth"])

    python = files.filter(_of_suffix(F.col("path"), PYTHON)).select("path", "content").mapInArrow(run, ROWS)
    return python.unionByName(declared(files))


def index(rows: DataFrame) -> DataFrame:
    """(kind, name, params): one row per symbol, option and environment name, ``kind`` being one of these three words.

    ``params`` is null for what has no signature. One aggregation with partial results in each task.
    """
    kind = F.when(F.col("kind").isin("option", "environment"), F.col("kind")).otherwise("symbol")
    first = F.struct(F.col("path"), F.col("depth"))
    bare = F.when(F.col("kind") == "function", first)
    qualified = F.when(F.col("kind") == "method", first)
    grouped = rows.groupBy(kind.alias("kind"), "name").agg(F.min_by("params", bare).alias("bare"), F.max_by("params", qualified).alias("qualified"))
    return grouped.select("kind", "name", F.coalesce("qualified", "bare").alias("params"))
