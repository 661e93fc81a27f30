"""A checkout as a table: a Python data source that prunes directories while it lists, and reads files in partitions of even bytes.

    checkout.register(spark)
    spark.read.format("checkout").option("suffixes", ".py,.go").load("s3://bucket/checkouts/app")

The driver lists the tree directory by directory (any store that Arrow opens: local or mounted, S3, GCS, HDFS) and never looks into
a pruned one. Files are planned into partitions by the bytes that will be read. A task reads at most the per-file ceiling of each
file and decodes it leniently, so no file can fail a scan or fill a worker. As with any file source, paths and sizes are held by
the driver, contents never are.
"""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# What is indexed, what is not walked, what is never read, and the ceilings.
SUFFIXES = (".py", ".pyi", ".go", ".js", ".jsx", ".ts", ".tsx", ".java", ".kt", ".rb", ".rs", ".c", ".cc", ".cpp", ".h", ".hpp", ".cs", ".sql", ".sh", ".yaml", ".yml", ".toml")
PRUNED = (".git", ".venv", "venv", "node_modules", "__pycache__", "dist", "build", ".mypy_cache", ".tox")
DENIED_NAMES = (".env", ".envrc", ".git", ".netrc", ".npmrc", ".pypirc", ".htpasswd", "credentials", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519")
DENIED_GLOBS = (".env.*", "*.pem", "*.key", "*.p12", "*.pfx", "*.keystore", "*_rsa", "*.ppk", "id_*")
MAX_FILE_BYTES, INDEX_BYTES = 200_000, 32 * 1024 * 1024
TRUNCATED = "\n\n[... truncated: file is larger than {0} bytes, only the first {0} were read ...]"

#: Bytes that one partition reads, and that one batch holds, about.
PARTITION_BYTES, BATCH_BYTES = 16 << 20, 4 << 20
SCHEMA = "ordinal long, path string, size long, truncated boolean, content string"

_DENIED = "|".join([*map(re.escape, DENIED_NAMES), *(re.escape(g).replace(r"\*", "[^/]*") for g in DENIED_GLOBS)])
_SENSITIVE = rf"(?i)(^|/)({_DENIED})(/|$)"


def is_sensitive(path: Column) -> Column:
    """Whether any part of a path is on the deny list, whatever its case."""
    return path.rlike(_SENSITIVE)


def sensitive_name(path: str) -> bool:
    """The same for a path that is no column."""
    parts = path.lower().split("/")
    return any(p in DENIED_NAMES or any(fnmatch.fnmatchcase(p, g) for g in DENIED_GLOBS) for p in parts)


@dataclass
class Files(InputPartition):
    """(ordinal, path below the root, size, bytes to read) of each file of a partition."""

    files: list[tuple[int, str, int, int]]


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The store of a root and the root's path in it. Spark writes ``file:/x`` for what Arrow calls ``file:///x``."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", root).rstrip("/") or "/")


def walked(store: fs.FileSystem, root: str, suffixes: tuple[str, ...], pruned: tuple[str, ...] = PRUNED) -> Iterator[tuple[str, int]]:
    """(path below the root, size) in walking order: a directory's files by name, then its directories by name.

    Pruned directories are not listed. Sensitive files are left out, and so is a link that leads out of the root, to a sensitive
    file or to a directory.
    """
    local = isinstance(store, fs.LocalFileSystem)
    home = os.path.realpath(root) if local else root
    open_ = [root]
    while open_:
        found = sorted(store.get_file_info(fs.FileSelector(open_.pop(), allow_not_found=True)), key=lambda i: i.base_name)
        for info in found:
            below = info.path[len(root) :].lstrip("/")
            if info.type != fs.FileType.File or os.path.splitext(info.base_name)[1] not in suffixes or sensitive_name(below):
                continue
            if local and os.path.islink(info.path):
                real = os.path.realpath(info.path)
                if not real.startswith(home.rstrip("/") + "/") or sensitive_name(real[len(home) :].lstrip("/")):
                    continue
            yield below, info.size
        open_ += [i.path for i in reversed(found) if i.type == fs.FileType.Directory and i.base_name not in pruned and not (local and os.path.islink(i.path))]


def within(files: Iterator[tuple[str, int]], each: int, total: int | None) -> Iterator[tuple[int, str, int, int]]:
    """(ordinal, path, size, bytes to read): a file that no longer fits into ``total`` is refused; smaller ones behind it may fit."""
    used = 0
    for ordinal, (path, size) in enumerate(files):
        taken = min(size, each)
        if total is None or used + taken <= total:
            used += taken
            yield ordinal, path, size, taken


class CheckoutReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("load() needs the root of the checkout")
        self.root, self.total = options["path"], int(options["totalbytes"]) if "totalbytes" in options else None
        self.suffixes = tuple(s for s in options.get("suffixes", ",".join(SUFFIXES)).split(",") if s)
        self.each, self.per_partition = int(options.get("maxfilebytes", MAX_FILE_BYTES)), int(options.get("partitionbytes", PARTITION_BYTES))

    def partitions(self) -> list[InputPartition]:
        store, root = opened(self.root)
        planned, held = [Files([])], 0
        for file in within(walked(store, root, self.suffixes), self.each, self.total):
            if held + file[3] > self.per_partition and planned[-1].files:
                planned.append(Files([]))
                held = 0
            planned[-1].files.append(file)
            held += file[3] + 1024  # opening a file costs, too
        return planned

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store, root = opened(self.root)
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["ordinal", "path", "size", "truncated", "content"])

        for ordinal, path, size, _ in partition.files:
            try:
                with store.open_input_stream(f"{root}/{path}") as stream:
                    raw = stream.read(self.each + 1)
            except OSError:  # gone or not readable since it was listed: it has no content
                raw = None
            cut = raw is not None and len(raw) > self.each
            text = None if raw is None else raw[: self.each].decode("utf-8", "replace") + (TRUNCATED.format(self.each) if cut else "")
            rows.append((ordinal, path, size, cut, text))
            held += len(raw or b"") + 200
            if held > BATCH_BYTES:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


class CheckoutSource(DataSource):
    """Options: suffixes (with dots, by comma), maxFileBytes, totalBytes (none: all), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "checkout"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return CheckoutReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CheckoutSource)


def write_tree(rows: DataFrame, root: str) -> int:
    """Writes rows (path, content binary) as files below ``root``, in the tasks; a repeated path is written again. The number of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = opened(root)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                store.create_dir(os.path.dirname(f"{place}/{path}"), recursive=True)
                with store.open_output_stream(f"{place}/{path}") as out:
                    out.write(content.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return rows.select("path", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
