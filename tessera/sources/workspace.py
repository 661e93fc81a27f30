"""Checkouts and documents as tables of files, and the lookups over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions.text import basename, is_binary
from tessera.operators import chunking, code, symbols
from tessera.sources import checkout
from tessera.sources.checkout import is_sensitive

DOCUMENTS = (".md", ".markdown")


def files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = checkout.SUFFIXES, budget: int | None = None, max_file_bytes: int = checkout.MAX_FILE_BYTES) -> DataFrame:
    """(ordinal, path below the root, content) of the text files of a checkout, in walking order; see :mod:`tessera.sources.checkout`.

    Files over ``max_file_bytes`` are cut with a note. Of a ``budget`` in bytes, files that no longer fit are refused. Binary files
    use their share of it, but are left out.
    """
    checkout.register(spark)
    reader = spark.read.format("checkout").option("suffixes", ",".join(suffixes)).option("maxFileBytes", max_file_bytes)
    raw = (reader if budget is None else reader.option("totalBytes", budget)).load(root)
    return raw.filter(F.col("content").isNotNull() & ~is_binary(F.col("content"))).select("ordinal", "path", "content")


def documents(spark: SparkSession, root: str, limit: int = 500) -> DataFrame:
    """Markdown documents in walking order, up to the cap of the index."""
    return files(spark, root, DOCUMENTS, checkout.INDEX_BYTES).orderBy("ordinal").limit(limit)


def chunks(source_files: DataFrame, max_files: int = 2000, max_chunks: int = 20000) -> DataFrame:
    """Chunks of source files in walking order; both caps are those of the index, taken as a distributed top-k."""
    kept = source_files.orderBy("ordinal").limit(max_files)
    cut = chunking.sources(kept).join(kept.select("path", "ordinal"), "path")
    return cut.orderBy("ordinal", F.col("name") != "", "start_line", F.desc("end_line"), "name").limit(max_chunks).drop("ordinal")


def document_chunks(document_files: DataFrame, max_chunks: int = 20000) -> DataFrame:
    return chunking.markdown(document_files).orderBy("path", "start_line").limit(max_chunks)


def entries(file_rows: DataFrame, directory: str) -> DataFrame:
    """Names right below a directory, without sensitive ones."""
    prefix = directory.rstrip("/") + "/" if directory else ""
    below = file_rows.filter(F.col("path").startswith(prefix)).select(F.substring_index(F.expr(f"substr(path, {len(prefix) + 1})"), "/", 1).alias("name"))
    return below.distinct().filter(~is_sensitive(F.col("name"))).orderBy("name")


def find_file(file_rows: DataFrame, name: str) -> DataFrame:
    return file_rows.filter(basename(F.col("path")) == name).select("path").orderBy("path")


def definitions(chunk_rows: DataFrame, symbol: str) -> DataFrame:
    """Chunks that define a symbol, by full or last name."""
    return chunk_rows.filter((F.col("name") == symbol) | F.col("name").endswith(f".{symbol}"))


def symbol_index(source_files: DataFrame) -> DataFrame:
    """(kind, name, params) in the form that ``documentation.defects`` reads: every symbol, option and environment name of the files."""
    return symbols.index(symbols.names(source_files))


def imports(source_files: DataFrame) -> DataFrame:
    """(path, name): Python imports by syntax tree, C includes by pattern."""
    python = code.facts(source_files, "path").filter("kind = 'import'").select("path", "name")
    c = source_files.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^\s*#include\s*[<\"]([^>\"]+)[>\"]"), 1)).alias("name"))
    return python.unionByName(c)
