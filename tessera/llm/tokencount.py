"""Token counts without token ids: pieces per distinct pre-token, joined to each document's pre-token frequencies.

The distinct pre-tokens of the corpus are counted with partial sums in each task and encoded once each. Those that hold at
least one in HEAD_SHARE of all occurrences are at most HEAD_SHARE many, whatever the corpus; their piece counts are
broadcast, long ones under their digest, so what every text repeats never meets in one task. All others go through a shuffle join.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from tessera.llm.common import OUT_ROWS, require
from tessera.llm.wordbpe import word_encoder
from tessera.session import few_files, materialised

#: At most so many pre-tokens are broadcast; those of more than HEAD_CHARS characters as an MD5 digest.
HEAD_SHARE, HEAD_CHARS = 1 << 19, 48
#: Distinct pre-tokens that a task sums before it passes them on, and characters of long ones, which are counted at every sight.
PARTIAL_ENTRIES, PARTIAL_CHARS, LONG_CHARS = 200_000, 16 << 20, 64


def vocabulary_counts(texts: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """(piece string, n long, tokens long): every distinct pre-token of the corpus, its occurrences and its token count."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        encoder, long = word_encoder(vocabulary), 0

        def flush() -> Iterator[pa.RecordBatch]:
            names = list(counts)
            for at in range(0, len(names), 20 * OUT_ROWS):
                part = names[at : at + 20 * OUT_ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([counts[p] for p in part], pa.int64())], names=["piece", "n"])
            counts.clear()

        for batch in batches:
            for value in batch.column(0).to_pylist():
                pieces = encoder.pre_tokens(value or "")
                counts.update(pieces)
                long += sum(n for n in map(len, pieces) if n > LONG_CHARS)
                if len(counts) > PARTIAL_ENTRIES or long > PARTIAL_CHARS:
                    yield from flush()
                    long = 0
        yield from flush()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(vocabulary)
        for batch in batches:
            pieces = batch.column(0).to_pylist()
            tokens = encoder.count_distinct(pieces)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.int64())], names=["piece", "n", "tokens"])

    partial = texts.select(F.col(text).alias("text")).mapInArrow(tally, "piece string, n long")
    return partial.groupBy("piece").agg(F.sum("n").alias("n")).mapInArrow(encode, "piece string, n long, tokens long")


def count_tokens(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: ``key``, n_bytes (UTF-8) and n_tokens, both long.

    Null and empty texts have no bytes and no tokens; very long ones are counted whole. Rows that repeat, or share a key, are
    counted each. Columns other than the key and the text are not read. An empty table gives an empty result.
    """
    require(df, key, text)
    texts = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    counts = materialised(few_files(vocabulary_counts(texts, vocabulary)))
    total = counts.agg(F.sum("n")).first()[0] or 0
    in_head = F.col("n") * HEAD_SHARE >= total
    short = F.length("piece") <= HEAD_CHARS
    head = {row.name or bytes(row.digest): row.tokens for row in counts.filter(in_head).select(F.when(short, F.col("piece")).alias("name"), F.when(~short, F.unhex(F.md5(F.col("piece").cast("binary")))).alias("digest"), "tokens").toLocalIterator()}
    shared = df.sparkSession.sparkContext.broadcast(head)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, encoder, context = shared.value, word_encoder(vocabulary), TaskContext.get()
        row = (context.partitionId() if context else 0) << 33
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                keys, rows, pieces, sizes, amounts = [], [], [], [], []
                for name, value in zip(batch.column(0).slice(at, 256).to_pylist(), batch.column(1).slice(at, 256).to_pylist(), strict=True):
                    value, tokens = value or "", 0
                    for piece, n in Counter(encoder.pre_tokens(value)).items():
                        each = known.get(piece if len(piece) <= HEAD_CHARS else hashlib.md5(piece.encode()).digest())
                        if each is None:
                            keys.append(name), rows.append(row), pieces.append(piece), sizes.append(0), amounts.append(n)
                        else:
                            tokens += n * each
                    # The document's own row: a key that no pre-token has, so that it meets nothing and spreads evenly.
                    keys.append(name), rows.append(row), pieces.append(f" {row}"), sizes.append(len(value.encode())), amounts.append(tokens)
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(rows, pa.int64()), pa.array(pieces, pa.string()), pa.array(sizes, pa.int64()), pa.array(amounts, pa.int64())], names=["key", "row", "piece", "size", "amount"])

    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("row", T.LongType()), T.StructField("piece", T.StringType()), T.StructField("size", T.LongType()), T.StructField("amount", T.LongType())])
    tail = counts.filter(~in_head).select("piece", "tokens")
    joined = texts.mapInArrow(frequencies, schema).join(tail, "piece", "left")
    sums = joined.groupBy("row", "key").agg(F.sum("size").alias("n_bytes"), F.sum(F.col("amount") * F.coalesce("tokens", F.lit(1))).alias("n_tokens"))
    return few_files(sums.select(F.col("key").alias(key), "n_bytes", "n_tokens"))
