"""Packing token sequences into fixed windows with Karmarkar-Karp multiway differencing.

Documents are cut into pieces and dealt, as they come, into blocks of a bounded number of tokens; each block is packed
inside one task, so no shuffle moves anything. In a block every piece starts as a partial partition that fills one of k
windows; the two partial partitions with the largest imbalance are merged, the fullest window of one onto the emptiest
of the other, until one partition of k near-equal windows is left. If its fullest window exceeds the capacity, k rises by
one and the block is packed again.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from tessera.llm.common import OUT_ROWS, require
from tessera.llm.wordbpe import word_encoder

#: Windows of a block, tokens that a block leaves free in all, tokens of a piece at most, and of a bundle at least.
BLOCK_WINDOWS, BLOCK_SLACK, PIECE_TOKENS, BUNDLE_TOKENS = 64, 2048, 512, 16


def differencing(sizes: list[int], k: int) -> np.ndarray:
    """The window (0 to k-1) of each size by Karmarkar-Karp k-way differencing. Ties fall to the earlier partition."""
    n = len(sizes)
    if n == 0 or k == 1:
        return np.zeros(n, dtype=np.int64)
    # A partition keeps its windows in descending order, less the smallest; nodes name what a window holds: leaf i, a merge, or nothing (-1).
    heap, parts = [], {}
    for i, size in enumerate(sizes):
        sums, nodes = np.zeros(k, dtype=np.int64), np.full(k, -1, dtype=np.int64)
        sums[0], nodes[0] = size, i
        parts[i] = (sums, nodes)
        heap.append((-size, i))
    heapq.heapify(heap)
    merges, fresh = [], n
    for step in range(n - 1):
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        (sums_a, nodes_a), (sums_b, nodes_b) = parts.pop(a), parts.pop(b)
        sums, other = sums_a + sums_b[::-1], nodes_b[::-1]
        both = (nodes_a >= 0) & (other >= 0)
        nodes = np.where(nodes_a >= 0, nodes_a, other)
        joined = np.flatnonzero(both)
        if len(joined):
            names = np.arange(fresh, fresh + len(joined))
            merges.append((names, nodes_a[joined], other[joined]))
            nodes[joined] = names
            fresh += len(joined)
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        parts[n + step] = (sums - sums[-1], nodes[order])
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), n + step))
    (_, nodes), window = next(iter(parts.values())), np.full(fresh, -1, dtype=np.int64)
    held = np.flatnonzero(nodes >= 0)
    window[nodes[held]] = held
    for names, left, right in reversed(merges):
        window[left] = window[right] = window[names]
    return window[:n]


def bundles(sizes: list[int]) -> np.ndarray:
    """The bundle (from 0) of each size: pieces under BUNDLE_TOKENS are put together, in order, until they have as many; any
    other is a bundle of its own. So a block of tiny pieces has few partial partitions to merge."""
    at, open_, held, out = -1, -1, 0, np.empty(len(sizes), dtype=np.int64)
    for i, size in enumerate(sizes):
        if size >= BUNDLE_TOKENS or open_ < 0:
            at += 1
            out[i] = at
            if size < BUNDLE_TOKENS:
                open_, held = at, size
            continue
        out[i], held = open_, held + size
        if held >= BUNDLE_TOKENS:
            open_ = -1
    return out


def pack_block(sizes: list[int], capacity: int) -> tuple[np.ndarray, int]:
    """Windows of the sizes, and their count: the least that the total allows, raised while one exceeds the capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        window = differencing(sizes, k)
        if k >= len(sizes) or np.bincount(window, weights=sizes, minlength=k).max() <= capacity:
            return (window, k) if k < len(sizes) else (np.arange(len(sizes)), len(sizes))
        k += 1


def pieces(packed: bytes, room: int, capacity: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, crc32) of a document's pieces; ``room`` is what the open block still takes."""
    total, start = len(packed) // 4, 0
    view = memoryview(packed)
    while start < total:
        length = min(total - start, PIECE_TOKENS, capacity, room)
        yield start, length, zlib.crc32(view[4 * start : 4 * (start + length)])
        start += length
        room = room - length or BLOCK_WINDOWS * capacity - BLOCK_SLACK


def pack(df: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: ``key``, start, length, ids_crc32, doc_tokens, sequence_id, offset (all long but the key).

    A document's tokens are its ids by the tokenizers library without added special tokens, then ``end_id``; null and
    empty texts have that one token, and are put in bundles of BUNDLE_TOKENS before they are merged. A long text fills several pieces and may span blocks. Repeated rows are packed each.
    ``sequence_id`` is unique in the result, not gapless; offsets in a sequence are gapless from 0. Columns of ``df`` other
    than the key and the text are not read. An empty table gives an empty result.
    """
    require(df, key, text)
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField("k", kind)] + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
    budget = BLOCK_WINDOWS * capacity - BLOCK_SLACK
    if capacity < 2 * PIECE_TOKENS or budget <= 0:
        raise ValueError(f"capacity {capacity} is too small for pieces of {PIECE_TOKENS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_encoder(vocabulary), np.asarray([end_id], dtype="<u4").tobytes()
        context = TaskContext.get()
        sequences = (context.partitionId() if context else 0) << 32
        rows: list[tuple] = []
        used = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal rows, used, sequences
            sizes = [r[2] for r in rows]
            bundle = bundles(sizes)
            window, k = pack_block(np.bincount(bundle, weights=sizes).astype(int).tolist(), capacity)
            window = window[bundle]
            fill, made = np.zeros(k, dtype=np.int64), []
            for row, w in zip(rows, window.tolist(), strict=True):
                made.append((*row, sequences + w, int(fill[w])))
                fill[w] += row[2]
            sequences += k
            rows, used = [], 0
            for at in range(0, len(made), OUT_ROWS):
                columns = list(zip(*made[at : at + OUT_ROWS], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], type=key_kind)] + [pa.array(c, type=pa.int64()) for c in columns[1:]], names=schema.names)

        for batch in batches:
            key_kind = batch.column(0).type
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packed = encoder.packed(value or "") + end
                for start, length, crc in pieces(packed, budget - used, capacity):
                    rows.append((name, start, length, crc, len(packed) // 4))
                    used += length
                    if used == budget:
                        yield from flush()
        if rows:
            yield from flush()

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, schema).withColumnRenamed("k", key)
