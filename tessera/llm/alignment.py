"""Cross-tokenizer alignment: which tokens of a byte-level BPE (A) and of a sentencepiece model (B) cover the same bytes.

Every byte of space+text has a label: none, the end of an A token, of a B token, or of both. A pattern scans the label string
and takes the spans up to each both-label; the labels inside a span say how many A and B tokens form its group, and each
label that is not none ends a range that one A token and one B token share, which is a link.

Texts are encoded once and their packed ids are written; what follows works on these.

Links are counted in two passes. The first sums, per task, how many documents hold each pair of ids. Pairs
that have at least one in HEAD_PAIRS of all these counts are at most HEAD_PAIRS many, whatever the corpus, and are broadcast
as two arrays; the second pass looks those up in the task, and all others meet their counts in a shuffle join.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tessera.llm.bpe import SEGMENT_CHARS, segments
from tessera.llm.common import map_rows, require
from tessera.llm.wordbpe import _BYTE_LETTERS
from tessera.session import materialised

#: Pairs that are broadcast at most (16 bytes each); pairs that a task sums before it passes them on.
HEAD_PAIRS, PARTIAL_PAIRS = 1 << 19, 1 << 20
#: Bytes of an output batch, from which on it is passed on.
BATCH_BYTES = 4 << 20
A_END, B_END, BOTH = 1, 2, 3
_GROUP = re.compile(rb"[^\x03]*\x03")


def labels(a_ends: np.ndarray, b_ends: np.ndarray) -> bytes:
    """One label per byte, from the bytes (counted from 1) at which tokens end."""
    found = np.zeros(int(a_ends[-1]), dtype=np.uint8)
    found[a_ends - 1] = A_END
    found[b_ends - 1] |= B_END
    return found.tobytes()


def group_sizes(label_string: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, A tokens, B tokens) of every span up to a both-label."""
    sizes = np.fromiter(map(len, _GROUP.findall(label_string)), dtype=np.int64)
    found, starts = np.frombuffer(label_string, dtype=np.uint8), np.cumsum(sizes) - sizes
    return sizes, *(np.add.reduceat(found >> bit & 1, starts, dtype=np.int64) for bit in (0, 1))


def links(label_string: bytes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A id << 32 | B id for each pair of tokens that share bytes: one for each label that is not none."""
    ends = np.frombuffer(label_string.translate(None, b"\0"), dtype=np.uint8)
    a_end, b_end = ends & A_END, ends >> 1
    return a.astype(np.int64)[np.cumsum(a_end, dtype=np.int64) - a_end] << 32 | b.astype(np.int64)[np.cumsum(b_end, dtype=np.int64) - b_end]


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        with open(a_path, encoding="utf-8") as text:
            tokenizer = json.load(text)
        if tokenizer["normalizer"] or tokenizer["model"]["type"] != "BPE" or tokenizer["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError(f"{a_path} is no byte-level BPE")
        special, letters = {t["content"] for t in tokenizer["added_tokens"]}, {chr(v): k for k, v in _BYTE_LETTERS.items()}
        ranks = {bytes(map(letters.__getitem__, t)): i for t, i in tokenizer["model"]["vocab"].items() if t not in special}
        merged = [ranks[bytes(map(letters.__getitem__, "".join(m if isinstance(m, list) else m.split(" "))))] for m in tokenizer["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"the merges of {a_path} are not in the order of their ids")
        # The byte-level pre-tokenizer's own pattern; the two libraries agree on its classes for every code point.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.a = tiktoken.Encoding("aligned", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        plain = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.b_inside = {p[i : i + 2] for p in plain for i in range(len(p) - 1)}
        if any("\n" in p for p in plain):
            raise ValueError(f"{b_path} has pieces with line feeds")
        self.a_size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        self.a_size[list(ranks.values())] = [len(t) for t in ranks]
        self.b_size = np.array([len(t) for t in self.b_bytes])
        #: What is packed: two bytes per id, where both vocabularies allow.
        self.packed = "<u2" if max(len(self.a_size), len(self.b_size)) <= 1 << 16 else "<u4"
        # Ids in decimals with what follows them in a list of groups, one row of bytes each, filled up with zeros.
        written = [f"{i}{mark}" for size, mark in ((self.a_size, ","), (self.a_size, "|"), (self.b_size, ","), (self.b_size, ";")) for i in range(len(size))]
        self.written = np.array(written, dtype="S").view(np.uint8).reshape(len(written), -1)

    def _a_ids(self, chunk: str) -> list[int]:
        if len(chunk) <= SEGMENT_CHARS:
            return self.a.encode_ordinary(chunk)
        return [i for part, whole in segments(chunk) for i in (self.a._encode_single_piece(part) if whole else self.a.encode_ordinary(part))]

    def _b_ids(self, text: str) -> list[int]:
        """The ids of space+text. A long one is cut where no piece has the two characters side by side, so no merge crosses the cut;
        each further part follows a line feed, which is a piece of its own, instead of the space."""
        found, start = [], 0
        while True:
            cut = start + SEGMENT_CHARS
            while cut < len(text) and text[cut - 1 : cut + 1].replace(" ", "▁") in self.b_inside:
                cut += 1
            part = self.b.encode(("\n" if start else "") + text[start:cut])
            found += part[2:] if start else part
            if cut >= len(text):
                return found
            start = cut

    def tokens(self, text: str | None) -> tuple[bytes, bytes]:
        """Packed ids of A and of B for a text; none, if it is empty or B does not give its bytes back."""
        if not text:
            return b"", b""
        b = self._b_ids(text)
        if b"".join(map(self.b_bytes.__getitem__, b)) != f" {text}".encode():
            return b"", b""
        return tuple(np.array(ids, dtype=self.packed).tobytes() for ids in (self._a_ids(" " + text), b))

    def opened(self, a: bytes, b: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
        """(A ids, B ids, label string) of packed ids."""
        a_ids, b_ids = (np.frombuffer(x, dtype=self.packed) for x in (a, b))
        return a_ids, b_ids, labels(np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])) if len(a) else b""

    def groups(self, a: np.ndarray, b: np.ndarray, label_string: bytes) -> tuple[bytes, np.ndarray]:
        """(``a1,a2|b1;a3|b2``, bytes of each group)."""
        if not label_string:
            return b"", np.zeros(0, dtype=np.int64)
        sizes, n_a, n_b = group_sizes(label_string)
        last_a, last_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        last_a[np.cumsum(n_a) - 1] = last_b[np.cumsum(n_b) - 1] = 1
        order = np.zeros(len(a) + len(b), dtype=np.int64)
        order[np.arange(len(a)) + np.repeat(np.cumsum(n_b) - n_b, n_a)] = a + last_a * len(self.a_size)
        order[np.arange(len(b)) + np.repeat(np.cumsum(n_a), n_b)] = b + last_b * len(self.b_size) + 2 * len(self.a_size)
        return self.written[order].tobytes().translate(None, b"\0")[:-1], sizes


@functools.lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def align(df: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """Adds, to every row, n_a and n_b (long), ``groups`` (string: A ids, ``|``, B ids; groups joined by ``;``) and ``group_ends`` (array
    of long: the byte of space+text, from 1, at which each group ends). No shuffle.

    Null and empty texts, and those that B does not give back byte for byte, have no tokens and no groups. Texts are read whole.
    Other columns are passed on; one named like an output is replaced. Repeated rows are aligned each; an empty table
    gives an empty table. Both files are read on each worker, so their paths must exist on every machine.
    """
    require(df, text)

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple]:
        tool = aligner(a_path, b_path)
        for (value,) in rows:
            a, b, label_string = tool.opened(*tool.tokens(value))
            groups, sizes = tool.groups(a, b, label_string)
            yield len(a), len(b), groups.decode(), np.cumsum(sizes)

    outputs = [T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType()), T.StructField("groups", T.StringType()), T.StructField("group_ends", T.ArrayType(T.LongType()))]
    return map_rows(df, [text], outputs, kernel)


def encoded(df: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """Replaces column ``text`` by packed ids ``a`` and ``b`` (binary, two or four bytes per id); none for a text without tokens."""
    require(df, text)

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple]:
        tool = aligner(a_path, b_path)
        for (value,) in rows:
            yield tool.tokens(value)

    return map_rows(df, [text], [T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())], kernel, drop=(text,))


def pair_counts(tokens: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(pair long: A id << 32 | B id, held long): in how many rows (a, b) of :func:`encoded` the two are linked at least once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, waiting, size = aligner(a_path, b_path), [], 0
        pairs = held = np.zeros(0, dtype=np.int64)

        def merged() -> tuple[np.ndarray, np.ndarray]:
            new, times = np.unique(np.concatenate(waiting or [np.zeros(0, dtype=np.int64)]), return_counts=True)
            both, back = np.unique(np.concatenate((pairs, new)), return_inverse=True)
            return both, np.bincount(back, weights=np.concatenate((held, times)), minlength=len(both)).astype(np.int64)

        def passed() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(pairs), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[at : at + (1 << 16)]), pa.array(held[at : at + (1 << 16)])], names=["pair", "held"])

        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                a_ids, b_ids, label_string = tool.opened(a.as_py(), b.as_py())
                if label_string:
                    waiting.append(np.unique(links(label_string, a_ids, b_ids)))
                    size += len(waiting[-1])
                if size > PARTIAL_PAIRS:
                    pairs, held = merged()
                    waiting, size = [], 0
                    if len(pairs) > PARTIAL_PAIRS:
                        yield from passed()
                        pairs = held = np.zeros(0, dtype=np.int64)
        pairs, held = merged()
        yield from passed()

    partial = tokens.select("a", "b").mapInArrow(run, "pair long, held long")
    return partial.groupBy("pair").agg(F.sum("held").alias("held"))


def link_statistics(df: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", of_groups: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per row of ``df``: ``key``, n_a, n_b, n_groups, n_links, n_best and count_sum (long), and ``groups``.

    A pair's count is the number of rows that hold it linked; ``n_best`` are the links whose count is the highest of their A id, and
    ``count_sum`` sums the counts over the links. ``of_groups`` is applied to the column ``groups`` (see :func:`align`) in the task that
    made it, before any shuffle; without it ``groups`` itself is returned.

    Texts without tokens (see :func:`align`) have zeros. Rows that repeat, or share a key or have none, are counted each. Other
    columns are not read, whatever their names. An empty table gives an empty result.
    """
    require(df, key, text)
    tokens = materialised(encoded(df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), a_path, b_path))
    counts = materialised(pair_counts(tokens, a_path, b_path))
    a_id = F.shiftright("pair", 32)
    # One row per A id: as many as A's vocabulary has.
    top = {row.a: row.top for row in counts.groupBy(a_id.alias("a")).agg(F.max("held").alias("top")).collect()}
    total = counts.agg(F.sum("held")).first()[0] or 0
    in_head = F.col("held") * HEAD_PAIRS >= total
    head = counts.filter(in_head).toArrow().sort_by("pair")
    tops = np.zeros(max(top, default=0) + 1, dtype=np.int64)
    tops[list(top)] = list(top.values())
    shared = df.sparkSession.sparkContext.broadcast((head.column("pair").to_numpy(), head.column("held").to_numpy(), tops))
    kind = df.schema[[c.lower() for c in df.columns].index(key.lower())].dataType
    names = ["row", "pair", "times", "best", "total", "n_a", "n_b", "n_groups", "n_links"]
    schema = T.StructType([T.StructField("key", kind), *[T.StructField(n, T.LongType()) for n in names], T.StructField("groups", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, (pairs, held, tops), context = aligner(a_path, b_path), shared.value, TaskContext.get()
        row = (context.partitionId() if context else 0) << 33
        for batch in batches:
            at = size = 0
            tail: list[tuple[np.ndarray, np.ndarray]] = []
            own: list[list] = [[] for _ in range(7)]

            def made(stop: int) -> pa.RecordBatch:
                """The own rows of the documents from ``at`` on, and one row for each pair of theirs that is not in the head."""
                n, sizes = stop - at, [len(p) for p, _ in tail]
                spot = pa.array(np.concatenate((np.arange(n), np.repeat(np.arange(n), sizes))))
                rows = np.arange(row - n, row)
                none = pa.nulls(sum(sizes), pa.int64())
                columns = [batch.column(0).slice(at, n).take(spot), np.concatenate((rows, np.repeat(rows, sizes))), np.concatenate((-rows - 1, *[p for p, _ in tail])), np.concatenate((np.zeros(n, np.int64), *[t for _, t in tail]))]
                columns += [pa.concat_arrays([pa.array(x, pa.int64()), none]) for x in own[:6]] + [pa.concat_arrays([pa.array(own[6], pa.string()), pa.nulls(sum(sizes), pa.string())])]
                return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=schema.names)

            for i in range(batch.num_rows):
                a, b, label_string = tool.opened(batch.column(1)[i].as_py(), batch.column(2)[i].as_py())
                groups, sizes_of = tool.groups(a, b, label_string)
                linked = links(label_string, a, b) if label_string else np.zeros(0, dtype=np.int64)
                found, times = np.unique(linked, return_counts=True)
                spot = np.searchsorted(pairs, found)
                spot[spot == len(pairs)] = 0
                hit = pairs[spot] == found if len(pairs) else np.zeros(len(found), dtype=bool)
                count, often = held[spot[hit]], times[hit]
                best = count == tops[found[hit] >> 32]
                for column, x in zip(own, (int(often[best].sum()), int((often * count).sum()), len(a), len(b), len(sizes_of), len(linked), groups.decode()), strict=True):
                    column.append(x)
                tail.append((found[~hit], times[~hit].astype(np.int64)))
                row, size = row + 1, size + len(groups) + 80 * int((~hit).sum())
                if size > BATCH_BYTES or i + 1 == batch.num_rows:
                    yield made(i + 1)
                    at, size, tail, own = i + 1, 0, [], [[] for _ in range(7)]

    rows = tokens.select("key", "a", "b").mapInArrow(run, schema)
    if of_groups is not None:
        rows = rows.withColumn("groups", of_groups(F.col("groups")))
    best_of = df.sparkSession.createDataFrame(list(top.items()), "a long, top long")
    rare = counts.filter(~in_head).join(F.broadcast(best_of), a_id == F.col("a")).select("pair", "held", (F.col("held") == F.col("top")).alias("is_best"))
    joined = rows.join(rare, "pair", "left")
    many = F.coalesce(F.col("times") * F.col("held"), F.lit(0))
    sums = [F.sum(F.coalesce("best", F.lit(0)) + F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.coalesce("total", F.lit(0)) + many).alias("count_sum")]
    out = joined.groupBy("row", "key").agg(*[F.max(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")], *sums, F.max("groups").alias("groups"))
    return out.select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
