"""Byte-level BPE with the tiktoken library and a local rank file.

Long texts are split at safe boundaries before the library sees them. No match of the pattern holds a blank behind anything
else, or letters, numbers and other characters together, but for one blank in front and an apostrophe with its letters. So a
cut lies before a blank that follows another character, or between two of these classes, never behind a blank or an
apostrophe, whatever the script. A run of one class is one match and stays whole; of a long run of blanks, on which the
library's pattern overflows its stack, all but the last (which may belong to what follows) are one match by the pattern's
rule, and are merged as such without it.

Ids are stored packed (little-endian unsigned 32-bit), the form training files use; decoding gives raw bytes.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import regex
import tiktoken
from pyspark.sql import DataFrame, types as T

from tessera.llm.common import map_rows, require

#: Characters after which a text is cut, and blanks that are merged without the pattern.
SEGMENT_CHARS, BLANK_RUN = 1 << 16, 1 << 12
#: Characters that Unicode has not assigned yet are of no class here, as the library may know them.
_CUT = regex.compile(
    r"(?<=\P{White_Space})(?=\p{White_Space})|(?<=\p{L})(?=[^\p{L}\p{White_Space}\p{Cn}])|(?<=\p{N})(?=[^\p{N}\p{White_Space}\p{Cn}])|(?<=[^'\p{L}\p{N}\p{White_Space}\p{Cn}])(?=[\p{L}\p{N}])"
)
_BLANKS = regex.compile(rf"\p{{White_Space}}{{{BLANK_RUN},}}+")


@functools.lru_cache(maxsize=2)
def _encoding(rank_path: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def segments(text: str, size: int = SEGMENT_CHARS) -> Iterator[tuple[str, bool]]:
    """(part, is it one match) of a text: cut at the first safe boundary after each ``size`` characters, and around long runs of
    blanks. The concatenation of the parts is the text."""
    if len(text) <= size:
        yield text, False
        return
    start = 0
    for run in _BLANKS.finditer(text):
        yield from ((part, False) for part in _cut(text[start : run.start()], size))
        start = run.end() if run.end() == len(text) else run.end() - 1
        yield text[run.start() : start], True
    yield from ((part, False) for part in _cut(text[start:], size))


def _cut(text: str, size: int) -> Iterator[str]:
    start = 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    if start < len(text):
        yield text[start:] if start else text


def encode(df: DataFrame, rank_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Replaces column ``text`` by packed token ids (``ids`` binary) and their number (``n_tokens`` long).

    A null text is read as empty and gives no ids. A very long text is encoded whole, in parts that change no id. Special
    tokens are never produced. Other columns are passed on; one named like an output is replaced. Repeated rows are encoded
    each; an empty table gives an empty table. The rank file is read on each worker, so its path must exist on every machine.
    """
    require(df, text)

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple]:
        encoding = _encoding(rank_path, pattern)
        for (value,) in rows:
            found: list[int] = []
            for part, whole in segments(value or ""):
                found += encoding._encode_single_piece(part) if whole else encoding.encode_ordinary(part)
            yield np.asarray(found, dtype="<u4").tobytes(), len(found)

    return map_rows(df, [text], [T.StructField(ids, T.BinaryType()), T.StructField("n_tokens", T.LongType())], kernel, drop=(text,))


def decode(df: DataFrame, rank_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the raw bytes (``out`` binary) that packed ``ids`` stand for; null ids decode to no bytes."""
    require(df, ids)

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple]:
        encoding = _encoding(rank_path, pattern)
        for (packed,) in rows:
            yield (encoding.decode_bytes(np.frombuffer(packed or b"", dtype="<u4").tolist()),)

    return map_rows(df, [ids], [T.StructField(out, T.BinaryType())], kernel)
