"""Word-level BPE of the tokenizers library, once per distinct pre-token.

A text is cut into the library's own pre-tokens. One of Latin-1 characters is cut here, by the library's pattern: for these
characters its normaliser is lower-casing alone. Of any other text, the chunks between spaces and newlines, which the library drops
and never merges across, are normalised and cut by the library's parts themselves, each distinct chunk once while a bounded cache
holds it. A chunk that may hold a special string stays whole, and is encoded by the whole library.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a Spark task has one core
from tokenizers import Tokenizer  # noqa: E402

#: Letters, numbers and white space among the Latin-1 characters, after lower-casing.
_LETTERS, _NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
_BLANKS = r"\t-\r \x85\xa0"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_BLANKS}{_LETTERS}{_NUMBERS}]+")
#: Distinct pre-tokens of a generation that a worker remembers, and the longest of them.
CACHE_ENTRIES, CACHE_CHARS = 250_000, 64


def _byte_letters() -> dict[int, int]:
    """The printable character that byte-level BPE writes for each byte: itself, or the next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 0x100 + i for i, b in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()
_LETTER_BYTES = {v: k for k, v in _BYTE_LETTERS.items()}


def _latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordEncoder:
    """Encodes pre-tokens through a bounded cache of two generations: the older is dropped when the younger is full.

    Pre-tokens need neither the library's normaliser nor its cutting, so they go to a tokenizer of the same vocabulary without
    these, as the byte-level letters that it would make of them.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as text:
            bare = json.load(text)
        bare |= {"normalizer": None, "pre_tokenizer": None, "post_processor": None, "added_tokens": []}
        self.bare = Tokenizer.from_str(json.dumps(bare))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cut: dict[str, list[str]] = {}

    def pre_tokens(self, text: str) -> list[str]:
        """The library's pre-tokens of a text, normalised; a chunk that may hold a special string is one."""
        if "<|" not in text and _latin(text):
            return _PIECES.findall(text.lower())
        found: list[str] = []
        for chunk in text.replace("\n", " ").split(" "):
            if chunk:
                pieces = self.cut.get(chunk)
                found += self._cut(chunk) if pieces is None else pieces
        return found

    def _cut(self, chunk: str) -> list[str]:
        if "<|" in chunk:
            return [chunk]
        if _latin(chunk):
            pieces = _PIECES.findall(chunk.lower())
        else:
            written = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(chunk))
            pieces = [letters.translate(_LETTER_BYTES).encode("latin-1").decode() for letters, _ in written]
        if len(chunk) <= CACHE_CHARS:
            if len(self.cut) >= CACHE_ENTRIES // 2:
                self.cut.clear()
            self.cut[chunk] = pieces
        return pieces

    def encode_distinct(self, pieces: list[str]) -> list[list[int]]:
        """The ids of each pre-token."""
        whole = [p for p in pieces if "<|" in p]
        letters = [p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(_BYTE_LETTERS) for p in pieces if "<|" not in p]
        of_whole = iter(self.tokenizer.encode_batch_fast(whole, add_special_tokens=False) if whole else ())
        of_letters = iter(self.bare.encode_batch_fast(letters, add_special_tokens=False))
        return [next(of_whole if "<|" in p else of_letters).ids for p in pieces]

    def count_distinct(self, pieces: list[str]) -> list[int]:
        """The number of tokens of each pre-token."""
        return [len(ids) for ids in self.encode_distinct(pieces)]

    def packed(self, text: str) -> bytes:
        """The text's ids, little-endian unsigned 32-bit."""
        pieces, known, older = self.pre_tokens(text), self.known, self.older
        missing = [p for p in set(pieces) if p not in known]
        if not missing:
            return b"".join(map(known.__getitem__, pieces))
        new = [p for p in missing if p not in older]
        known.update((p, older[p]) for p in missing if p in older)
        known.update(zip(new, [array("I", ids).tobytes() for ids in self.encode_distinct(new)], strict=True))
        made = b"".join(map(known.__getitem__, pieces))
        for piece in new:
            if len(piece) > CACHE_CHARS:
                del known[piece]
        if len(known) > CACHE_ENTRIES:
            self.known, self.older = {}, known
        return made


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
