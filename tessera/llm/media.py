"""Media columns: lossless 8-bit WAV, short-time Fourier transforms and spectral-peak pair fingerprints."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, types as T

from tessera.llm.common import map_rows, require

RATE, WINDOW, HOP, FAN_OUT, SPAN = 8000, 64, 32, 3, 32
#: Frames whose spectra are held at once.
CHUNK_FRAMES = 1 << 14


def wav_bytes(payload: bytes, rate: int = RATE) -> bytes:
    """One mono channel of unsigned 8-bit samples; each payload byte is a sample."""
    held = io.BytesIO()
    with wave.open(held, "wb") as out:
        out.setnchannels(1)
        out.setsampwidth(1)
        out.setframerate(rate)
        out.writeframes(payload)
    return held.getvalue()


def wav_samples(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as source:
        return source.readframes(source.getnframes())


def peak_pairs(payload: bytes) -> np.ndarray:
    """Time-coded pairs of spectral peaks: ``frame << 16 | bin1 << 11 | bin2 << 6 | gap``.

    A frame's peak is its strongest bin without the constant one (ties: the lowest bin), if it is louder than or as loud
    as the peaks of both neighbouring frames and not silent. Each peak is paired with the next FAN_OUT peaks within SPAN.
    """
    samples = np.frombuffer(payload, dtype=np.uint8).astype(np.float32) - 128
    count = 1 + (len(samples) - WINDOW) // HOP if len(samples) >= WINDOW else 0
    if not count:
        return np.zeros(0, dtype=np.int64)
    shape = np.hanning(WINDOW).astype(np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples, WINDOW)[::HOP]
    best, loud = np.empty(count, dtype=np.int64), np.empty(count)
    for at in range(0, count, CHUNK_FRAMES):
        power = np.abs(np.fft.rfft(frames[at : at + CHUNK_FRAMES] * shape, axis=1))[:, 1:-1].round(3)
        best[at : at + CHUNK_FRAMES] = top = power.argmax(axis=1)
        loud[at : at + CHUNK_FRAMES] = power[np.arange(len(top)), top]
    padded = np.concatenate(([0.0], loud, [0.0]))
    peaks = np.flatnonzero((loud > 0) & (loud >= padded[:-2]) & (loud >= padded[2:]))
    pairs = []
    for step in range(1, FAN_OUT + 1):
        first, second = peaks[:-step], peaks[step:]
        near = second - first < SPAN
        first, second = first[near], second[near]
        pairs.append(first << 16 | best[first] << 11 | best[second] << 6 | (second - first))
    return np.sort(np.concatenate(pairs))


def store_wav(df: DataFrame, text: str = "text", media: str = "media", align: int = 64) -> DataFrame:
    """Replaces ``text`` by a WAV file (``media`` binary) of its UTF-8 bytes, filled with bytes 0 up to a positive multiple
    of ``align``, and adds ``n_bytes`` (before filling).

    Null texts are read as empty, very long ones whole; equal texts give equal files, repeated rows one each. Output columns
    replace namesakes, other columns are passed on. An empty table gives an empty table.
    """
    require(df, text)

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (value,) in rows:
            raw = (value or "").encode()
            yield wav_bytes(raw + bytes(-len(raw) % align if raw else align)), len(raw)

    return map_rows(df, [text], [T.StructField(media, T.BinaryType()), T.StructField("n_bytes", T.LongType())], kernel, drop=(text,))


def read_wav(df: DataFrame, media: str = "media") -> DataFrame:
    """Adds the samples read back by the wave module (``payload`` binary) and their peak pairs (``peaks`` array of long,
    ordered by time).

    A null medium gives null outputs; one too quiet for peaks gives an empty array. Long media are transformed in chunks of
    frames. Repeated rows are read each; output columns replace namesakes. An empty table gives an empty table.
    """
    require(df, media)

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (stored,) in rows:
            if stored is None:
                yield None, None
            else:
                payload = wav_samples(stored)
                yield payload, peak_pairs(payload)

    return map_rows(df, [media], [T.StructField("payload", T.BinaryType()), T.StructField("peaks", T.ArrayType(T.LongType()))], kernel)
