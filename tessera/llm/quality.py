"""Quality classifier: document statistics, random Fourier features, ridge scores and isotonic calibration.

Every text becomes a short vector of statistics. Random Fourier features approximate a Gaussian kernel over them; each
partition sums its part of the normal equations, the sums are added in two steps, and one ridge system of fixed size is
solved. Scores are calibrated by isotonic regression on labelled rows that the fit did not see, binned into a fixed number
of bins. What reaches the driver does not grow with the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tessera.llm.common import OUT_ROWS, map_rows, numbered, require, without
from tessera.session import materialised

FEATURES, RIDGE, WIDTH, BINS, SEED = 192, 1e-3, 3.0, 512, 7
BROADCAST_KEYS = 500_000
_PUNCTUATED = re.compile(r"[.!?][\"')\]]*(?:\s|$)")
_SYMBOL_RUN = re.compile(r"[^\w\s]{2,}")
_LONE = re.compile(r"(?<!\S)[^\w\s]+(?!\S)")
_DIGITS = re.compile(r"\d")
_LETTERS = re.compile(r"[^\W\d_]")
STATISTICS = (
    "log_chars", "log_words", "word_length", "letters", "digits", "blanks", "upper_words", "capital_words", "symbol_words", "lone_symbols", "ends_odd",
    "distinct_words", "top_word", "distinct_lines", "repeated_chars_lines", "distinct_pairs", "line_length", "sentence_words", "short_words", "long_words", "doubled_words",
)


def statistics(text: str) -> list[float]:
    """The STATISTICS of a whole text; all are 0 for an empty one. Shares lie between 0 and 1, lengths are logarithms."""
    words = text.split()
    if not words:
        return [float(np.log1p(len(text)))] + [0.0] * (len(STATISTICS) - 1)
    n, chars = len(words), len(text)
    lines = [x for x in text.split("\n") if x.strip()]
    lowered = [w.lower() for w in words]
    counts: dict[str, int] = {}
    for w in lowered:
        counts[w] = counts.get(w, 0) + 1
    pairs = set(zip(lowered, lowered[1:]))
    seen: set[str] = set()
    again = 0
    for line in lines:
        again += len(line) if line in seen else 0
        seen.add(line)
    letters = len(_LETTERS.findall(text))
    return [
        float(np.log1p(chars)),
        float(np.log1p(n)),
        float(np.log1p(sum(map(len, words)) / n)),
        letters / chars,
        len(_DIGITS.findall(text)) / chars,
        (chars - sum(map(len, words))) / chars,
        sum(w.isupper() and len(w) > 1 for w in words) / n,
        sum(w[0].isupper() for w in words) / n,
        len(_SYMBOL_RUN.findall(text)) / n,
        len(_LONE.findall(text)) / n,
        sum(not line.rstrip().endswith((".", "!", "?", '"', "'", ")", ":")) for line in lines) / max(1, len(lines)),
        len(counts) / n,
        max(counts.values()) / n,
        len(seen) / max(1, len(lines)),
        again / chars,
        len(pairs) / max(1, n - 1),
        float(np.log1p(chars / max(1, len(lines)))),
        float(np.log1p(n / max(1, len(_PUNCTUATED.findall(text))))),
        sum(len(w) <= 2 for w in words) / n,
        sum(len(w) >= 12 for w in words) / n,
        sum(a == b for a, b in zip(lowered, lowered[1:])) / n,
    ]


def with_statistics(df: DataFrame, text: str = "text", out: str = "stats") -> DataFrame:
    """Replaces ``text`` by ``out`` (array<double>, in the order of STATISTICS). Null texts count as empty."""
    require(df, text)
    kept = without(df, [text, out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, OUT_ROWS):
                batch = whole.slice(at, OUT_ROWS)
                made = pa.array([statistics(x or "") for x in batch.column(len(kept)).to_pylist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + [made], names=names)

    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(out, T.ArrayType(T.DoubleType()))])
    names = schema.names
    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(text)).mapInArrow(run, schema)


@dataclass
class Model:
    """Statistics are standardised, mapped to random Fourier features and scored; the score is calibrated by steps."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    levels: np.ndarray
    phases: tuple[np.ndarray, np.ndarray]

    def features(self, stats: np.ndarray) -> np.ndarray:
        return _fourier((stats - self.mean) / self.scale, self.phases)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return self.levels[np.searchsorted(self.edges, self.raw(stats), side="right")]


def _phases(inputs: int, features: int = FEATURES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(seed)
    return random.normal(0, 1 / WIDTH, (inputs, features)), random.uniform(0, 2 * np.pi, features)


def _fourier(x: np.ndarray, phases: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Features whose inner products approximate a Gaussian kernel of width WIDTH, and a constant one."""
    z = np.sqrt(2 / phases[1].size) * np.cos(np.clip(x, -8, 8) @ phases[0] + phases[1])
    return np.concatenate((z, np.ones((len(x), 1))), axis=1)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``values`` by weighted squares (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(values.tolist(), weights.tolist(), strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def _summed(df: DataFrame, kernel, width: int) -> np.ndarray:
    """The sum over all rows of ``kernel(stats, label)``, a vector of ``width``: partial sums per task, then per group of tasks, then one."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                stats = np.asarray(batch.column(0).to_pylist(), dtype=float)
                total += kernel(stats, np.asarray(batch.column(1).to_pylist(), dtype=float))
        context = TaskContext.get()
        yield pa.RecordBatch.from_arrays([pa.array([(context.partitionId() if context else 0) % 64], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "total"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(width)
        for packed in group.column("total"):
            total += np.frombuffer(packed.as_py())
        return pa.table({"total": pa.array([total.tobytes()], pa.binary())})

    sums = df.mapInArrow(partial, "part int, total binary").groupBy("part").applyInArrow(add, "total binary")
    return sum((np.frombuffer(row["total"]) for row in sums.collect()), np.zeros(width))  # 64 rows at most


def fit(rows: DataFrame) -> Model:
    """From (stats, label double, calibrate boolean): fits on the rows to fit, calibrates on the others.

    Without any labelled rows every score is 0.5; with one class only, that class's rate.
    """
    inputs = len(STATISTICS)
    base, held = rows.filter("not calibrate").select("stats", "label"), rows.filter("calibrate").select("stats", "label")
    moments = _summed(base, lambda s, y: np.concatenate(([len(s)], s.sum(0), (s * s).sum(0))), 1 + 2 * inputs)
    n = max(1.0, moments[0])
    mean = moments[1 : 1 + inputs] / n
    scale = np.sqrt(np.maximum(moments[1 + inputs :] / n - mean**2, 0))
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(FEATURES + 1), np.zeros(0), np.array([0.5]), _phases(inputs))
    if not moments[0]:
        return model
    size = FEATURES + 1

    def equations(stats: np.ndarray, label: np.ndarray) -> np.ndarray:
        z = model.features(stats)
        return np.concatenate(((z.T @ z).ravel(), z.T @ label))

    total = _summed(base, equations, size * size + size)
    system = total[: size * size].reshape(size, size) + RIDGE * n / 1000 * np.eye(size)
    model.weights = np.linalg.solve(system, total[size * size :])
    grid = np.linspace(-0.5, 1.5, BINS + 1)[1:-1]

    def binned(stats: np.ndarray, label: np.ndarray) -> np.ndarray:
        at = np.searchsorted(grid, model.raw(stats), side="right")
        return np.concatenate((np.bincount(at, minlength=BINS), np.bincount(at, weights=label, minlength=BINS)))

    counts = _summed(held, binned, 2 * BINS)
    if not counts[:BINS].any():
        counts = _summed(base, binned, 2 * BINS)
    # Each bin leans on the diagonal with the weight of one row, so empty bins and ends stay near the ridge score.
    lean = np.clip(np.linspace(-0.5, 1.5, BINS), 0, 1)
    weights = counts[:BINS] + 0.05
    model.edges, model.levels = grid, np.clip(isotonic((counts[BINS:] + 0.05 * lean) / weights, weights), 0, 1)
    return model


def score(df: DataFrame, model: Model, stats: str = "stats", out: str = "score") -> DataFrame:
    """Replaces ``stats`` by ``out`` (double, 0 to 1)."""
    kept = without(df, [stats, out])
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(out, T.DoubleType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(len(kept)).to_pylist()
            made = model.score(np.asarray(rows, dtype=float)) if rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + [pa.array(made, pa.float64())], names=names)

    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(stats)).mapInArrow(run, schema)


def fold(key: str) -> Column:
    """crc32 of the key as text, modulo 5; null keys are in fold 0, which is never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)), F.lit(0)).cast("int")


def _known(labels: DataFrame, key: str, label: str) -> DataFrame:
    """(__key, label): one row per key that may be learned from."""
    filled = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & (fold(key) != 0))
    return filled.groupBy(F.col(key).alias("__key")).agg(F.avg(label).alias("label"))


def _learn(stats: DataFrame, labels: DataFrame, key: str, label: str) -> Model:
    rows = stats.join(_known(labels, key, label), "__key").select("stats", F.col("label").cast("double").alias("label"), (fold("__key") == 1).alias("calibrate"))
    return fit(materialised(rows))


def classify(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row per row of ``df``: ``key`` and score (double, higher: label 1 likelier).

    Learns from the labelled rows whose fold is not 0: fold 1 calibrates, the others fit. The label of a key that ``labels``
    has several times is their mean; null labels, and labels without a row, are left out. The statistics of all rows are made
    once and joined to the labels, so no text moves. The label, the key and other columns are never inputs of a score.
    Null and empty texts are scored like any other. Repeated rows are scored each; an empty table gives an empty result.
    """
    require(df, key, text)
    stats = materialised(with_statistics(df.select(F.col(key).alias("__key"), F.col(text).alias("text")), "text", "stats"))
    return score(stats, _learn(stats, labels, key, label)).withColumnRenamed("__key", key)


def keep(df: DataFrame, labels: DataFrame, least: float, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The rows of ``df`` whose score is ``least`` or more, with all their columns, whatever these are called. Learns as ``classify`` does.

    Null, empty and very long texts are scored like any other, repeated rows each; an empty table gives an empty table.

    Rows are scored where they are. Up to BROADCAST_KEYS labelled keys are broadcast, so that only their rows' statistics are
    made for learning; beyond, the statistics of all rows are made and joined to the labels. No text moves either way.
    """
    require(df, key, text)
    wanted = materialised(_known(labels, key, label).select("__key"))
    labelled = df.select(F.col(key).alias("__key"), F.col(text).alias("text"))
    if wanted.count() <= BROADCAST_KEYS:
        labelled = labelled.join(F.broadcast(wanted), "__key", "left_semi")
    model = _learn(materialised(with_statistics(labelled, "text", "stats")), labels, key, label)

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (value,) in rows:
            yield (float(model.score(np.asarray([statistics(value or "")]))[0]),)

    plain = numbered(df, df.columns)
    spot = [c.lower() for c in df.columns].index(text.lower())
    scored = map_rows(plain, [f"c{spot}"], [T.StructField("score", T.DoubleType())], kernel)
    return scored.filter(F.col("score") >= least).drop("score").toDF(*df.columns)
