"""Exact k-means over whole numbers with Yinyang bounds.

The centroids are put into groups once. Every vector keeps its centroid, an upper bound of the distance to it and one lower bound
per group for the distance to the group's other centroids. After each move of the centroids the bounds follow by the lengths
of the moves: a vector whose upper bound is under all lower bounds is done (the global filter); else only groups whose lower
bound is not over it are looked at, and in these only centroids whose own move lets them come near enough; those are
measured exactly. All distances that decide are whole numbers; bounds are widened by more than their rounding, and a vector is
passed over only where a bound is strictly greater, so ties always go to the centroid with the smaller number.

A round is one pass over a written table (the vectors with their bounds), without a shuffle of vectors; a task passes on one sum
per centroid. What goes through the driver are centroids: K x the number of components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tessera.llm.common import require
from tessera.session import dropped, materialised, spread

#: Centroids per group, and turns of the grouping.
GROUP_OF, GROUPING_TURNS = 4, 5
#: Components must be under this, so that squared distances of up to 256 components fit a long.
MOST = 1 << 26
_WIDER = 1e-9


def quantised(df: DataFrame, key: str, vector: str, components: int, scale: float) -> DataFrame:
    """(key, v array<long>): vectors of exactly ``components`` components, none null or not finite, as floor(scale * x)."""
    x = F.transform(F.col(f"`{vector}`"), lambda c: c.cast("double"))
    good = (F.size(x) == components) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.filter(F.col(f"`{vector}`").isNotNull() & good).select(F.col(f"`{key}`").alias("key"), F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))


def grouped(centroids: np.ndarray) -> np.ndarray:
    """The group of each centroid: a small clustering of the centroids themselves, in a fixed order."""
    n = -(-len(centroids) // GROUP_OF)
    points = centroids.astype(float)
    middles = points[:n].copy()
    group = np.zeros(len(points), dtype=np.int64)
    for _ in range(GROUPING_TURNS):
        group = ((points[:, None] - middles[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(n):
            if (group == g).any():
                middles[g] = points[group == g].mean(axis=0)
    return np.unique(group, return_inverse=True)[1]


def squared(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    return np.square(vectors - centroid).sum(axis=1)


def first_bounds(vectors: np.ndarray, centroids: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest, upper, lower[vector, group]) by a full scan."""
    every = np.stack([squared(vectors, c) for c in centroids], axis=1)
    nearest, rows = every.argmin(axis=1), np.arange(len(vectors))
    upper = np.sqrt(every[rows, nearest]) * (1 + _WIDER)
    others = np.sqrt(every) * (1 - _WIDER)
    others[rows, nearest] = np.inf
    return nearest, upper, np.stack([others[:, group == g].min(axis=1) for g in range(group.max() + 1)], axis=1)


def next_bounds(vectors: np.ndarray, nearest: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, moved: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after the centroids have ``moved`` by these lengths, and how many distances were measured."""
    before, furthest = lower, np.array([moved[group == g].max() for g in range(lower.shape[1])])
    upper, lower, nearest = upper + moved[nearest], lower - furthest, nearest.copy()
    open_ = np.flatnonzero(lower.min(axis=1) <= upper)
    if not len(open_):
        return nearest, upper, lower, 0
    own = np.square(vectors[open_] - centroids[nearest[open_]]).sum(axis=1)
    upper[open_] = np.sqrt(own) * (1 + _WIDER)
    again = lower[open_].min(axis=1) <= upper[open_]
    open_, own, measured = open_[again], own[again], len(open_)
    old, best, best_at = nearest[open_], own.copy(), nearest[open_]
    looked = lower[open_] <= upper[open_][:, None]
    # What each centroid's distance is at least: measured exactly, or the group's bound before the moves less its own move.
    least = np.where(looked[:, group], before[open_][:, group] - moved[None], np.inf)
    least[np.arange(len(open_)), old] = np.inf
    for c in range(len(centroids)):
        rows = np.flatnonzero(looked[:, group[c]] & (old != c) & (least[:, c] <= np.sqrt(best) * (1 + _WIDER)))
        if len(rows):
            far = squared(vectors[open_[rows]], centroids[c])
            measured += len(rows)
            least[rows, c] = np.sqrt(far) * (1 - _WIDER)
            nearer = (far < best[rows]) | ((far == best[rows]) & (c < best_at[rows]))
            best[rows[nearer]], best_at[rows[nearer]] = far[nearer], c
    changed = best_at != old
    least[np.flatnonzero(changed), old[changed]] = np.sqrt(own[changed]) * (1 - _WIDER)
    least[np.arange(len(open_)), best_at] = np.inf
    fresh = np.stack([least[:, group == g].min(axis=1) for g in range(lower.shape[1])], axis=1)
    # A group that was not looked at keeps its bound, but for the old centroid, if that was its.
    lower[open_] = np.where(looked, fresh, np.minimum(lower[open_], fresh))
    nearest[open_], upper[open_] = best_at, np.sqrt(best) * (1 + _WIDER)
    return nearest, upper, lower, measured


def seeds(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The vectors (key, v) with the smallest SHA-256 of salt:key, in its order; equal hashes by the components."""
    chosen = vectors.filter("key is not null").select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("key").cast("string")).cast("binary"), 256).alias("hash"), "v")
    return np.array([row.v for row in chosen.orderBy("hash", "v").limit(k).collect()], dtype=np.int64)


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 16, components: int = 64, scale: float = 64, rounds: int = 3, salt: str = "1") -> DataFrame:
    """One row per kept row of ``df``: ``key``, cluster int, distance (squared), cluster_inertia and inertia long, centroid_sha256 string.

    Kept are vectors of exactly ``components`` components, none of them null or not finite; components become floor(scale * x). The
    first centroids are the ``k`` vectors (all, if there are fewer) with the smallest SHA-256 of ``salt:key``; rows without a key
    are clustered, but start no cluster. Each round assigns every vector to its nearest centroid, ties to the smaller number, and
    moves every centroid that has vectors to the floor of their exact mean; after the last round all are assigned once more.
    Centroids may be equal, as seeds of repeated vectors are: all but the first then stay empty and stay where they are.

    A component of MOST (2^26) or more, which could overflow a distance, fails the job with an error. Rows that repeat are
    clustered each. Other columns are not read, whatever their names. No row is kept of an empty table, and none comes of it.
    """
    require(df, key, vector)
    if components > 256:
        raise ValueError("at most 256 components")
    spark = df.sparkSession
    kind = df.schema[[c.lower() for c in df.columns].index(key.lower())].dataType
    vectors = quantised(spread(df.select(f"`{key}`", f"`{vector}`")), key, vector, components, scale)
    centroids = seeds(vectors, k, salt)
    out = [T.StructField(key, kind), T.StructField("cluster", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in ("distance", "cluster_inertia", "inertia")], T.StructField("centroid_sha256", T.StringType())]
    if not len(centroids):
        if not vectors.isEmpty():
            raise ValueError("no vector has a key, so none can start a cluster")
        return spark.createDataFrame([], T.StructType(out))
    group = grouped(centroids)
    shape = (-1, components)
    schema = T.StructType([T.StructField("key", kind), T.StructField("v", T.BinaryType()), T.StructField("cluster", T.IntegerType()), T.StructField("upper", T.DoubleType()), T.StructField("lower", T.BinaryType())])

    def packed(keys: pa.Array, values: np.ndarray, nearest: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> pa.RecordBatch:
        rows = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (values.astype("<i4"), lower.astype("<f8"))]
        return pa.RecordBatch.from_arrays([keys, rows[0], pa.array(nearest.astype(np.int32)), pa.array(upper), rows[1]], names=schema.names)

    def opened(column: pa.Array, dtype: str, width: int) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(-1, width)

    def begin(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            places = shared.value
            for batch in batches:
                if batch.num_rows:
                    values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(shape)
                    if values.max() >= MOST or values.min() < -MOST:
                        raise ValueError(f"a component of {MOST} or more: scale the vectors down")
                    yield packed(batch.column(0), values, *first_bounds(values, places, group))

        return run

    def go_on(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            places, moved = shared.value
            for batch in batches:
                if batch.num_rows:
                    values = opened(batch.column(1), "<i4", components).astype(np.int64)
                    made = next_bounds(values, batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy(), opened(batch.column(4), "<f8", int(group.max()) + 1), places, moved, group)
                    yield packed(batch.column(0), values, *made[:3])

        return run

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per centroid and task; sums of whole numbers, so their order does not matter."""
        total, n = np.zeros((k, components), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            nearest = batch.column(0).to_numpy()
            np.add.at(total, nearest, opened(batch.column(1), "<i4", components).astype(np.int64))
            n += np.bincount(nearest, minlength=k)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(n[held]), pa.array(total[held].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    state = materialised(vectors.mapInArrow(begin(spark.sparkContext.broadcast(centroids)), schema))
    for _ in range(rounds):
        parts = state.select("cluster", "v").mapInArrow(sums, "cluster int, n long, total array<long>")
        # Sums of all tasks in decimals: exact for any number of vectors.
        whole = parts.select("cluster", "n", F.posexplode("total").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        places = centroids.copy()
        for row in whole.collect():  # K x components rows
            places[row.cluster, row.at] = int(row.x) // row.n
        moved = np.sqrt(np.square(places - centroids).sum(axis=1)) * (1 + _WIDER)
        centroids, old = places, state
        state = materialised(old.mapInArrow(go_on(spark.sparkContext.broadcast((centroids, moved))), schema))
        dropped(old)

    final = spark.sparkContext.broadcast(centroids)

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = opened(batch.column(2), "<i4", components).astype(np.int64)
                far = np.square(values - final.value[batch.column(1).to_numpy()]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far)], names=["key", "cluster", "distance"])

    measured = state.select("key", "cluster", "v").mapInArrow(distances, T.StructType([schema["key"], schema["cluster"], T.StructField("distance", T.LongType())]))
    by_cluster = {row.cluster: row.far for row in measured.groupBy("cluster").agg(F.sum("distance").alias("far")).collect()}  # K rows
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame([(c, far, sum(by_cluster.values()), digests[c]) for c, far in by_cluster.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return measured.join(F.broadcast(facts), "cluster").select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
