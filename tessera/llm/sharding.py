"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

Each shard owns several points of a ring of 64-bit hashes, which depend on the shard alone; a row belongs to the next point
clockwise of its key's hash. So another shard only inserts points, and takes the rows before them. Every shard takes a fixed
number of rows, and these loads sum to the row count, so all shards end exactly full: counts differ by one at most. The
rows that a full shard leaves over continue clockwise to the next shard that has room.

Only the counts of the arcs reach the driver, where the overflow is dealt out; there are shards x virtual nodes of them,
whatever the row count. Rows are ranked within their arc, in many small groups, never within a shard.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.common import require, without

SHARDS, VIRTUAL_NODES = 24, 256


def points(shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """(point, shard) in ring order: a shard's points are hashes of its number and the replica's, whatever the other shards are."""
    at = lambda s, i: int.from_bytes(hashlib.blake2b(f"{s}:{i}".encode(), digest_size=8).digest(), signed=True)
    return sorted((at(s, i), s) for s in range(shards) for i in range(virtual_nodes))


def ring(shards: int, virtual_nodes: int) -> list[int]:
    """The shard that owns each arc, in ring order: every shard owns ``virtual_nodes`` of them."""
    return [s for _, s in points(shards, virtual_nodes)]


def deal(counts: list[int], owner: list[int], loads: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot) of the runs of rows that go to one shard.

    Each shard first takes from its own arcs, in ring order, while it has room. What is left over walks on clockwise.
    The sum of ``loads`` must be the sum of ``counts``.
    """
    room, slot, runs = list(loads), [0] * len(loads), []

    def give(arc: int, first: int, n: int, shard: int) -> None:
        runs.append((arc, first, first + n, shard, slot[shard]))
        room[shard] -= n
        slot[shard] += n

    left = []
    for arc, n in enumerate(counts):
        own = min(n, room[owner[arc]])
        if own:
            give(arc, 0, own, owner[arc])
        if n > own:
            left.append((arc, own, n - own))
    for arc, first, n in left:
        at = arc
        while n:
            at = (at + 1) % len(owner)
            part = min(n, room[owner[at]])
            if part:
                give(arc, first, part, owner[at])
                first, n = first + part, n - part
    return runs


def arc_of(spot: Column, ends: list[int]) -> Column:
    """The index of the first of the sorted points that is not below the hash ``spot``; behind the last one, 0."""
    table = F.lit(np.asarray(ends, dtype=np.int64))

    def halve(state: Column, _: Column) -> Column:
        middle = F.shiftright(state["lo"] + state["hi"], 1)
        open_, below = state["lo"] < state["hi"], F.get(table, middle) < spot
        return F.struct(F.when(open_ & below, middle + 1).otherwise(state["lo"]).alias("lo"), F.when(open_ & ~below, middle).otherwise(state["hi"]).alias("hi"))

    span = F.struct(F.lit(0).alias("lo"), F.lit(len(ends)).alias("hi"))
    steps = F.sequence(F.lit(1), F.lit(len(ends).bit_length()))
    return F.aggregate(steps, span, halve, lambda s: F.pmod(s["lo"], F.lit(len(ends)))).cast("int")


def shard(df: DataFrame, key: str = "doc_id", order: tuple[str, ...] = (), shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """Adds ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard) to every row.

    The arc is found from ``key``, of rows without a key from the ``order`` columns, so that these spread too; rows of one arc
    are ranked by the key's hash, the key and the ``order`` columns, so equal rows may swap places and nothing else can. Rows
    that repeat are placed each. Other columns, very long texts among them, move with their row and are not read. Columns of
    ``df`` named like an output are replaced; its other names can't clash. An empty table gives an empty table.
    """
    require(df, key, *order)
    placed_at = points(shards, virtual_nodes)
    ends, owner = [p for p, _ in placed_at], [s for _, s in placed_at]
    kept = without(df, ["shard", "slot"])
    named = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], *[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate((key, *order))])
    wanted = [f"o{i}" for i in range(len(order) + 1)]
    spot = F.when(F.col("o0").isNotNull(), F.xxhash64("o0")).otherwise(F.xxhash64(F.lit("no key"), *wanted[1:]))
    rows = named.withColumn("arc", arc_of(spot, ends))
    counts = [0] * len(owner)
    for row in rows.groupBy("arc").count().collect():  # one row per arc at most
        counts[row["arc"]] = row["count"]
    total = sum(counts)
    loads = [total // shards + (s < total % shards) for s in range(shards)]
    runs = deal(counts, owner, loads)
    # Runs are at most arcs + shards x arcs passed; each arc splits only where a shard fills up, so they stay near the arc count.
    table = df.sparkSession.createDataFrame(runs or [(0, 0, 0, 0, 0)], "arc int, first long, end long, shard int, slot long")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("arc").orderBy(spot, *wanted)).cast("long") - 1)
    placed = ranked.join(F.broadcast(table), "arc").filter((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    return placed.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], "shard", (F.col("slot") + F.col("rank") - F.col("first")).alias("slot"))
