"""Span trees: parents, anomalies, self time, critical path."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tessera.session import dropped, materialised

KEY = ["trace_id", "span_id"]


def duration():
    """Null while a span is open."""
    return F.col("ended_ms") - F.col("started_ms")


def resolved(spans: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Adds parent (null for the root) and anomaly (null, orphan, cycle, second_root).

    Whether a span reaches a root is found by pointer doubling: after r rounds a span points 2^r ancestors up, so depth d
    takes log2(d) joins. A round takes along only the spans that still have an ancestor. When no span of these has moved to a
    root, they are those on, or under, a cycle. Spans are written once, with the parents that exist.
    """
    exists = spans.select("trace_id", F.col("span_id").alias("__p"), F.lit(True).alias("__known")).distinct()
    own = spans.withColumn("__p", F.nullif(F.col("parent_id"), F.lit("")))
    linked = materialised(own.join(exists, ["trace_id", "__p"], "left").select(*spans.columns, F.when(F.col("__known"), F.col("__p")).alias("__p"), (F.col("__p").isNotNull() & F.col("__known").isNull()).alias("__orphan")))
    jump = linked.filter("__p is not null").select(*KEY, F.col("__p").alias("up"))
    climbing, before = jump.count(), None
    for _ in range(max_rounds):
        if climbing == 0 or climbing == before:
            break
        nxt = jump.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("next"))
        last, jump = jump, materialised(jump.join(nxt, ["trace_id", "up"]).select(*KEY, F.col("next").alias("up")))
        dropped(last)
        climbing, before = jump.count(), climbing
    rooted = linked.withColumn("__cyclic", F.lit(False))
    if climbing:
        cyclic = jump.select(*KEY, F.lit(True).alias("__on"))
        rooted = linked.join(cyclic, KEY, "left").withColumns({"__p": F.when(F.col("__on").isNull(), F.col("__p")), "__cyclic": F.col("__on").isNotNull()}).drop("__on")
    free = rooted.filter("__p is null")
    chief = free.groupBy("trace_id").agg(F.min(F.struct("started_ms", "span_id"))["span_id"].alias("__root"))
    bound = rooted.filter("__p is not null").withColumn("__root", F.lit(None).cast(dict(spans.dtypes)["span_id"]))
    extra = F.col("__p").isNull() & (F.col("span_id") != F.col("__root"))
    anomaly = F.when(F.col("__cyclic"), "cycle").when(F.col("__orphan"), "orphan").when(extra, "second_root")
    return free.join(chief, "trace_id").unionByName(bound).select(*spans.columns, F.when(extra, F.col("__root")).otherwise(F.col("__p")).alias("parent"), anomaly.alias("anomaly"))


def self_time(tree: DataFrame) -> DataFrame:
    """Adds self_ms: the duration less the children's, at least 0; null while open."""
    inside = tree.filter("parent is not null").groupBy("trace_id", F.col("parent").alias("span_id")).agg(F.sum(F.coalesce(duration(), F.lit(0))).alias("__inside"))
    return tree.join(inside, KEY, "left").withColumn("self_ms", F.greatest(F.lit(0), duration() - F.coalesce("__inside", F.lit(0)))).withColumn("self_ms", F.when(duration().isNotNull(), F.col("self_ms"))).drop("__inside")


def by_kind(timed: DataFrame, *by: str) -> DataFrame:
    return timed.filter("self_ms is not null").groupBy(*by, "kind").agg(F.sum("self_ms").alias("self_ms"))


def critical_path(tree: DataFrame) -> DataFrame:
    """(trace_id, step, span_id): from the root to a leaf by the longest child; ties by the earlier start, then the id.

    Every span that is its parent's heir follows its parent, so heirs form chains. Which of them begin at a root, and the places in
    these, are found by list ranking: in each round an open heir takes over what the one it points at points at, so a path of any depth d
    takes log2(d) joins. An heir that points at no heir and no root is on no path, and leaves.
    """
    held = materialised(tree.select(*KEY, "parent", (-F.coalesce(duration(), F.lit(0))).alias("order"), "started_ms"))
    roots = held.filter("parent is null").select("trace_id", F.col("span_id").alias("up"), F.lit(True).alias("root"))
    heir = held.filter("parent is not null").groupBy("trace_id", F.col("parent").alias("up")).agg(F.min(F.struct("order", "started_ms", "span_id"))["span_id"].alias("span_id"))
    chain = materialised(heir.join(roots, ["trace_id", "up"], "left").select(*KEY, "up", F.lit(1).cast("long").alias("above"), F.col("root").isNotNull().alias("done")))
    while not chain.filter("not done").isEmpty():
        further = chain.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("next"), F.col("above").alias("more"), F.col("done").alias("ends"))
        moved = chain.filter("not done").join(further, ["trace_id", "up"]).select(*KEY, F.col("next").alias("up"), (F.col("above") + F.col("more")).alias("above"), F.col("ends").alias("done"))
        last, chain = chain, materialised(chain.filter("done").unionByName(moved))
        dropped(last)
    return roots.select("trace_id", F.lit(1).alias("step"), F.col("up").alias("span_id")).unionByName(chain.select("trace_id", (F.col("above") + 1).cast("int").alias("step"), "span_id"))


def bounded_tree(tree: DataFrame, max_depth: int = 4, max_nodes: int = 60) -> DataFrame:
    """(trace_id, depth, path, span_id, omitted): up to ``max_nodes`` spans per trace in depth-first order, and how many are left out."""
    place = F.concat(F.lpad(F.col("started_ms").cast("string"), 20, "0"), F.lit(":"), F.col("span_id"))
    level = tree.filter("parent is null").select("trace_id", "span_id", F.lit(0).alias("depth"), F.array(place).alias("path"))
    out = level
    for depth in range(1, max_depth + 1):
        level = tree.select("trace_id", "span_id", F.col("parent"), place.alias("place")).join(level.select("trace_id", F.col("span_id").alias("parent"), "path"), ["trace_id", "parent"]).select("trace_id", "span_id", F.lit(depth).alias("depth"), F.concat("path", F.array("place")).alias("path"))
        out = out.unionByName(level)
    sizes = tree.groupBy("trace_id").agg(F.count("*").alias("spans"))
    ranked = out.withColumn("n", F.row_number().over(Window.partitionBy("trace_id").orderBy("path"))).filter(F.col("n") <= max_nodes)
    shown = ranked.withColumn("shown", F.count("*").over(Window.partitionBy("trace_id")))
    return shown.join(sizes, "trace_id").select("trace_id", "n", "depth", "span_id", (F.col("spans") - F.col("shown")).alias("omitted"))
