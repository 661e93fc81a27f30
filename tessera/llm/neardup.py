"""Near-duplicate classes: one-permutation MinHash, optimal densification, banded buckets and star-shaped candidate edges.

1. A document's word shingles are hashed once each. Documents with equal shingle sets form a class, kept by its smallest id.
2. One permutation splits the hash space into BANDS x ROWS bins; a bin keeps its smallest hash. An empty bin borrows from the
   first non-empty one in a random order of its own, so two sets agree on a bin with a probability of their similarity.
3. Each band of ROWS bins is a bucket key. At similarity 0.8 a pair misses all BANDS buckets once in 350,000 times.
4. A bucket of up to SMALL members proposes its pairs, at most SMALL - 1 per row; a larger one proposes a star, from its
   smallest member to each other. Proposed pairs are confirmed on full shingle sets.
5. A larger bucket whose members are not yet in one component is not settled by its star: its members are dealt again by
   AGAIN other bands within the bucket. So a group costs a number of pairs linear in its rows, and most links that the star's
   centre does not have are found.
6. The members of larger buckets that are still not in one component are joined exactly, by their rarest shingles: two sets
   that are similar enough have their first common shingle, rare ones first, near the start of both. Members that have a frequent
   shingle there, such as pages made of shared paragraphs, are compared within their buckets instead, in blocks of a fixed size and
   inside a task: by sketches of SIGNS permutations, then by full sets. It passes on links that connect, not pairs. No bucket is dropped.
7. Confirmed links are joined to components by alternating rounds of the smallest label and of pointer jumping.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tessera.llm.common import numbered, require
from tessera.session import dropped, few_files, materialised

BANDS, ROWS = 42, 6
#: Members up to which a bucket proposes all its pairs; times that a larger one is dealt again, by how many other bands.
SMALL, DEPTH, AGAIN = 12, 1, 8
#: Stars of a bucket that is dealt again: one from its smallest member, the others from members that a hash chooses.
STARS = 5
#: Rows with a shingle near their start up to which it proposes pairs.
HOT = 128
#: Rows of a block of an unsettled bucket; permutations of the sketch that is compared there, a byte per bin; deviations that it may be
#: under the similarity of a link (one link in 10^11 is further off).
BLOCK, SIGNS, DEVIATIONS = 2048, 4, 7
#: Hashes that are looked up at once in a task.
AT_ONCE = 1 << 20
#: Rows of ids that are broadcast at most, 16 to 40 bytes each; more are joined by a shuffle.
BROADCAST_IDS = 500_000
_BINS = BANDS * ROWS
_U = np.uint64
_MIX = (_U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB))
_TURNS = np.arange(SIGNS, dtype=_U) * _MIX[0]
#: Bytes of a shingle's hash that are kept to confirm links: 48 bits.
_KEPT = 6


def _finish(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x = x * _MIX[1]
    x = x ^ (x >> _U(27))
    x = x * _MIX[2]
    return x ^ (x >> _U(31))


def _orders() -> np.ndarray:
    """Row i: the rank of every bin in bin i's own random order."""
    ids = np.arange(_BINS, dtype=_U)
    keys = _finish((ids[:, None] * _U(_BINS) + ids[None, :] + _U(1)) * _MIX[0])
    return keys.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable").astype(np.int16)


_ORDERS = _orders()
_BAND_SALT = _finish(np.arange(1, BANDS + 1, dtype=_U) * _MIX[0])


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles. Words are runs of bytes other than the six ASCII blanks, with
    A-Z lower-cased, which is what ``bytes.lower().split()`` gives. A shorter text is one shingle; no words give none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=_U)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=_U, count=len(words))
    n = min(width, len(words))
    runs = len(words) - n + 1
    mixed = np.full(runs, n, dtype=_U)
    for i in range(n):
        mixed = _finish(mixed * _MIX[0] + hashes[i : i + runs])
    return np.unique(mixed)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The densified bins of a non-empty set of sorted hashes: the bin is the hash's leading part, so each bin's first hash is its least."""
    bins = ((hashes >> _U(32)) * _U(_BINS) >> _U(32)).astype(np.int64)
    filled, first = np.unique(bins, return_index=True)
    out = np.zeros(_BINS, dtype=_U)
    out[filled] = hashes[first]
    if len(filled) < _BINS:
        empty = np.setdiff1d(np.arange(_BINS), filled, assume_unique=True)
        out[empty] = hashes[first[_ORDERS[empty][:, filled].argmin(axis=1)]]
    return out


def band_keys(bins: np.ndarray) -> np.ndarray:
    grid, key = bins.reshape(BANDS, ROWS), _BAND_SALT
    for i in range(ROWS):
        key = _finish(key * _MIX[0] + grid[:, i])
    return key.view(np.int64)


def sketches(df: DataFrame, key: str, text: str, width: int, parts: tuple[str, ...]) -> DataFrame:
    """(id, n, digest) and, as asked for, bands array<long> and members binary (packed 48-bit hashes), per row."""
    fields = [T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType())]
    fields += [T.StructField("bands", T.ArrayType(T.LongType()))] * ("bands" in parts) + [T.StructField("members", T.BinaryType())] * ("members" in parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                ids, rows = batch.column(0).slice(at, 512), []
                for value in batch.column(1).slice(at, 512).to_pylist():
                    found = shingles(value or "", width)
                    row = [len(found), xxhash.xxh3_128_digest(found.tobytes())]
                    if "bands" in parts:
                        row.append(band_keys(signature(found)) if len(found) else np.zeros(0, dtype=np.int64))
                    if "members" in parts:
                        row.append(found.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - _KEPT :].tobytes())
                    rows.append(row)
                columns = list(zip(*rows, strict=True))
                arrays = [ids, pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary())]
                if "bands" in parts:
                    arrays.append(pa.array(columns[2], pa.list_(pa.int64())))
                if "members" in parts:
                    arrays.append(pa.array(columns[-1], pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    return df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, T.StructType(fields))


def _sizes_fit(a: Column, b: Column) -> Column:
    """Sets of such sizes can have a similarity of 0.8."""
    return (a * 100 >= b * 80) & (b * 100 >= a * 80)


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose full sets have 100 x intersection >= 80 x union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                one, two = _opened(x.as_py()), _opened(y.as_py())
                both = np.concatenate((one, two))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= 80 * (len(one) + len(two) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("members").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("members").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _opened(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // _KEPT, 8), dtype=np.uint8)
    wide[:, :_KEPT] = np.frombuffer(packed, dtype=np.uint8).reshape(-1, _KEPT)
    return wide.view("<u8").ravel()


def _joined(rows: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every pair (a, b) of rows (id, n, label) with different labels that can have a similarity of 0.8, by prefix filtering; but for
    pairs that meet only at shingles that are in the start of over HOT rows: the ids of those rows are the second result.

    Shingles are ranked by the number of rows that have them, rarest first. Two sets of na and nb shingles need 4/9 (na + nb)
    common ones. Their first common one, at places ia and ib from 0, leaves at most na - ia and nb - ib; so it is among the
    first ninth of the smaller set and the first fifth of the larger one. A passage that many rows share is behind that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = _opened(packed.as_py()).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), id_, dtype=np.int64)), pa.array(found)], names=["id", "shingle"])

    tokens = sets.join(_bounded(rows.select("id")), "id", "left_semi").select("id", "members").mapInArrow(run, "id long, shingle long")
    common = tokens.groupBy("shingle").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    ranked = tokens.join(_bounded(common, small=False), "shingle", "left").withColumn("held", F.coalesce("held", F.lit(1)))
    ranked = ranked.withColumn("at", F.row_number().over(Window.partitionBy("id").orderBy("held", "shingle")).cast("long") - 1).filter("held > 1")
    starts = materialised(ranked.join(_bounded(rows), "id").filter("5 * at <= n").select("shingle", "id", "n", "label", "at"))
    frequent = starts.groupBy("shingle").agg(F.count_if(F.expr("9 * at <= n")).alias("first")).filter(F.col("first") > HOT).select("shingle")
    frequent = _bounded(frequent)
    hot = starts.join(frequent, "shingle", "left_semi").select("id").distinct()
    starts = starts.join(frequent, "shingle", "left_anti")
    smaller, larger = ([F.col(c).alias(f"{c}{side}") for c in ("id", "n", "label", "at")] for side in "ab")
    met = starts.filter("9 * at <= n").select("shingle", *smaller).join(starts.select("shingle", *larger), "shingle")
    met = met.filter("labela <> labelb and (na < nb or (na = nb and ida < idb))").filter(_sizes_fit(F.col("na"), F.col("nb")))
    met = met.filter("9 * (na - ata) >= 4 * (na + nb) and 9 * (nb - atb) >= 4 * (na + nb)")
    return met.select(F.least("ida", "idb").alias("a"), F.greatest("ida", "idb").alias("b")), hot


def sketch(packed: bytes) -> bytes:
    """SIGNS x BANDS x ROWS bytes of a packed, non-empty set: two sets agree on a byte with a probability of their similarity (and 1/256)."""
    found, parts = _opened(packed) << _U(16), []
    for i in range(SIGNS):
        turned = found if i == 0 else np.sort(_finish(found + _TURNS[i]))
        parts.append((signature(turned) >> _U(16)).astype(np.uint8))
    return np.concatenate(parts).tobytes()


def _least(n: np.ndarray) -> np.ndarray:
    """Equal bytes that a link's sketches have at least, for sets of ``n`` shingles: fewer shingles fill fewer bins."""
    filled = SIGNS * _BINS * -np.expm1(-n / _BINS)
    return SIGNS * _BINS * (0.8 - DEVIATIONS * np.sqrt(0.16 / filled))


def _linked(held: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between rows (bucket, id, n, label) of a bucket, enough to connect whatever labels are linked in it.

    A bucket is cut into slices of BLOCK / 2 rows; each pair of slices is compared inside a task, by sizes, then sketches, then full
    sets. So a bucket of any size is many tasks, and a task passes on fewer links than it has rows, however many pairs are near.
    """
    sizes = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    slices = F.ceil(F.col("size") * 2 / BLOCK).cast("int")
    cut = held.join(_bounded(sizes), "bucket").withColumn("slices", slices).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    dealt = dealt.select(F.xxhash64("bucket", low, high).alias("block"), side.alias("side"), "id", "n", "label")

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sketch(m.as_py()) for m in batch.column(1)], pa.binary()), batch.column(1)], names=["id", "sketch", "members"])

    def compared(block: list[tuple]) -> pa.RecordBatch:
        sides, ids, n, label = (np.array([row[i] for row in block], dtype=np.int64) for i in range(4))
        bytes_ = np.frombuffer(b"".join(row[4] for row in block), dtype=np.uint8).reshape(len(block), -1)
        least, second = _least(n), int(np.searchsorted(sides, 2))
        part = np.unique(label, return_inverse=True)[1]  # what is connected so far
        one, two = [], []
        for i in range(len(block)):
            start = i + 1 if sides[i] == 0 else second if sides[i] == 1 else len(block)
            m = n[start:]
            can = np.flatnonzero((part[start:] != part[i]) & (100 * m >= 80 * n[i]) & (100 * n[i] >= 80 * m)) + start
            if len(can):
                equal = (bytes_[can] == bytes_[i]).sum(axis=1)
                can = can[equal >= np.minimum(least[can], least[i])]
            mine = _opened(block[i][5]) if len(can) else None
            step = max(1, AT_ONCE // int(n[i]))
            for at in range(0, len(can), step):
                near = can[at : at + step]
                flat = _opened(b"".join(block[j][5] for j in near))
                spot = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
                common = np.add.reduceat(mine[spot] == flat, np.cumsum(n[near]) - n[near], dtype=np.int64)
                for j in near[100 * common >= 80 * (n[i] + n[near] - common)].tolist():
                    if part[j] != part[i]:
                        part[part == part[j]] = part[i]
                        one.append(ids[i])
                        two.append(ids[j])
        a, b = (np.array(x, dtype=np.int64) for x in (one, two))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, []
        for batch in batches:
            for key, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now and block:
                    yield compared(block)
                    block = []
                now = key
                block.append(row)
        if block:
            yield compared(block)

    sketches_ = materialised(sets.select("id", "members").mapInArrow(signed, "id long, sketch binary, members binary"))
    rows = dealt.join(sketches_, "id").repartition("block").sortWithinPartitions("block", "side")
    return rows.select("block", "side", "id", "n", "label", "sketch", "members").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id that each end of the links (a, b) reaches, for every id but that smallest one itself.

    Alternates two steps of Kiveris et al., "Connected Components in MapReduce and Beyond": each vertex hooks its larger
    neighbours, then its smaller ones and itself, onto its smallest; stars are left, in a number of rounds that grows with
    the logarithm of the size, squared. Minima are summed before they move; where there are many edges, minima are also
    written before the join, so that the planner can split a hub's rows.
    """

    def hook(edges: DataFrame, hold) -> DataFrame:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("m"))
        return both.filter("b > a").join(hold(least), "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()

    def gather(edges: DataFrame, hold) -> DataFrame:  # a is the smaller end
        least = edges.groupBy("b").agg(F.min("a").alias("m"))
        return edges.join(hold(least), "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a < b").distinct()

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 30)))).first())

    edges = materialised(few_files(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()))
    mark = state(edges)
    while mark[0]:
        hold = F.broadcast if mark[0] <= BROADCAST_IDS // 2 else materialised
        old, edges = edges, materialised(few_files(gather(hook(edges, hold), hold)))
        dropped(old)
        before, mark = mark, state(edges)
        if before == mark:
            break
    return edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("label"))


def _propose(rows: DataFrame, stars: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of different labels from buckets (bucket, id, n, label), and the rows of buckets that are larger than SMALL."""
    centres = [F.min(F.struct((F.xxhash64(F.lit(i), "id") if i else F.col("id")).alias("rank"), "id", "n", "label")) for i in range(stars)]
    seen = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.array(*centres).alias("centres"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    counted = _bounded(seen.filter("lo < hi").select("bucket", "size", F.when(F.col("size") > SMALL, F.col("centres")).alias("centres")), small=False)
    held = rows.join(counted, "bucket")
    small, large = held.filter(F.col("size") <= SMALL), held.filter(F.col("size") > SMALL)
    one, two = ([F.col(c).alias(f"{c}{side}") for c in ("id", "n", "label")] for side in "ab")
    pairs = small.select("bucket", *one).join(small.select("bucket", *two), "bucket").filter("ida < idb and labela <> labelb")
    pairs = pairs.filter(_sizes_fit(F.col("na"), F.col("nb"))).select(F.col("ida").alias("a"), F.col("idb").alias("b"))
    fits = F.filter("centres", lambda c: (c["label"] != F.col("label")) & _sizes_fit(F.col("n"), c["n"]))
    rays = large.select("id", F.explode(F.transform(fits, lambda c: c["id"])).alias("centre")).select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b"))
    return pairs.union(rays).distinct(), large.select("bucket", "id", "n")


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """(id long, n long, component long) per row of ``df``.

    Rows are linked if the Jaccard similarity of their sets of ``width``-word shingles is 0.8 or more; ``component`` is the
    smallest id reachable over links. Rows without words, or with a null text, are linked with nothing. Rows that share a
    key share a component. A null key gives a component of its own (null) and is linked with nothing. Columns other than
    the key and the text are not read. An empty table gives an empty result.
    """
    require(df, key, text)
    df = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    key, text = "key", "text"
    base = materialised(sketches(df, key, text, width, ("bands",)))
    filled = base.filter((F.col("n") > 0) & F.col("id").isNotNull())
    # Equal sets: the class's smallest id stands for it. Minima are taken per task first, so a class of any size moves as few rows.
    reps = materialised(filled.groupBy("digest").agg(F.min("id").alias("rep")))
    heads = filled.join(reps, (filled["digest"] == reps["digest"]) & (filled["id"] == reps["rep"]), "left_semi").dropDuplicates(["id"])
    heads = materialised(heads.select("id", "n", "bands"))
    rows = heads.select("id", "n", F.explode("bands").alias("bucket"), F.col("id").alias("label"))
    links = labels = None

    def sets_of(ids: DataFrame) -> DataFrame:
        chosen = df.withColumn("__id", F.col(key).cast("long")).join(_bounded(ids.select(F.col("id").alias("__id"))), "__id", "left_semi")
        return materialised(sketches(chosen, "__id", text, width, ("members",)).dropDuplicates(["id"]).select("id", "members"))

    def unsettled(large: DataFrame) -> DataFrame:
        """The rows (bucket, id, n), with their labels, of buckets that are not in one component."""
        named = large.join(_bounded(labels), "id", "left").withColumn("label", F.coalesce("label", "id"))
        split = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("bucket")
        return materialised(named.join(_bounded(split), "bucket", "left_semi"))

    for depth in range(DEPTH + 1):
        pairs, large = _propose(rows, STARS if depth else 1)
        pairs = materialised(pairs)
        found = materialised(few_files(_confirm(pairs, sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()))))
        if links is None or not found.isEmpty():
            links = found if links is None else links.union(found)
            labels = components(links)
        # The first buckets hold all that was dealt again.
        held = unsettled(materialised(large) if depth == 0 else held.drop("label"))
        if depth == DEPTH or held.isEmpty():
            break
        turn = F.array(*[F.get("bands", F.pmod(F.xxhash64("bucket", F.lit(i)), F.lit(BANDS)).cast("int")) for i in range(AGAIN)])
        again = held.join(heads.select("id", "bands"), "id").select("id", "n", "label", "bucket", F.explode(F.array_distinct(turn)).alias("band"))
        rows = materialised(again.filter(F.col("bucket") != F.col("band")).select("id", "n", F.xxhash64("bucket", "band").alias("bucket"), "label"))
    open_ = materialised(few_files(held.select("id", "n", "label").distinct()))
    if not open_.isEmpty():
        sets = sets_of(open_)
        pairs, hot = _joined(open_, sets)
        found = _confirm(materialised(pairs.distinct()), sets).union(_linked(held.join(_bounded(hot), "id", "left_semi"), sets))
        found = materialised(few_files(found))
        if not found.isEmpty():
            labels = components(links.union(found))
    named = base.select("id", "n", "digest").join(reps, "digest", "left").join(_bounded(labels.withColumnRenamed("id", "rep")), "rep", "left")
    own = F.when(F.col("n") > 0, F.coalesce("label", "rep", "id")).otherwise(F.col("id"))
    return named.select("id", "n", own.alias("component"))


def _bounded(ids: DataFrame, small: bool = True) -> DataFrame:
    """The written table, broadcast if it is within the bound."""
    ids = materialised(few_files(ids) if small else ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """The rows of ``df`` whose key is the smallest of their component, with all their columns, whatever these are called.

    Rows without a key, and those without words, null and empty texts among them, are kept; rows that share a kept key are kept
    each. Very long texts are compared whole. An empty table gives an empty table.
    """
    found = classes(df, key, text, width).filter((F.col("id") != F.col("component")).eqNullSafe(True)).select("id").distinct()
    spot = [c.lower() for c in df.columns].index(key.lower())
    plain = numbered(df, df.columns).withColumn("id", F.col(f"c{spot}").cast("long"))
    return plain.join(_bounded(found), "id", "left_anti").drop("id").toDF(*df.columns)
