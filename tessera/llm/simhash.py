"""SimHash near-duplicates: 64-bit fingerprints of word shingles, compared bit-sliced.

1. A fingerprint bit is set if it is set in over half of the shingles' hashes. Rows with equal fingerprints form a class, kept
   by its smallest id; all that follows works on classes.
2. Two fingerprints with at most RADIUS differing bits agree in at least one of RADIUS + 1 blocks of bits. Each block's value
   is a bucket. A bucket of over LARGE members is dealt again by blocks of the bits that its members do not share by
   construction, up to DEPTH times: the pigeonhole holds for those as well, so no link is lost.
3. Buckets are compared bit-sliced: 64 members are turned into 64 planes, one word per bit. A member is compared with 64 others at
   once: plane after plane is XORed with the member's bit and added to carry-save counters, which are words too and start so that
   they overflow beyond the radius. Words whose members have all overflowed are abandoned.
4. What is still larger than LARGE after the last deal is cut into slices; each pair of slices is a task of its own, of a fixed size.
5. A task passes on a spanning forest of its links: at most one link per member and comparison, however dense a bucket is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import require
from tessera.llm.neardup import _bounded, components
from tessera.session import materialised

SEED = 42
RADIUS = 3
#: Members up to which a bucket is compared as one; times that a larger one is dealt again; members of a slice of what is left.
LARGE, DEPTH = 4096, 2
#: Planes between two looks at which words are still open; (member, word) comparisons that are made at once.
STEP, AT_ONCE = 8, 1 << 16
_HASHES_AT_ONCE = 1 << 15
_U = np.uint64
_ALL = _U(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str, width: int = 3) -> int:
    """The fingerprint of a text, unsigned. Words are runs of bytes other than the six ASCII blanks, with A-Z lower-cased; a text of
    fewer than ``width`` words is one shingle, one without words has the fingerprint 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = min(width, len(words))
    runs = len(words) - n + 1
    set_in, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, runs, _HASHES_AT_ONCE):
        part = words[at : min(at + _HASHES_AT_ONCE, runs) + n - 1]
        hashes = np.array([digest(b" ".join(s), SEED) for s in zip(*[part[i:] for i in range(n)], strict=False)], dtype="<u8")
        set_in += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > runs, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(id long, fp long: the fingerprint's bits as a signed number) per row of ``df``; a null text has the fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(v.as_py() or "", width) for v in batch.column(1)), dtype=_U, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    return df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "id long, fp long")


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """planes[bit, word]: bit ``lane`` of a word is that bit of fingerprint ``64 * word + lane``; the last word is filled up with zeros."""
    words = -(-len(prints) // 64)
    padded = np.zeros(64 * words, dtype="<u8")
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(words, 64, 8), axis=2, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.transpose(2, 0, 1)), axis=2, bitorder="little").view("<u8").reshape(64, words)


def near_lanes(planes: np.ndarray, prints: np.ndarray, member: np.ndarray, word: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, other) for each item (member, word, lanes): the lanes of the word that differ from the member in at most ``radius`` bits."""
    counters = [np.zeros(len(member), dtype=_U) for _ in range(int(radius).bit_length())]
    first = (1 << len(counters)) - 1 - radius  # so that radius + 1 differences overflow
    for i, c in enumerate(counters):
        if first >> i & 1:
            c[:] = _ALL
    open_, near, mine = np.arange(len(member)), lanes.copy(), prints[member]
    for bit in range(64):
        carry = planes[bit][word] ^ (_U(0) - (mine >> _U(bit) & _U(1)))
        for c in counters:
            kept = c & carry
            c ^= carry
            carry = kept
        near &= ~carry
        if bit % STEP == STEP - 1:
            alive = near != 0
            if not alive.all():
                open_, near, mine, word, counters = open_[alive], near[alive], mine[alive], word[alive], [c[alive] for c in counters]
            if not len(open_):
                break
    hits = np.unpackbits(near.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    item, lane = np.nonzero(hits)
    return member[open_[item]], 64 * word[item] + lane


def _forest(label: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links (one, two) those that join different labels, one for each merge; ``label`` (the root of each member) follows."""
    chosen = [np.zeros((2, 0), dtype=np.int64)]
    while True:
        low, high = np.minimum(label[one], label[two]), np.maximum(label[one], label[two])
        keep = low < high
        one, two, low, high = one[keep], two[keep], low[keep], high[keep]
        if not len(one):
            return tuple(np.concatenate(chosen, axis=1))
        # Every root but the least of its neighbours' takes the least of them as its own; the rest is looked at again.
        order = np.lexsort((low, high))
        at = order[np.unique(high[order], return_index=True)[1]]
        root = np.arange(len(label))
        root[high[at]] = low[at]
        while not np.array_equal(further := root[root], root):
            root = further
        label[:] = root[label]
        chosen.append(np.stack((one[at], two[at])))


def near_pairs(prints: np.ndarray, start: np.ndarray, stop: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between each member i and the members from start[i] to before stop[i], which all lie behind i."""
    planes, label = bit_planes(prints), np.arange(len(prints))
    start = np.minimum(start, stop)
    words = np.where(stop > start, (stop - 1) // 64 - start // 64 + 1, 0)
    done, found = 0, []
    while done < len(prints):
        upto = max(done + 1, int(np.searchsorted(np.cumsum(words[done:]), AT_ONCE, side="right")) + done)
        n = words[done:upto]
        member = np.repeat(np.arange(done, upto), n)
        word = np.arange(len(member)) - np.repeat(np.cumsum(n) - n, n) + start[member] // 64
        low, high = np.maximum(start[member] - 64 * word, 0).astype(_U), np.minimum(stop[member] - 64 * word, 64)
        lanes = (_ALL << low) & (_ALL >> (64 - high).astype(_U))
        found.append(_forest(label, *near_lanes(planes, prints, member, word, lanes, radius)))
        done = upto
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, dtype=np.int64) for i in (0, 1))


def _compared(rows: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) of rows (bucket, side, id, fp), which lie together and in order by bucket and side.

    A row of side 0 is compared with all behind it in its bucket, one of side 1 with those of side 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def links(part: pa.Table) -> pa.RecordBatch:
            bucket, side, ids = (part.column(c).to_numpy() for c in ("bucket", "side", "id"))
            prints = part.column("fp").to_numpy().view(_U)
            new = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            sizes = np.diff(np.r_[new, len(bucket)])
            end = np.repeat(np.r_[new[1:], len(bucket)], sizes)
            twos = np.repeat(np.add.reduceat((side == 2).astype(np.int64), new), sizes)
            start = np.where(side == 0, np.arange(len(bucket)) + 1, np.where(side == 1, end - twos, end))
            one, two = near_pairs(prints, start, end, radius)
            return pa.RecordBatch.from_arrays([pa.array(ids[one]), pa.array(ids[two])], names=["a", "b"])

        for batch in batches:
            whole = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            bucket = whole.column("bucket").to_numpy()
            if not len(bucket):
                continue
            last = int(np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])[-1])
            held = whole.slice(last)  # may go on in the next batch
            if last:
                yield links(whole.slice(0, last).combine_chunks())
        if held is not None and held.num_rows:
            yield links(held.combine_chunks())

    return rows.select("bucket", "side", "id", "fp").mapInArrow(run, "a long, b long")


def _blocks(bits: list[int], n: int) -> list[list[int]]:
    return [bits[len(bits) * i // n : len(bits) * (i + 1) // n] for i in range(n)]


def near_links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between the rows (id, fp) with different fingerprints, enough to connect whatever is within ``radius`` bits."""

    def mask(bits: list[int]) -> int:
        value = sum(1 << b for b in bits)
        return value - (1 << 64) if value >> 63 else value

    # A deal is a list of blocks whose values are shared; its bits are not compared by blocks again.
    deals: list[tuple[list[int], int]] = [([], 0)]
    rows = classes.select("id", "fp", F.lit(0).alias("deal"), F.lit(0).cast("long").alias("bucket"))
    found = []
    for depth in range(DEPTH + 1):
        at, dealt, choices = 0, [], []
        for bits, number in deals:
            free = [b for b in range(64) if b not in bits]
            mine = []
            for block in _blocks(free, radius + 1):
                dealt.append((sorted([*bits, *block]), at))
                mine.append(F.struct(F.lit(at).alias("deal"), F.xxhash64("bucket", F.lit(at), F.col("fp").bitwiseAND(F.lit(mask(block)))).alias("bucket")))
                at += 1
            choices.append((number, F.array(*mine)))
        chosen = choices[0][1]
        for number, blocks in choices[1:]:
            chosen = F.when(F.col("deal") == number, blocks).otherwise(chosen)
        rows = rows.select("id", "fp", F.explode(chosen).alias("to")).select("id", "fp", "to.deal", "to.bucket")
        sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
        many = _bounded(sizes.filter(F.col("size") > LARGE))
        small = rows.join(many, "bucket", "left_anti").select("bucket", F.lit(0).alias("side"), "id", "fp")
        found.append(materialised(_compared(_gathered(small), radius)))
        rows = rows.join(many, "bucket")
        if depth == DEPTH:
            break
        rows, deals = materialised(rows.drop("size")), dealt
    if not rows.isEmpty():
        found.append(materialised(_compared(_gathered(_sliced(rows)), radius)))
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    return links


def _gathered(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket").sortWithinPartitions("bucket", "side")


def _sliced(rows: DataFrame) -> DataFrame:
    """Each row of the buckets (bucket, size) once for every pair of its slice with a slice: the slices have LARGE / 2 members about, so
    a pair of them is of the size that is compared as one, and a bucket of any size is many tasks."""
    slices = F.ceil(F.col("size") * 2 / LARGE).cast("int")
    mine = F.pmod(F.xxhash64("id"), F.col("slices")).cast("int")
    with_all = rows.withColumn("slices", slices).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    return with_all.select(F.xxhash64("bucket", low, high).alias("bucket"), F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).alias("side"), "id", "fp")


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, radius: int = RADIUS) -> DataFrame:
    """(id long, fp long, component long) per row of ``df``.

    Rows are linked if their fingerprints differ in at most ``radius`` bits; ``component`` is the smallest id reachable over links,
    itself included. Null and empty texts, and those without words, have the fingerprint 0 and are linked like any other. Rows
    that share a key share a component. A row without a key is not
    linked, and has no component. Texts are read whole. Other columns are not read, whatever their names. An empty table gives an
    empty result. The key is read as a long.
    """
    require(df, key, text)
    base = materialised(fingerprints(df, key, text, width))
    reps = materialised(base.filter("id is not null").groupBy("fp").agg(F.min("id").alias("rep")))
    links = near_links(reps.select(F.col("rep").alias("id"), "fp"), radius)
    # A key with several texts links their classes.
    several = base.groupBy("id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("id is not null and lo < hi").select("id")
    same_key = base.join(_bounded(several), "id", "left_semi").join(reps, "fp").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    links = links.union(same_key)
    labels = _bounded(components(links).withColumnRenamed("id", "rep"))
    named = materialised(reps.join(labels, "rep", "left").select("fp", F.coalesce("label", "rep").alias("component")))
    out = base.join(_bounded(named), "fp", "left")
    return out.select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))
