"""Document fingerprints by a homomorphic multiset hash, in DataFrame functions only.

Each paragraph (a line) is hashed to a wide vector; a document's fingerprint is the sum of its paragraphs' vectors, each lane
modulo a power of two. The order of paragraphs does not matter, and fingerprints of disjoint parts add up, so paragraphs can
be inserted or deleted by adding or subtracting theirs.

``wide`` has 16 lanes modulo 2^32 over whole paragraphs: equal exactly if the multisets of paragraphs are (up to a hash of
512 bits). ``marks`` has 66 lanes modulo 2^32 over clauses (paragraphs cut after punctuation), each of a Cauchy distribution. Sums
of Cauchy values are Cauchy, scaled by the sum of the weights' sizes; so the median size of two documents' differences in the
lanes is the number of clauses, each counted with its copies, that only one of them has (Indyk, "Stable distributions,
pseudorandom generators, embeddings, and data stream computation"), which gives their likeness.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.common import require, without

#: Hashes of a paragraph, two lanes each; hashes of a clause, three lanes of 20 bits each; units in a mark of 1.
WIDE_HASHES, MARK_HASHES, UNIT = 8, 22, 32
LANES = 3 * MARK_HASHES
#: Rows of a key range, and ranges at most; a range is sorted in one task, which spills if it must.
RANGE_ROWS, MAX_RANGES = 512, 16384
_LOW32 = 0xFFFFFFFF


def _signed(value: Column, bits: int) -> Column:
    """The residue modulo 2^bits nearest to 0."""
    half = 1 << (bits - 1)
    return (value + half).bitwiseAND((1 << bits) - 1) - half


def _sum(hashes: Column, part) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda total, h: total + part(h))


def _hashes(column: str, seed: int) -> Column:
    """The seed goes first: it seeds the hash of the text. (A second parameter of the function would be the element's index.)"""
    return F.transform(column, lambda x: F.xxhash64(F.lit(seed), x))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds struct ``out`` (n int, wide array<int>, marks array<int>) for a text column.

    A null text counts as empty, which is one empty paragraph. Very long texts are read whole; equal ones have equal
    fingerprints. A column named ``out`` is replaced. An empty table gives an empty table.
    """
    names = without(df, [out])
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
    kept = [f"c{i}" for i in range(len(names))]
    lines = df.select(*columns, F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("__lines"))
    units = lines.withColumn("__units", F.flatten(F.transform("__lines", lambda x: F.split(x, "(?<=[.!?,;:|] )"))))
    hashed = units.withColumns({f"__w{j}": _hashes("__lines", j) for j in range(WIDE_HASHES)} | {"__unit": _hashes("__units", WIDE_HASHES)})
    hashed = hashed.withColumns({f"__m{j}": _hashes("__unit", WIDE_HASHES + 1 + j) for j in range(MARK_HASHES)})
    wide = [_signed(_sum(F.col(f"__w{j}"), part), 32).cast("int") for j in range(WIDE_HASHES) for part in (lambda h: h.bitwiseAND(_LOW32), lambda h: F.shiftrightunsigned(h, 32))]
    marks = [_signed(_sum(F.col(f"__m{j}"), lambda h, k=k: _mark(F.shiftrightunsigned(h, k).bitwiseAND(0xFFFFF))), 32).cast("int") for j in range(MARK_HASHES) for k in (0, 21, 42)]
    return hashed.select(*kept, F.struct(F.size("__units").alias("n"), F.array(*wide).alias("wide"), F.array(*marks).alias("marks")).alias(out)).toDF(*names, out)


def _mark(bits: Column) -> Column:
    """A Cauchy value in units: the tangent of as many radians, which lie evenly modulo pi."""
    return (F.tan(bits) * UNIT).cast("long")


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of two documents' paragraphs together (sign 1), or of ``a`` without the paragraphs of ``b`` (sign -1)."""
    wide = F.zip_with(a["wide"], b["wide"], lambda x, y: _signed(x.cast("long") + sign * y.cast("long"), 32).cast("int"))
    marks = F.zip_with(a["marks"], b["marks"], lambda x, y: _signed(x.cast("long") + sign * y.cast("long"), 32).cast("int"))
    return F.struct((a["n"] + sign * b["n"]).alias("n"), wide.alias("wide"), marks.alias("marks"))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the estimated share of clauses, each counted with its copies, that two fingerprints have in common; 1 for equal ones.

    The number of clauses that only one text has is estimated with a standard error of 19 %.
    """
    sizes = F.array_sort(F.zip_with(a["marks"], b["marks"], lambda x, y: F.abs(_signed(x.cast("long") - y.cast("long"), 32))))
    apart = (F.get(sizes, F.lit(LANES // 2 - 1)) + F.get(sizes, F.lit(LANES // 2))) / (2.0 * UNIT)
    return F.greatest(F.lit(0.0), 1 - apart / F.greatest(a["n"] + b["n"], F.lit(1)))


def text_of(fingerprint: Column) -> Column:
    """Lowercase hex: the count, then the wide lanes, then the marks."""
    hexed = lambda x, bits: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND((1 << bits) - 1))), bits // 4, "0")
    return F.concat(
        hexed(fingerprint["n"], 32),
        F.array_join(F.transform(fingerprint["wide"], lambda x: hexed(x, 32)), ""),
        F.array_join(F.transform(fingerprint["marks"], lambda x: hexed(x, 32)), ""),
    )


def with_next(df: DataFrame, key: str, columns: list[str], tie: str) -> DataFrame:
    """Adds struct ``next`` of ``columns`` of the following row by descending ``key``; the last row is followed by the first.

    Equal keys are ordered by ``tie``. A row without a key has no place in the order and is followed by itself. Rows are
    dealt into ranges of the key, whose ends are keys of the table; the row at an end is also sent to the range before,
    where it closes the order. So each row moves once, whatever the distribution of keys, and no task sees all of them.
    """
    rows = df.count()
    parts = max(1, min(MAX_RANGES, rows // RANGE_ROWS))
    shares = [i / parts for i in range(1, parts)] + [1.0]
    ends = df.select(F.percentile_approx(F.col(key).cast("long"), shares, 4 * parts + 1000)).first()[0] or []
    ends = sorted(set(ends))
    if not ends:
        return df.withColumn("next", F.struct(*columns))
    table = F.lit(np.asarray(ends, dtype=np.int64))
    span = F.struct(F.lit(0).alias("lo"), F.lit(len(ends) - 1).alias("hi"))

    def halve(state: Column, _: Column) -> Column:  # the first end that is not below the key
        middle = F.shiftright(state["lo"] + state["hi"], 1)
        below = F.get(table, middle) < F.col("__key")
        return F.struct(F.when(below, F.least(middle + 1, state["hi"])).otherwise(state["lo"]).alias("lo"), F.when(below, state["hi"]).otherwise(middle).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(len(ends).bit_length() + 1))
    keyed = df.withColumn("__key", F.col(key).cast("long")).withColumn("__range", F.aggregate(steps, span, halve, lambda s: s["lo"]))
    is_end = F.get(table, F.col("__range")) == F.col("__key")
    here = F.struct(F.when(F.col("__key").isNull(), -1 - F.pmod(F.xxhash64(tie), F.lit(parts))).otherwise(F.col("__range")).cast("int").alias("range"), F.lit(False).alias("closing"))
    before = F.struct(F.pmod(F.col("__range") + 1, F.lit(len(ends))).cast("int").alias("range"), F.lit(True).alias("closing"))
    dealt = keyed.withColumn("__at", F.explode(F.when(is_end, F.array(here, before)).otherwise(F.array(here)))).withColumns({"__range": F.col("__at.range"), "__closing": F.col("__at.closing")}).drop("__at")
    order = Window.partitionBy("__range").orderBy("__closing", F.desc("__key"), tie)
    own = F.struct(*columns)
    led = dealt.withColumn("next", F.when(F.col("__key").isNull(), own).otherwise(F.lead(own).over(order)))
    return led.filter(~F.col("__closing")).drop("__key", "__range", "__closing")


def fingerprint_edits(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds to key and text: fp, next (text, fp), edited (text) and edited_fp.

    The edited text replaces the last half of a text's code points by as many of the next row's first ones, or all it has.
    Null texts are read as empty; other columns are not read. An empty table gives an empty result.
    """
    require(df, key, text)
    plain = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    followed = with_next(with_fingerprint(plain, "text", "fp"), "key", ["text", "fp"], "text")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = followed.withColumn("edited", F.concat(F.col("text").substr(F.lit(1), F.length("text") - half), F.col("next.text").substr(F.lit(1), half)))
    return with_fingerprint(edited, "edited", "edited_fp").withColumnRenamed("key", key)
