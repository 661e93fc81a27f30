"""URL verdicts: host and path rules, else exact list membership by a cascade of Bloom filters, without joins.

Level 1 holds the listed keys; level 2 holds the unlisted keys of the universe that level 1 lets pass, level 3 the listed
ones that level 2 lets pass, and so on until no key is left over. A key of the universe is listed exactly if the first level
that rejects it has an even number, or none does after an odd number of levels.

The universe (the corpus's distinct keys) never leaves the executors; only filter bits do. They are packed into longs and
stand in the plan as literals. Their size follows the list, and is checked against ``max_bytes``: a larger list is
judged by a semi-join instead, with the same result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.common import numbered, require, without
from tessera.session import few_files, materialised

#: Longest wins: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Bits of all levels together, in bytes, that may stand in a plan.
MAX_BYTES = 16 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the url's or a parent domain and whose path begins the url's; else nulls."""
    rule = verdict = None
    for name, start, says in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule = F.when(fits, name + start) if rule is None else rule.when(fits, name + start)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return rule, verdict


def _positions(key: Column, level: int, hashes: int, bits: int) -> list[Column]:
    """The level and the hash's number go first: they seed the hash of the key."""
    return [F.pmod(F.xxhash64(F.lit(level), F.lit(j), key), F.lit(bits).cast("long")) for j in range(hashes)]


class Level:
    """One Bloom filter: its bits in 64-bit words."""

    def __init__(self, number: int, hashes: int, words: list[int]):
        self.number, self.hashes, self.words = number, hashes, words

    def passes(self, key: Column) -> Column:
        filled = F.lit(np.asarray(self.words, dtype=np.int64))  # one literal, however long
        test = None
        for at in _positions(key, self.number, self.hashes, 64 * len(self.words)):
            word = F.get(filled, F.shiftright(at, 6).cast("int"))
            bit = F.getbit(word, (at % 64).cast("int")) == 1
            test = bit if test is None else test & bit
        return test


def _level(keys: DataFrame, n: int, number: int, rate: float) -> Level:
    """A filter for the ``n`` keys with the given rate of false positives."""
    bits = 64 * max(1, math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 64))
    hashes = max(1, round(-math.log2(rate)))
    spots = keys.select(F.explode(F.array(*_positions(F.col("key"), number, hashes, bits))).alias("at"))
    rows = spots.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("bits"))
    words = [0] * (bits // 64)
    for row in rows.toLocalIterator():
        words[row["word"]] = row["bits"]
    return Level(number, hashes, words)


class Cascade:
    """Exact membership for the keys of a universe. ``levels`` is empty if nothing is listed."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    @property
    def size(self) -> int:
        return sum(8 * len(level.words) for level in self.levels)

    def contains(self, key: Column) -> Column:
        """True or false for any key of the universe; for others, as for a Bloom filter, perhaps a false true. Null for null."""
        found = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            found = F.when(self.levels[i].passes(key), found).otherwise(F.lit(i % 2 == 1))
        return F.when(key.isNotNull(), found)


def build_cascade(universe: DataFrame, max_bytes: int = MAX_BYTES) -> Cascade | None:
    """From (key string, listed boolean), one row per distinct key. None if the filters would exceed ``max_bytes``.

    Levels are salted by their number, so each holds about half of the false positives of the one before; the loop ends when
    none is left. Null keys are left out. The universe should be a written table, as each level reads it.
    """
    keys = universe.filter(F.col("key").isNotNull())
    sizes = {row["listed"]: row["count"] for row in keys.groupBy("listed").count().collect()}
    listed, others = sizes.get(True, 0), sizes.get(False, 0)
    if not listed:
        return Cascade([])
    first = min(0.5, max(1e-9, listed * math.sqrt(0.5) / max(1, others)))
    if listed * -math.log(first) / math.log(2) ** 2 / 8 * 2 > max_bytes:
        return None
    levels = [_level(keys.filter("listed"), listed, 1, first)]
    remain = {True: keys.filter("listed"), False: keys.filter("not listed")}
    while True:
        side = len(levels) % 2 == 0  # whom the next level holds: those of the other side that the last lets pass
        remain[side] = remain[side].filter(levels[-1].passes(F.col("key")))
        n = remain[side].count()
        if not n:
            return Cascade(levels)
        levels.append(_level(remain[side], n, len(levels) + 1, 0.5))


def listed_hosts(pages: DataFrame, labels: str, url: str = "url", html: str = "html") -> DataFrame:
    """(key): the distinct hosts of ``pages`` that go on the block list.

    A host is listed if one of its labels matches ``labels``, or if its pages together show less text than markup: tags,
    scripts and styles are more than half of their characters. Pages without a text count nothing. An empty table lists nothing.
    """
    shown = F.length(F.regexp_replace(F.col(html), r"(?s)<script.*?</script>|<style.*?</style>|<[^>]*>", ""))
    sums = pages.groupBy(host_of(F.col(url)).alias("key")).agg(F.sum(F.length(F.col(html))).alias("whole"), F.sum(shown).alias("shown"))
    return sums.filter(F.col("key").rlike(labels) | F.coalesce(2 * F.col("shown") < F.col("whole"), F.lit(False))).select("key")


def judge(pages: DataFrame, listed: DataFrame, url: str = "url", rules=RULES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Adds host, path, rule (null: none fits) and verdict (allow or block).

    ``listed`` (key) is the block list; a key that it repeats, or that no page has, or null, changes nothing. The universe is
    the distinct hosts of ``pages``; a host of it is blocked exactly if it is listed. The list meets the universe once, to
    build the cascade; pages are judged by the cascade alone. A null url, or one without ``://``, has an empty host and path,
    which no rule fits and which is a key like any other. Very long urls are read whole. Columns of ``pages`` named like an
    output are replaced; repeated rows are judged each; an empty table gives an empty result.
    """
    require(pages, url)
    kept = without(pages, ["host", "path", "rule", "verdict"])
    held = numbered(pages, kept)
    spot = F.col("c" + str([c.lower() for c in kept].index(url.lower())))
    parts = held.select("*", host_of(spot).alias("host"), path_of(spot).alias("path"))
    marked = parts.select(F.col("host").alias("key"), F.lit(False).alias("listed"), F.lit(True).alias("here")).unionByName(listed.select("key", F.lit(True).alias("listed"), F.lit(False).alias("here")))
    universe = marked.groupBy("key").agg(F.max("listed").alias("listed"), F.max("here").alias("here")).filter("here").select("key", "listed")
    universe = materialised(few_files(universe))
    cascade = build_cascade(universe, max_bytes)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parts.withColumns({"rule": rule, "__said": verdict})
    if cascade is None:  # a list beyond the bound: the same answer by a join
        names = universe.filter("listed").select(F.col("key").alias("host"), F.lit(True).alias("__hit"))
        ruled, member = ruled.join(names, "host", "left"), F.coalesce(F.col("__hit"), F.lit(False))
    else:
        member = cascade.contains(F.col("host"))
    told = ruled.select(*held.columns, "host", "path", "rule", F.coalesce("__said", F.when(member, "block").otherwise("allow")).alias("verdict"))
    return told.toDF(*kept, "host", "path", "rule", "verdict")
