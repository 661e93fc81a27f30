"""Text predicates and tokenising, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: White space of any script, as Java and RE2 both read it.
BLANK = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Anything else: a text with none of it is blank.
INK = BLANK.replace("[", "[^", 1)
ENDS = f"^{BLANK}+|{BLANK}+$"
#: What ends a line, as ``str.splitlines`` reads it.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
WORD = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+"


def tokens(text: Column) -> Column:
    """Lower-cased identifier runs and digit runs in order, each followed by its snake_case and camelCase parts.

    A part that equals the whole is not repeated. Boundaries are marked by replacement on the original spelling, which
    needs no lookaround, then split.
    """
    marked = lambda w: F.regexp_replace(F.regexp_replace(F.translate(w, "_", " "), r"([A-Z]+)([A-Z][a-z])", "$1 $2"), r"([a-z0-9])([A-Z])", "$1 $2")
    parts = lambda w: F.filter(F.transform(F.split(marked(w), " "), F.lower), lambda p: (p != "") & (p != F.lower(w)))
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"))
    return F.flatten(F.transform(words, lambda w: F.concat(F.array(F.lower(w)), parts(w))))


_CAPITALS, _HUMP, _SEAM = re.compile(r"([A-Z]+)([A-Z][a-z])"), re.compile(r"([a-z0-9])([A-Z])"), re.compile(r"_|[A-Z]{2}[a-z]|[a-z0-9][A-Z]")
words = re.compile(WORD).findall


def tokens_of(word: str) -> tuple[str, ...]:
    """What ``tokens`` makes of one word, for tasks that count words first and need this once for each distinct one."""
    whole = word.lower()
    if not _SEAM.search(word):
        return (whole,)
    parts = _HUMP.sub(r"\1 \2", _CAPITALS.sub(r"\1 \2", word.replace("_", " "))).lower().split(" ")
    return (whole, *(p for p in parts if p not in ("", whole)))


def is_binary(text: Column) -> Column:
    """A NUL, or more replacement characters than one in a hundred (and than one)."""
    odd = F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))
    return text.contains("\x00") | (odd > F.greatest(F.lit(1.0), F.length(text) / 100))


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def text_lines(text: Column) -> Column:
    """The lines of a text without their ends; an end that closes the text begins no further line."""
    return F.split(F.regexp_replace(text, f"(?:{LINE_END})\\z", ""), LINE_END)


def matches_any(column: Column, patterns, ignore_case: bool = False) -> Column:
    """One literal predicate per pattern: a literal pattern is compiled once per task."""
    out = F.lit(False)
    for pattern in patterns:
        out = out | column.rlike(("(?i)" if ignore_case else "") + pattern)
    return out


def first_match(column: Column, patterns, flags: str = "") -> Column:
    """The match of the first pattern that has one; null without any."""
    found = [F.when(column.rlike(flags + p), F.regexp_extract(column, f"{flags}({p})", 1)) for p in patterns]
    return F.coalesce(*found)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory(path: Column) -> Column:
    """Empty at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def truncated(text: Column, limit: int, note: str = "") -> Column:
    """The head of a text that is longer than ``limit``, with a note; shorter ones as they are."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(note))).otherwise(text)


def stripped(text: Column) -> Column:
    """Without white space at either end; Spark's ``trim`` takes blanks only."""
    return F.regexp_replace(text, ENDS, "")
