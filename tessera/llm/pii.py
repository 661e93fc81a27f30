"""PII: detected entities get keyed, type-consistent surrogates.

A surrogate keeps its entity's format: digits stay digits, letters keep their case, separators stay, check digits are valid,
addresses stay addresses, and names keep gender (the title's) and script (their own letters'). It is a keyed permutation of the entities of one format (names:
a keyed hash), so without the key it can't be undone, and the same entity gets the same surrogate in every document.

Names are replaced part by part, whatever their case, and a document's titled names also in all its mentions without a title, before
and behind; phone numbers and cards by their digits, whatever the punctuation. So different spellings of one entity agree.
A part that stands alone is no mention if it is a month or a day, or if it begins a sentence and the text also has it in lower case.

A corpus-wide check makes the entities' table and draws again, with another attempt number, for every entity whose surrogate
equals an entity of the corpus or another's surrogate, until no such case is left. Names and e-mail addresses grow with the
attempt; where another format's values are all taken (ATTEMPTS draws found none free), the entity is masked and a warning tells how many.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
import unicodedata
import warnings
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tessera.llm.common import map_rows, numbered, require, without
from tessera.session import dropped, few_files, materialised

#: Draws of an entity at most; draws of a round, which grow from the round GROWS on, and attempts by which names get a syllable more.
ATTEMPTS, GROWS, LONGER = 4096, 8, 2
#: Forms of address by gender.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Signora", "г-жа", "госпожа", "κυρία"),
    "m": ("Mr", "Mister", "Herr", "Monsieur", "Señor", "Signor", "г-н", "господин", "κύριος"),
}
_TITLE = {title: gender for gender, titles in TITLES.items() for title in titles}
_ANY_TITLE = "|".join(sorted(map(re.escape, _TITLE), key=len, reverse=True))
#: Syllables of surrogate names by script, and the endings of first names by gender. Names in other scripts are written in the first.
SYLLABLES = {
    "latin": ("ba", "be", "do", "fa", "ga", "ka", "ke", "la", "le", "li", "ma", "me", "mi", "na", "ne", "no", "ra", "re", "ri", "ro", "sa", "se", "ta", "te", "ti", "to", "va", "ve", "vi", "zo", "da", "lu"),
    "cyrillic": ("ба", "бе", "до", "фа", "га", "ка", "ке", "ла", "ле", "ли", "ма", "ме", "ми", "на", "не", "но", "ра", "ре", "ри", "ро", "са", "се", "та", "те", "ти", "то", "ва", "ве", "ви", "зо", "да", "лу"),
    "greek": ("βα", "βε", "δο", "φα", "γα", "κα", "κε", "λα", "λε", "λι", "μα", "με", "μι", "να", "νε", "νο", "ρα", "ρε", "ρι", "ρο", "σα", "σε", "τα", "τε", "τι", "το", "βο", "βι", "ζο", "δα", "λυ", "πε"),
    "cjk": tuple("安白成春大方光海和华吉江金兰林明宁平青仁山石水天文西小星雪永玉云"),
    "hangul": tuple("가나다라마바사아자차하고노도로모보소오조호구누두루무부수우주후기"),
    "katakana": tuple("アイウエカキクケサシスセタチツテナニネノハヒフヘマミムメラリルレ"),
    "hiragana": tuple("あいうえかきくけさしすせたちつてなにねのはひふへまみむめらりるれ"),
    "arabic": ("با", "بي", "تا", "تي", "جا", "حا", "دا", "دي", "را", "ري", "زا", "سا", "سي", "شا", "صا", "طا", "عا", "غا", "فا", "في", "قا", "كا", "كي", "لا", "لي", "ما", "مي", "نا", "ني", "ها", "وا", "يا"),
    "hebrew": ("בא", "בי", "גא", "גי", "דא", "די", "הא", "וא", "זא", "זי", "חא", "טא", "יא", "כא", "כי", "לא", "לי", "מא", "מי", "נא", "ני", "סא", "סי", "עא", "פא", "פי", "צא", "קא", "רא", "רי", "שא", "תא"),
}
ENDINGS = {
    "latin": ("na", "n"), "cyrillic": ("на", "н"), "greek": ("να", "ς"), "cjk": ("娜", "龙"), "hangul": ("희", "준"), "katakana": ("コ", "ロウ"), "hiragana": ("こ", "ろう"), "arabic": ("ة", "ن"), "hebrew": ("ית", "ן"),
}
_CAP = r"[^\W\d_a-zа-яα-ω]"
_NAME = rf"(?:{_CAP}[^\W\d_]*(?:['’-]{_CAP}[^\W\d_]+)+|{_CAP}[^\W\d_]+)"
_PART = re.compile(r"[^\W\d_]+")
_WORD, _SENTENCE = re.compile(r"\w+"), re.compile(r"(?:^|[.!?:;\n\"“«(])\s*$")
#: Words that are names and dates.
CALENDAR = frozenset(
    "January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday "
    "Januar Februar März Mai Juni Juli Oktober Dezember Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonntag Abril Junio Julio Avril Juin Juillet".split()
)
#: Country codes of phone numbers, by their first digits.
_COUNTRY = re.compile(r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}")
#: In order of priority; a later kind leaves alone what an earlier one has taken. The entity is group 1.
PATTERNS = {
    "secret": re.compile(r"""\b(?:token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key)\s*[=:]\s*["']?([A-Za-z0-9_+/-]{8,})""", re.I),
    "key": re.compile(r"\b((?:AKIA|ASIA)[A-Z0-9]{16})\b"),
    "email": re.compile(r"(?<![\w.+-])([A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"),
    "iban": re.compile(r"\b([A-Z]{2}\d{2}[A-Z0-9]{11,30})\b"),
    "ip": re.compile(r"(?<![\d.])(\d{1,3}(?:\.\d{1,3}){3})(?!\d|\.\d)"),
    "card": re.compile(r"(?<![\d-])(\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|\d{4}[ -]?\d{6}[ -]?\d{5})(?!\d)"),
    "phone": re.compile(r"(?<![\d+])(\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?!\d)"),
    "ssn": re.compile(r"(?<![\d-])(\d{3}-\d{2}-\d{4})(?![\d-])"),
    "person": re.compile(rf"(?<!\w)(?:{_ANY_TITLE})\.? ((?:{_CAP}\. ?){{0,3}}{_NAME}(?: (?:{_NAME}|{_CAP}\.(?= {_CAP}))){{0,2}})"),
}
#: What a text must have for any of the patterns: a digit of any script, an at sign, an assignment, a key's head, or a title. Decided
#: before a row leaves the JVM. Characters beyond 16 bits pass: the JVM may not know the latest digits among them.
PREFILTER = rf"[0-9@=:]|A(?:KIA|SIA)|[\p{{Nd}}\x{{10000}}-\x{{10FFFF}}]|(?=[{''.join(sorted({t[0] for t in _TITLE}))}])(?:{_ANY_TITLE})\.? "


def plain(text: str) -> str:
    """With the digits of any script as 0 to 9."""
    return text if text.isascii() else "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in text)


def _digits_like(digit: str, old: str) -> str:
    """The digit in the script of the digit ``old``."""
    return chr(ord(old) - unicodedata.decimal(old) + int(digit))


def luhn_digit(digits: str) -> str:
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _valid(kind: str, value: str) -> bool:
    value = plain(value)
    if kind == "card":
        digits = re.sub(r"\D", "", value)
        issued = digits[0] in "3456" or "2221" <= digits[:4] <= "2720"
        return issued and 13 <= len(digits) <= 19 and luhn_digit(digits[:-1]) == digits[-1]
    if kind == "ip":
        return all(int(x) < 256 for x in value.split("."))
    if kind == "iban":
        return _mod97(value[4:] + value[:4]) == 1
    return kind != "phone" or 7 <= sum(c.isdigit() for c in value) <= 15


@functools.lru_cache(maxsize=1 << 16)
def script_of(word: str) -> str:
    """The script of a word's first letter, by its Unicode name."""
    head = unicodedata.name(word[0], "").split(" ")[0].split("-")[0].lower()
    return head if head in SYLLABLES else "latin"


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of a text's entities in order, not overlapping. A person's kind also has the gender.

    Each kind's matches are in order and so is what earlier kinds took, so one pass over both finds the overlaps.
    """
    found: list[tuple[int, int, str, str]] = []
    for kind, pattern in PATTERNS.items():
        at, fresh = 0, []
        for m in pattern.finditer(text):
            start, end = m.span(1)
            while at < len(found) and found[at][1] <= start:
                at += 1
            if (at == len(found) or found[at][0] >= end) and _valid(kind, m[1]):
                full = kind if kind != "person" else "person:" + _TITLE[m[0][: m.start(1) - m.start(0)].rstrip(" .")]
                fresh.append((start, end, full, m[1]))
        found = sorted(found + fresh) if fresh else found
    return sorted(found + _mentions(text, found))


def _mentions(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """The mentions, without a title, of words and hyphenated parts of the names among ``found``, wherever they stand. A part that
    several names have is the first one's."""
    first: dict[str, str] = {}
    for *_, kind, value in sorted(x for x in found if x[2].startswith("person")):
        for word in value.split(" "):
            for part in {word, *_PART.findall(word)}:
                if not _is_initial(part) and not part.endswith("."):
                    for spelled in (part, part.upper()):
                        first.setdefault(spelled, kind)
    if not first:
        return []
    word = "(?:" + "|".join(map(re.escape, sorted(first, key=len, reverse=True))) + ")"
    taken, more, words = sorted((a, b) for a, b, _, _ in found), [], None
    starts = [a for a, _ in taken]
    for m in re.finditer(rf"(?<!\w){word}(?:[ -]{word})*(?!\w)", text):
        at = bisect.bisect_left(starts, m.end())
        if at and taken[at - 1][1] > m.start():
            continue
        if m[0] in first:  # alone
            if m[0] in CALENDAR:
                continue
            if m[0].lower() != m[0] and _SENTENCE.search(text, max(0, m.start() - 8), m.start()):
                words = words or set(_WORD.findall(text))
                if m[0].lower() in words:
                    continue
        more.append((*m.span(), first[re.match(word, m[0])[0]], m[0]))
    return more


def entities_of(kind: str, value: str) -> list[tuple[str, str]]:
    """(kind, plain form) of what gets a surrogate: of a person, each part of the name but initials, in lower case, the kind with its script; of a phone
    number, all digits with the country's; of a card, its digits. Digits of any script are 0 to 9."""
    if kind.startswith("person"):
        return [(f"{kind}:{script_of(part)}", part.lower()) for part in _PART.findall(value) if not _is_initial(part)]
    if kind in ("phone", "card"):
        digits = "".join(c for c in plain(value) if c.isdigit())
        return [(kind, digits if kind == "card" or value[0] == "+" else "1" + digits)]
    return [(kind, plain(value))]


def _is_initial(part: str) -> bool:
    """A lone letter of a script that has capitals; in others one letter may be a whole name."""
    return len(part) == 1 and part.lower() != part.upper()


@functools.lru_cache(maxsize=64)
def _cycle(key: bytes, kind: str, letters: str) -> dict[str, str]:
    """Each letter's successor in a keyed order of all: a known pair tells no other one."""
    order = sorted(letters, key=lambda c: hashlib.blake2b(f"{kind}|initial|{c}".encode(), key=key, digest_size=16).digest())
    return dict(zip(order, order[1:] + order[:1], strict=True))


def _initial(key: bytes, kind: str, letter: str) -> str:
    """Another letter of the alphabet; different letters of an alphabet get different ones."""
    letters = {"cyrillic": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ", "greek": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"}.get(script_of(letter), _CLASSES[2])
    cycle = _cycle(key, kind, letters)
    return cycle.get(letter) or cycle[letters[ord(letter) % len(letters)]]


def initials_of(values: list[tuple[str, str]], known: dict[tuple[str, str], str | None]) -> dict[tuple[str, str, str], str]:
    """(kind, initial, surname in lower case): the initial of the surrogate, for the names (kind, value) of a text that are written out."""
    out: dict[tuple[str, str, str], str] = {}
    for kind, value in values:
        parts = _PART.findall(value) if kind.startswith("person") else []
        for part in parts[:-1]:
            new = None if _is_initial(part) else known.get((f"{kind}:{script_of(part)}", part.lower()))
            if new:
                out.setdefault((kind, part[0], parts[-1].lower()), new[0].upper())
    return out


def _masked(text: str) -> str:
    return "".join("*" if c.isalnum() else c for c in text)


def laid(key: bytes, kind: str, value: str, known: dict[tuple[str, str], str | None], initials: dict[tuple[str, str, str], str] | None = None) -> str:
    """The surrogate of a found value, in its spelling, from those of its ``entities_of``; stars for one that has none."""
    if kind.startswith("person"):
        surname = (_PART.findall(value) or [""])[-1].lower()

        def part(m: re.Match) -> str:
            if _is_initial(m[0]):
                return (initials or {}).get((kind, m[0], surname)) or _initial(key, kind, m[0])
            new = known[f"{kind}:{script_of(m[0])}", m[0].lower()]
            return _masked(m[0]) if new is None else new.upper() if m[0].isupper() and len(m[0]) > 1 else new.capitalize()

        return _PART.sub(part, value)
    new = known[entities_of(kind, value)[0]]
    if new is None:
        return _masked(value)
    if kind in ("phone", "card"):
        digits = iter(new[-sum(c.isdecimal() for c in value) :])
        return "".join(_digits_like(next(digits), c) if c.isdecimal() else c for c in value)
    if value.isascii():
        return new
    if kind == "ip":
        return "".join(_digits_like(c, value[0]) if c.isdigit() else c for c in new)
    return "".join(_digits_like(c, old) if c.isdigit() and old.isdecimal() else c for c, old in zip(new, value, strict=True))


def _permuted(key: bytes, label: str, number: int, size: int) -> int:
    """A keyed permutation of 0 to size-1: a Feistel network over the next even number of bits, walked until it is in range."""
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    while True:
        left, right = number >> half, number & mask
        for turn in range(8):
            seed = f"{label}|{turn}|{right:x}".encode()
            drawn = b"".join(hashlib.blake2b(seed + bytes([part]), key=key, digest_size=32).digest() for part in range(-(-width // 32)))
            left, right = right, left ^ (int.from_bytes(drawn[:width]) & mask)
        number = left << half | right
        if number < size:
            return number


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_HEX = ("0123456789abcdef", "0123456789ABCDEF")


def _reshaped(key: bytes, label: str, text: str, alphabets: tuple[str, ...] = _CLASSES) -> str:
    """Permutes the texts of one format: each character of an alphabet stays in it, any other stays as it is."""
    spots = [(i, next((a for a in alphabets if c in a), None)) for i, c in enumerate(text)]
    number, size, form = 0, 1, []
    for i, alphabet in spots:
        form.append(text[i] if alphabet is None else str(alphabets.index(alphabet)))
        if alphabet:
            number, size = number * len(alphabet) + alphabet.index(text[i]), size * len(alphabet)
    if size == 1:
        return text
    number = _permuted(key, f"{label}|{''.join(form)}", number, size)
    out = list(text)
    for i, alphabet in reversed(spots):
        if alphabet:
            number, digit = divmod(number, len(alphabet))
            out[i] = alphabet[digit]
    return "".join(out)


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The replacement of an entity in its plain form. For one key and attempt, different entities of a kind but ``person`` differ in theirs."""
    label = f"{kind}|{attempt}"
    if kind == "email":
        local, _, domain = value.rpartition("@")
        name, _, top = domain.rpartition(".")
        return _reshaped(key, label, f"{local}{'a' * min(attempt // GROWS, 16)}@{name}") + "." + top
    if kind == "ip":
        number = 0
        for part in value.split("."):
            number = number * 256 + int(part)
        number = _permuted(key, label, number, 1 << 32)
        return ".".join(str(number >> s & 255) for s in (24, 16, 8, 0))
    if kind == "card":
        digits = re.sub(r"\D", "", value)
        made = digits[:4] + _reshaped(key, f"{label}|{digits[:4]}", digits[4:-1])
        made = iter(made + luhn_digit(made))
        return "".join(next(made) if c.isdigit() else c for c in value)
    if kind == "iban":
        made = _reshaped(key, label + value[:2], value[4:], ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        return value[:2] + f"{98 - _mod97(made + value[:2] + '00'):02d}" + made
    if kind == "phone":
        head = _COUNTRY.match(value)[0]
        return head + _reshaped(key, label + head, value[len(head) :])
    if kind == "key":
        return value[:4] + _reshaped(key, label + value[:4], value[4:], (_CLASSES[2] + _CLASSES[0],))
    if kind == "secret":
        alphabets = next(((a,) for a in _HEX if all(c in a for c in value)), _CLASSES)
        return _reshaped(key, label + alphabets[0], value, alphabets)
    if kind.startswith("person:"):
        _, gender, script = kind.split(":")
        syllables, parts = SYLLABLES[script], []
        drawn = int.from_bytes(hashlib.blake2b(f"{label}|{value}".encode(), key=key, digest_size=64).digest())
        for _ in range((2 if script == "cjk" else 3) + min(attempt // LONGER, 8)):
            drawn, digit = divmod(drawn, len(syllables))
            parts.append(syllables[digit])
        return "".join(parts) + ENDINGS[script][gender == "m"]
    return _reshaped(key, label, value)


def _assigned(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, attempt) with its ``surrogate``."""

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple]:
        for kind, value, attempt in rows:
            yield (surrogate(key, kind, value, attempt),)

    return map_rows(entities, ["kind", "value", "attempt"], [T.StructField("surrogate", T.StringType())], kernel)


def resolve(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, surrogate) for distinct (kind, value): no surrogate is an entity or another's surrogate.

    Only the entities that are in conflict are drawn again in each round. Of those that share a surrogate, the least by kind
    and value, and any that was settled in an earlier round, keeps it. Where no free surrogate is found, it is null, and a warning tells.
    """
    real = entities.select(F.col("value").alias("surrogate")).distinct()
    settled, open_, begun = None, entities.select("kind", "value"), 0
    while begun < ATTEMPTS:
        draws = 1 if begun < GROWS else min(3 * begun, ATTEMPTS - begun)
        asked = open_.withColumn("attempt", F.lit(begun)) if draws == 1 else open_.withColumn("attempt", F.explode(F.sequence(F.lit(begun), F.lit(begun + draws - 1))))
        drawn = materialised(few_files(_assigned(asked, key)))
        free = drawn.join(real, "surrogate", "left_anti")
        if settled is not None:
            free = free.join(settled.select("surrogate"), "surrogate", "left_anti")
        passed = [drawn]
        if draws > 1:
            free = free.groupBy("kind", "value").agg(F.min(F.struct("attempt", "surrogate")).alias("first")).select("kind", "value", "first.attempt", "first.surrogate")
            free = materialised(few_files(free))
            passed.append(free)
        least = free.groupBy("surrogate").agg(F.min(F.struct("kind", "value")).alias("first"))
        good = free.join(least, "surrogate").filter(F.struct("kind", "value") == F.col("first")).select(*drawn.columns)
        good = materialised(few_files(good))
        settled = good if settled is None else settled.unionByName(good)
        passed.append(open_)
        open_ = materialised(few_files(open_.join(good.select("kind", "value"), ["kind", "value"], "left_anti")))
        dropped(*passed)
        begun += draws
        if open_.isEmpty():
            return settled.select("kind", "value", "surrogate")
    kinds = sorted(r.kind for r in open_.select("kind").distinct().limit(20).collect())
    warnings.warn(f"no free surrogate for {open_.count()} entities of the kinds {kinds}: they are masked", stacklevel=2)
    return settled.select("kind", "value", "surrogate").unionByName(open_.select("kind", "value", F.lit(None).cast("string").alias("surrogate")))


def _key_of(text: Column) -> list[Column]:
    """128 bits that stand for a whole text: copies share their entities."""
    return [F.xxhash64(F.lit(1), text).alias("__h1"), F.xxhash64(F.lit(2), text).alias("__h2")]


def pseudonymise(df: DataFrame, key: bytes, text: str = "text", replaced: str | None = "replaced") -> DataFrame:
    """Replaces the entities in ``text``; adds ``replaced`` (array of struct<kind, surrogate>, in text order) unless it is None.

    Texts without entities, null and empty ones included, stay as they are and are not shuffled. Texts that the prefilter lets through
    are read once, whole, and written with what was found in them; those with entities are joined to the surrogates by a hash of
    the text. Other columns are passed on, whatever they are called; one named like the output is replaced. Repeated rows get equal
    texts. Row order is not kept; an empty table gives an empty table.
    """
    require(df, text)
    columns = without(df, [replaced] if replaced else [])
    df, spot = numbered(df, columns), [c.lower() for c in columns].index(text.lower())
    kept, text = [F.col(c) for c in df.columns], f"c{spot}"
    maybe = F.coalesce(F.col(text).rlike(PREFILTER), F.lit(False))
    candidates = df.filter(maybe).select(*kept, *_key_of(F.col(text)))
    rest = df.filter(~maybe).select(*kept)

    def detect(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (value,) in rows:
            found = find(value)
            entities = sorted({entity for *_, kind, v in found for entity in entities_of(kind, v)})
            yield [dict(zip(("start", "end", "kind", "value"), f, strict=True)) for f in found], [{"kind": k, "value": v} for k, v in entities]

    pair = [T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())]
    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), *pair]))
    marked = materialised(map_rows(candidates, [text], [T.StructField("__found", spans), T.StructField("__entities", T.ArrayType(T.StructType(pair)))], detect))
    busy = marked.filter(F.size("__found") > 0)
    rest = rest.union(marked.filter(F.size("__found") == 0).select(*kept))
    entities = materialised(few_files(busy.select("__h1", "__h2", F.inline("__entities")).distinct()))
    table = materialised(few_files(resolve(entities.select("kind", "value").distinct(), key)))
    given = entities.join(table, ["kind", "value"]).groupBy("__h1", "__h2").agg(F.collect_list(F.struct("kind", "value", "surrogate")).alias("__given"))
    given = materialised(few_files(given))

    def replace(rows: Iterator[tuple]) -> Iterator[tuple]:
        for value, found, pairs in rows:
            known = {(p["kind"], p["value"]): p["surrogate"] for p in pairs}
            initials = initials_of([(f["kind"], f["value"]) for f in found], known)
            parts, at, said = [], 0, []
            for f in found:
                new = laid(key, f["kind"], f["value"], known, initials)
                parts += [value[at : f["start"]], new]
                said.append({"kind": f["kind"], "surrogate": new})
                at = f["end"]
            yield "".join(parts) + value[at:], said

    said = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("surrogate", T.StringType())]))
    joined = busy.drop("__entities").join(given, ["__h1", "__h2"])
    done = map_rows(joined, [text, "__found", "__given"], [T.StructField("__text", T.StringType()), T.StructField("__said", said)], replace, drop=("__h1", "__h2", "__given", "__found", text))
    whole = done.select(*[F.col("__text").alias(c) if c == text else F.col(c) for c in df.columns], "__said")
    both = whole.union(rest.withColumn("__said", F.array().cast(said)))
    return both.toDF(*columns, replaced) if replaced else both.drop("__said").toDF(*columns)
