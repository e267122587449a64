"""Text expressions: accent folding, normal forms, event names, literal and fuzzy matching. Built-in functions only."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLAIN = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in range(0xC0, 0x250)}
_PLAIN = {a: b for a, b in _PLAIN.items() if b.isascii() and b.islower()} | {"ø": "o", "ł": "l", "đ": "d", "ı": "i", "ħ": "h"}
#: Lower-case letters with marks and the plain letters that stand for them, position by position.
FOLD_FROM, FOLD_TO = "".join(_PLAIN), "".join(_PLAIN.values())
#: Letters that fold to two.
FOLD_PAIRS = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"}
BULLET = "•"
#: Words that tell an event's gender (fixed values).
GENDER_WORDS = {"WOMEN": ("women", "woman", "female", "girls", "girl"), "MEN": ("men", "man", "male", "boys", "boy"), "MIXED": ("mixed",)}
#: Words that say no more than an event's sport (fixed values), and historical names of events with today's (fixed values).
ROWING_WORDS = ("coxed", "coxless")
SPORT_WORDS = ("coxed", "coxless", "alpine", "cross country", "freestyle", "nordic", "speed", "artistic", "rhythmic", "trampoline", "equestrianism", "equestrian", "jumping", "dressage", "eventing")
SYNONYMS = {"race walk": "walk", "mixed": "open", "three day event": "eventing", "synchronized swimming": "artistic swimming"}
#: Single words that are written in one way, or left out (fixed values).
ONE_SPELLING = {"mens": "men", "womens": "women", "m": "metres", "meters": "metres", "x": "", "olympic": "", "olympics": "", "yog": ""}


def fold(text: Column) -> Column:
    """Lower case without accents; the bullet that separates names becomes a space."""
    out = F.translate(F.lower(F.replace(text, F.lit(BULLET), F.lit(" "))), FOLD_FROM, FOLD_TO)
    for letter, pair in FOLD_PAIRS.items():
        out = F.replace(out, F.lit(letter), F.lit(pair))
    return F.regexp_replace(out, "[̀-ͯ]", "")


def fold_python(text: str) -> str:
    """`fold` of a parameter on the driver."""
    out = text.replace(BULLET, " ").lower().translate(str.maketrans(FOLD_FROM, FOLD_TO))
    for letter, pair in FOLD_PAIRS.items():
        out = out.replace(letter, pair)
    return re.sub("[̀-ͯ]", "", out)


def fold_sql(text: str) -> str:
    """`fold` in ANSI-style SQL, for checks."""
    out = f"translate(lower(replace({text}, '{BULLET}', ' ')), '{FOLD_FROM}', '{FOLD_TO}')"
    for letter, pair in FOLD_PAIRS.items():
        out = f"replace({out}, '{letter}', '{pair}')"
    return f"regexp_replace({out}, '[̀-ͯ]', '', 'g')"


def normal(text: Column) -> Column:
    """Folded words of ASCII letters and digits, one space between."""
    return F.trim(F.regexp_replace(fold(text), "[^a-z0-9]+", " "))


def normal_sql(text: str) -> str:
    return f"trim(regexp_replace({fold_sql(text)}, '[^a-z0-9]+', ' ', 'g'))"


def compact(text: Column) -> Column:
    """Folded letters and digits alone, parentheses left out with what they hold."""
    return F.regexp_replace(fold(F.regexp_replace(text, r"\([^)]*\)", "")), "[^a-z0-9]", "")


def tokens(text: Column) -> Column:
    """The distinct normal words longer than one letter, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(normal(text), " "), lambda t: F.length(t) > 1)))


def person_name(text: Column) -> Column:
    """A name without maiden names in parentheses, nicknames in quotes, generation suffixes and single letters."""
    out = F.regexp_replace(text, r"\([^)]*\)|\"[^\"]*\"|“[^”]*”", " ")
    words = F.split(normal(out), " ")
    return F.array_join(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin("jr", "sr", "ii", "iii", "iv")), " ")


def code(text: Column) -> Column:
    """Upper case without white space."""
    return F.upper(F.regexp_replace(text, r"\s+", ""))


def sex(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin("m", "male", "man", "men"), "M").when(low.isin("f", "female", "woman", "women", "w"), "F").otherwise(F.nullif(F.trim(text), F.lit("")))


def scalar(text: Column) -> Column:
    """Integral numbers as integers, anything else in normal form."""
    number = text.try_cast("double")
    return F.when(number.isNotNull() & (number == F.floor(number)), number.try_cast("long").cast("string")).otherwise(normal(text))


def event_gender(text: Column) -> Column:
    """WOMEN, MEN, MIXED or UNKNOWN by whole words of the normal form; women are looked for first, then men."""
    words = F.split(normal(text), " ")
    out = F.lit("UNKNOWN")
    for gender, known in reversed(GENDER_WORDS.items()):
        out = F.when(F.arrays_overlap(words, F.array(*[F.lit(w) for w in known])), gender).otherwise(out)
    return out


def event_signature(text: Column, parents: list[Column] | None = None, repeats: bool = False) -> Column:
    """Sorted words of an event name without its parents' words and filler, distances in one form; with `repeats`, words may repeat."""
    out = F.regexp_replace(F.lower(text), "×", "x")
    out = F.regexp_replace(out, r"(\d),(\d{3})\b", "$1$2")
    out = normal(out)
    out = F.regexp_replace(out, r"\b(\d+) x (\d+)\b", "$1x$2")
    out = F.regexp_replace(out, r"(\d+) ?(m|metres?|meters?)\b", "$1 metres")
    out = F.regexp_replace(out, r"\b(men|women) s\b", "$1")
    for parent in parents or []:
        out = F.regexp_replace(out, F.concat(F.lit(r"\b"), normal(parent), F.lit(r"\b")), F.lit(" "))
    words = F.filter(F.split(F.trim(F.regexp_replace(out, r"\b(olympics?|yog|non medal)\b", " ")), " +"), lambda w: w != "")
    return F.array_join(F.array_sort(words if repeats else F.array_distinct(words)), " ")


def event_alignment(name: Column, sport: Column, discipline: Column, fine: bool = True) -> Column:
    """Sorted distinct words of an event name without those of its sport and discipline, by which namings of one event agree.

    `fine` also replaces historical names and leaves out all SPORT_WORDS; else only ROWING_WORDS go. Longer phrases go before shorter ones, whichever column or list they come from.
    """
    own = normal(F.regexp_replace(name, "×", "x"))
    for old, new in SYNONYMS.items() if fine else ():
        own = F.regexp_replace(own, rf"\b{old}\b", new)
    parents = F.array(F.coalesce(normal(sport), F.lit("")), F.coalesce(normal(discipline), F.lit("")), *[F.lit(w) for w in (SPORT_WORDS if fine else ROWING_WORDS)])
    if fine:
        parents = F.array_sort(F.array_distinct(parents), lambda a, b: F.length(b) - F.length(a))
    own = F.aggregate(F.filter(parents, lambda p: p != ""), own, lambda left, p: F.regexp_replace(left, F.concat(F.lit(r"\b"), p, F.lit(r"\b")), F.lit(" ")))
    own = F.regexp_replace(F.regexp_replace(own, r"(\d+)\s*x\s*(\d+)", "$1x$2"), r"\b(men|women) s\b", "$1")
    words = F.split(F.regexp_replace(own, r"\bnon medal\b", " "), " +")
    spelled = F.transform(words, lambda w: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in ONE_SPELLING.items() for x in pair]), w), w))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(spelled, lambda w: w != ""))), " ")


def id_order(id: Column) -> list[Column]:
    """Sort keys of ids held as text: integers by value before all others, these as text."""
    number = F.trim(id).try_cast("decimal(38,0)")
    whole = F.when(F.trim(id).rlike(r"^[+-]?\d+$"), number)
    return [whole.isNull(), whole, id]


def locale_order(text: Column, locale: str = "UNICODE") -> Column:
    """Sort key by which accented and capital letters stand beside their plain ones."""
    return F.collate(text, locale)


def event_parts(text: Column) -> Column:
    """gender, youth, non_medal, numbers with units and the remaining words of an event name."""
    low = F.regexp_replace(F.lower(F.regexp_replace(text, "×", "x")), r"(\d)[,.](\d{3})\b", "$1$2")
    found = F.regexp_extract_all(low, F.lit(r"(?:<=|>=|[<>+\-≤≥] ?)?\d+(?:\.\d+)? ?(?:kg|kilograms?|km|kilometres?|m|metres?|meters?|yards?|miles?)\b"), F.lit(0))
    unit = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "≤", "<="), "≥", ">="), " ", ""), r"kilogram(s)?$", "kg"), r"kilometre(s)?$", "km"), r"(?<=\d)(metre|meter)(s)?$", "m")
    rest = F.regexp_replace(low, r"(?:<=|>=|[<>+\-≤≥] ?)?\d+(?:\.\d+)? ?(?:kg|kilograms?|km|kilometres?|m|metres?|meters?|yards?|miles?)\b", " ")
    filler = ["women", "woman", "womens", "men", "man", "mens", "mixed", "boys", "girls", "olympic", "olympics", "youth", "s", "medal", "non", ""]
    return F.struct(
        event_gender(text).alias("gender"),
        low.rlike(r"\b(youth|yog|boys|girls)\b").alias("youth"),
        low.rlike(r"\bnon.?medal\b").alias("non_medal"),
        F.array_sort(F.transform(found, unit)).alias("measures"),
        F.array_join(F.array_sort(F.filter(F.split(normal(rest), " "), lambda w: ~w.isin(filler))), " ").alias("words"),
    )


def is_canonical(name: Column) -> Column:
    """Whether a name ends with a qualifier in parentheses."""
    return F.coalesce(name.rlike(r"(?s)\(.*\)$"), F.lit(False))


def contains_literal(text: Column, part: str) -> Column:
    """Accent- and case-insensitive containment; no character of `part` is a wildcard."""
    return fold(text).contains(fold_python(part))


def equals_folded(text: Column, other: str) -> Column:
    return F.trim(fold(text)) == fold_python(other).strip()


def all_words(text: Column, words: str) -> Column:
    """Every word of `words` begins a word of `text`, whatever accents, case, bullets and hyphens."""
    wanted = re.findall(r"\w+", fold_python(words))
    out = F.lit(bool(wanted))
    for word in wanted:
        out = out & fold(text).rlike(rf"(^|[\s\-•']){re.escape(word)}")
    return out


def has_non_ascii(text: Column) -> Column:
    return text.rlike("[^ -~]")


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; diagnostic only, it never merges anything."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)
