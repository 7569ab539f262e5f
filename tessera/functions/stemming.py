"""Word lists and their stems by Porter's published steps, as column expressions.

Each step is one pass over a word array, so the expression grows with the number of steps and not with their product.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Runs of consonants and vowels; y is a vowel after a consonant, and a word's first y (written Y meanwhile) is a consonant.
CONSONANTS = "[^aeiou][^aeiouy]*"
VOWELS = "[aeiouy][aeiou]*"
SOME = f"(?:{CONSONANTS})?{VOWELS}{CONSONANTS}"  # a stem that begins so has a measure over 0
MORE = f"{SOME}{VOWELS}{CONSONANTS}"  # a measure over 1
SHORT = f"{CONSONANTS}[aeiouy][^aeiouwxy]"  # consonant, vowel, consonant at the end

# Endings of the second, third and fourth step.
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def word_list(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits; no words for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), F.array().cast("array<string>"))


def plural(w: Column) -> Column:
    return F.when(w.rlike(".(ss|i)es$"), F.regexp_replace(w, "es$", "")).otherwise(F.regexp_replace(w, "(?<=[^s])s$", ""))


def past(w: Column) -> Column:
    """Takes off ed and ing after a stem with a vowel and marks the bare stem with a bar, which `mended` replaces."""
    bare = F.regexp_replace(w, f"^((?:{CONSONANTS})?[aeiouy].*)(?:ed|ing)$", "$1|")
    return F.when(w.rlike(".eed$"), F.regexp_replace(w, f"^({SOME}.*)eed$", "$1ee")).otherwise(bare)


def mended(w: Column) -> Column:
    return (
        F.when(~F.endswith(w, F.lit("|")), w)
        .when(w.rlike(r"(at|bl|iz)\|$"), F.regexp_replace(w, r"\|$", "e"))
        .when(w.rlike(r"([^aeiouylsz])\1\|$"), F.regexp_replace(w, r".\|$", ""))
        .otherwise(F.regexp_replace(F.regexp_replace(w, rf"^({SHORT})\|$", "$1e"), r"\|$", ""))
    )


def last_y(w: Column) -> Column:
    return F.regexp_replace(w, f"^((?:{CONSONANTS})?[aeiouy].*)y$", "$1i")


def endings(table: dict[str, str], stem: str) -> Callable[[Column], Column]:
    """A step that replaces the longest of the endings a word has, if the stem before it is as asked for."""

    def step(w: Column) -> Column:
        out = w
        for old in sorted(table, key=len):
            out = F.when(F.endswith(w, F.lit(old)), F.regexp_replace(w, f"^({stem}.*){old}$", f"$1{table[old]}")).otherwise(out)
        return out

    return step


def without_ending(w: Column) -> Column:
    ion = F.regexp_replace(w, f"^({MORE}.*)(?<=[st])ion$", "$1")
    return F.when(F.endswith(w, F.lit("ion")), ion).otherwise(endings(dict.fromkeys(FOURTH, ""), MORE)(w))


def last_e(w: Column) -> Column:
    """An e goes after a measure over 1, or of 1 unless the stem is short."""
    one = f"(?:{CONSONANTS})?{VOWELS}{CONSONANTS}(?:{VOWELS})?"
    return F.when(w.rlike(f"^{MORE}.*e$"), F.regexp_replace(w, "e$", "")).otherwise(F.regexp_replace(w, f"^(?!{SHORT}e$)({one})e$", "$1"))


def last_l(w: Column) -> Column:
    return F.when(F.endswith(w, F.lit("ll")) & w.rlike(f"^{MORE}"), F.regexp_replace(w, "l$", "")).otherwise(w)


STEPS = (plural, past, mended, last_y, endings(SECOND, SOME), endings(THIRD, SOME), without_ending, last_e, last_l)


def stems(words: Column, least: int = 4) -> Column:
    """The stems of an array of words (lower-case letters and digits), in order; words of under `least` characters, and of one or
    two always, stay as they are, and nulls stay null."""
    out = F.transform(words, lambda w: F.regexp_replace(w, "^y", "Y"))
    for step in STEPS:
        out = F.transform(out, step)
    return F.zip_with(words, out, lambda w, s: F.when(F.length(w) < max(3, least), w).otherwise(F.lower(s)))


def grams(words: Column, n: int) -> Column:
    """Runs of n words, joined by blanks; none if there are fewer."""
    at = F.sequence(F.lit(1), F.size(words) - n + 1)
    return F.when(F.size(words) >= n, F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))
