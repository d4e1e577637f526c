"""Similarity of names, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The consonants' codes; every other letter has code 0.
SOUND = {"B": "1", "F": "1", "P": "1", "V": "1", "C": "2", "G": "2", "J": "2", "K": "2", "Q": "2", "S": "2", "X": "2", "Z": "2", "D": "3", "T": "3", "L": "4", "M": "5", "N": "5", "R": "6"}


def soundex(name: Column) -> Column:
    """Soundex in which a vowel, H, W or Y ends a run of one code: Ashcraft is A226.

    Non-letters are dropped first; without letters the result is empty.
    """
    letters = F.regexp_replace(F.upper(name), r"[^\p{L}]", "")
    codes = F.translate(F.regexp_replace(letters, r"[^BFPVCGJKQSXZDTLMNR]", "0"), "".join(SOUND), "".join(SOUND.values()))
    # a run of one code counts once; 0 stands between runs, then goes
    runs = F.regexp_replace(codes, r"([0-6])\1+", "$1")
    rest = F.replace(F.substring(runs, F.lit(2), F.length(runs)), F.lit("0"), F.lit(""))
    return F.when(letters == "", F.lit("")).otherwise(F.rpad(F.concat(F.substring(letters, 1, 1), F.substring(rest, 1, 3)), 4, "0"))


def bigrams(name: Column) -> Column:
    """The set of two-character pieces; a shorter name is its own piece."""
    n = F.length(name)
    return F.when(n < 2, F.array(name)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(name, i, F.lit(2)))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets of pieces; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def fuzzy(a: Column, b: Column) -> Column:
    """1 - edit distance / length of the longer name in bytes; 1 for two empty ones."""
    longest = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def combined(a: Column, b: Column) -> Column:
    """The best of bigram likeness, fuzzy likeness and 0.8 for equal sounds."""
    return F.greatest(jaccard(bigrams(a), bigrams(b)), fuzzy(a, b), F.when(soundex(a) == soundex(b), 0.8).otherwise(0.0))


def contained(a: Column, b: Column) -> Column:
    """Fuzzy likeness, raised by 0.3 (to 1 at most) if one name contains the other."""
    return F.least(F.lit(1.0), fuzzy(a, b) + F.when(a.contains(b) | b.contains(a), 0.3).otherwise(0.0))


def snake_case(name: Column) -> Column:
    split = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2"), r"[\s\-]+", "_")
    return F.lower(split)


def kebab_case(name: Column) -> Column:
    return F.translate(snake_case(name), "_", "-")


def pascal_case(name: Column) -> Column:
    return F.replace(F.initcap(F.translate(snake_case(name), "_", " ")), F.lit(" "), F.lit(""))
