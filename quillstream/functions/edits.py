"""Strings one edit away, as expressions over arrays."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = string.ascii_lowercase


def _cuts(word: Column, to: Column, make) -> Column:
    """make(left part, place) over the places 0..to-1; none if there is no place."""
    return F.when(to > 0, F.transform(F.sequence(F.lit(0), to - 1), lambda i: make(F.substring(word, F.lit(1), i), i))).otherwise(F.array().cast("array<string>"))


def _tail(word: Column, past: Column) -> Column:
    return F.substring(word, past + 1, F.length(word))


def deletions(word: Column) -> Column:
    """The distinct strings with one character taken out; of a single character, the empty string."""
    return F.array_distinct(_cuts(word, F.length(word), lambda left, i: F.concat(left, _tail(word, i + 1))))


def symdel_keys(word: Column) -> Column:
    """The word and its deletions: two words one edit apart share a key."""
    return F.array_distinct(F.concat(F.array(word), deletions(word)))


def swaps(word: Column) -> Column:
    """The strings with two neighbours changed over."""
    n = F.length(word)
    return _cuts(word, n - 1, lambda left, i: F.concat(left, F.substring(word, i + 2, F.lit(1)), F.substring(word, i + 1, F.lit(1)), _tail(word, i + 2)))


def lookup_keys(word: Column) -> Column:
    """What a word one edit from this one is found under: see offered_keys()."""
    n = F.length(word)
    placed = _cuts(word, n, lambda left, i: F.concat(i.cast("string"), F.lit(":"), left, _tail(word, i + 1)))
    whole = F.array_distinct(F.transform(swaps(word), lambda s: F.concat(F.lit("="), s)))
    return F.concat(placed, F.array(F.concat(F.lit("+"), word)), whole)


def offered_keys(word: Column) -> Column:
    """The keys that a word is found under: with a place and without the letter there (for another letter), itself with every place
    (for a letter too many), without a letter (for one that is missing), and itself (for neighbours changed over).  Words one edit
    apart share such a key with lookup_keys(), and no others do, but for the word itself."""
    n = F.length(word)
    placed = _cuts(word, n, lambda left, i: F.concat(i.cast("string"), F.lit(":"), left, _tail(word, i + 1)))
    longer = F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(i.cast("string"), F.lit(":"), word))
    shorter = F.transform(deletions(word), lambda d: F.concat(F.lit("+"), d))
    return F.concat(placed, longer, shorter, F.array(F.concat(F.lit("="), word)))


def edits1(word: Column) -> Column:
    """All deletions, transpositions, replacements and insertions over a-z; the word itself is among them; none for the empty word."""
    n = F.length(word)
    letters = F.split(F.lit(ALPHABET), "")
    replaced = F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.transform(letters, lambda c: F.concat(F.substring(word, F.lit(1), i), c, _tail(word, i + 1)))))
    inserted = F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: F.transform(letters, lambda c: F.concat(F.substring(word, F.lit(1), i), c, _tail(word, i)))))
    every = F.array_distinct(F.concat(deletions(word), swaps(word), replaced, inserted))
    return F.when(n > 0, every).otherwise(F.array().cast("array<string>"))


def one_edit_apart(a: Column, b: Column) -> Column:
    """Whether two strings are equal, or one insertion, deletion, substitution or swap of neighbours apart."""
    same = F.length(a) == F.length(b)
    swapped = F.exists(
        F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))),
        lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b,
    )
    return (F.levenshtein(a, b, 1) >= 0) | (same & swapped)


def keyed_number(*parts: Column) -> Column:
    """A number from 0 to 2**28-1 that depends on the parts alone and is the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 7), 16, 10).cast("long")


def corrupt(word: Column, kind: Column, key: Column) -> Column:
    """One edit of the given kind, at a place and with a letter drawn by the key; null where it cannot be made."""
    n = F.length(word)
    place = (key % F.greatest(n, F.lit(1))).cast("int")
    letter = F.substring(F.lit(ALPHABET), ((F.floor(key / 64) % 26) + 1).cast("int"), F.lit(1))
    left = F.substring(word, F.lit(1), place)
    here, after = F.substring(word, place + 1, F.lit(1)), F.substring(word, place + 2, F.lit(1))
    return (
        F.when((kind == "deletion") & (n >= 2), F.concat(left, _tail(word, place + 1)))
        .when(kind == "insertion", F.concat(left, letter, _tail(word, place)))
        .when((kind == "replacement") & (n >= 1) & (letter != here), F.concat(left, letter, _tail(word, place + 1)))
        .when((kind == "transposition") & (place + 1 < n) & (here != after), F.concat(left, after, here, _tail(word, place + 2)))
    )
