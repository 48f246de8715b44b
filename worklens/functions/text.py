"""Description normalisation, tokens and n-gram terms."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_spaced(column: Column) -> Column:
    """Lower case; every other character than a-z, 0-9 becomes a space; '' for NULL."""
    text = F.regexp_replace(F.lower(F.coalesce(column, F.lit(""))), r"[^a-z0-9]+", " ")
    return F.trim(text)


def normalize_joined(column: Column) -> Column:
    """Lower case; characters other than letters, digits and space are deleted."""
    return F.regexp_replace(F.lower(F.coalesce(column, F.lit(""))), "[^a-z0-9 ]", "")


def tokens(normalized: Column, stop_words: Sequence[str] = ()) -> Column:
    """Words of two or more characters that are not stop words, in text order."""
    words = F.split(normalized, " ")
    if not stop_words:
        return F.filter(words, lambda word: F.length(word) >= 2)
    stops = [word for word in stop_words if len(word) >= 2]
    return F.filter(words, lambda word: (F.length(word) >= 2) & ~word.isin(*stops))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row.

    The optimiser inlines a column that was computed by an earlier projection;
    inside a per-element lambda it would then be computed once per element. A
    lambda variable cannot be inlined.
    """
    return F.transform(F.array(value), body)[0]


def terms(words: Column, ngrams: int = 1) -> Column:
    """Unigrams, plus the bigrams of neighbouring words for ``ngrams=2``."""
    if ngrams == 1:
        return words
    if ngrams != 2:
        raise ValueError("ngrams must be 1 or 2")

    def with_bigrams(array: Column) -> Column:
        following = F.slice(array, F.lit(2), F.greatest(F.size(array), F.lit(1)))
        return F.concat(array, F.transform(following, lambda word, i: F.concat(array[i], F.lit(" "), word)))

    return bound(words, with_bigrams)


def term_numbers(words: Column, ngrams: int = 1) -> Column:
    """``terms`` as numbers: a 64-bit hash of the word or of the two words."""
    if ngrams == 1:
        return F.transform(words, lambda word: F.xxhash64(word))
    if ngrams != 2:
        raise ValueError("ngrams must be 1 or 2")

    def with_bigrams(array: Column) -> Column:
        following = F.slice(array, F.lit(2), F.greatest(F.size(array), F.lit(1)))
        return F.concat(F.transform(array, lambda word: F.xxhash64(word)), F.transform(following, lambda word, i: F.xxhash64(array[i], word)))

    return bound(words, with_bigrams)


def counted(numbers: Column) -> Column:
    """Distinct numbers of an array with their counts, as sorted (term, tf) structs."""

    def runs(ordered: Column) -> Column:
        size = F.size(ordered)
        places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        count = lambda at: F.transform(
            at, lambda i, k: F.struct(F.get(ordered, i).alias("term"), (F.coalesce(F.get(at, k + 1), size) - i).alias("tf"))
        )
        return bound(starts, count)

    return bound(F.sort_array(numbers), runs)
