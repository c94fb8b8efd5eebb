"""Edit distance one, distances and candidate scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
#: Letters that an insertion or substitution may bring in.
ALPHABET = "abcdefghijklmnopqrstuvwxyzáéíóúüñçàèìòùâêîôû"
FREQUENCY_WEIGHT, DISTANCE_WEIGHT = 0.3, 0.5
SIMILARITY_WEIGHT = 18.0
RERANKED = 5


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def deletions(word: Column | str) -> Column:
    """The word without its i-th character, for each i."""
    w = _c(word)
    return F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))).otherwise(F.array().cast("array<string>"))


def edits1(word: Column | str, alphabet: str = ALPHABET) -> Column:
    """All distinct words one deletion, adjacent swap, substitution or insertion away, lower-cased, without the word."""
    w = F.lower(_c(word))
    none = F.array().cast("array<string>")
    letters = F.split(F.lit(alphabet), "")
    n = F.length(w)
    left, right = (lambda i: F.substr(w, F.lit(1), i - 1)), (lambda i: F.substr(w, i + 1))
    swaps = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat(left(i), F.substr(w, i + 1, F.lit(1)), F.substr(w, i, F.lit(1)), F.substr(w, i + 2)))).otherwise(none)
    changes = F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(letters, lambda x: F.concat(left(i), x, right(i)))))).otherwise(none)
    inserts = F.flatten(F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.transform(letters, lambda x: F.concat(left(i), x, F.substr(w, i)))))
    return F.array_remove(F.array_distinct(F.concat(deletions(w), swaps, changes, inserts)), w)


def levenshtein(a: Column | str, b: Column | str) -> Column:
    return F.levenshtein(F.lower(_c(a)), F.lower(_c(b)))


def first_difference(a: Column, b: Column) -> Column:
    """The place (from 1) of the first character in which two words of equal length differ."""
    return F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), F.lit(False))


def is_swap(a: Column | str, b: Column | str) -> Column:
    """Whether two different words become equal by one swap of neighbours."""
    a, b = _c(a), _c(b)
    i = first_difference(a, b).cast("int")
    swapped = F.concat(F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2))
    return F.coalesce((F.length(a) == F.length(b)) & (a != b) & (i < F.length(a)) & (swapped == b), F.lit(False))


def brings_known_letter(typed: Column, other: Column, alphabet: str = ALPHABET) -> Column:
    """For words at Levenshtein distance 1: whether the letter that `other` has instead of or beyond `typed`'s is in
    the alphabet (a deletion brings none)."""
    i = F.coalesce(F.array_position(F.zip_with(F.split(typed, ""), F.split(other, ""), lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False)), F.lit(0)).cast("int")
    return (F.length(other) < F.length(typed)) | F.substr(other, i, F.lit(1)).isin(list(alphabet))


def effective_distance(typed: Column | str, other: Column | str) -> Column:
    """1 within one edit, a swap of neighbours counting as one; else the Levenshtein distance."""
    return F.when(is_swap(F.lower(_c(typed)), F.lower(_c(other))), 1).otherwise(levenshtein(typed, other))


def candidate_score(freq: Column | str, distance: Column | str) -> Column:
    return FREQUENCY_WEIGHT * F.log(_c(freq) + 1) + DISTANCE_WEIGHT * (F.lit(1.0) / (F.lit(1) + _c(distance)))


def combined_score(score: Column | str, similarity: Column | str) -> Column:
    return _c(score) + SIMILARITY_WEIGHT * _c(similarity)


def spelling_confidence(similarity: Column | str) -> Column:
    """A cosine as a confidence from 0 to 1; null where there is none."""
    return (_c(similarity) + 1.0) / 2.0
