"""Token-set and number-list comparisons as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct tokens; -1 where either side is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(-1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b), F.lit(1))


def contained(a: Column, b: Column) -> Column:
    """Share of a's distinct tokens that b has; -1 where a is empty."""
    return F.when(F.size(a) == 0, F.lit(-1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_distinct(a)))


def numbers(text: Column, most: int = 4) -> Column:
    """The first numbers in a text, those that fit a long."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("long"))
    return F.slice(F.filter(found, lambda x: x.isNotNull()), 1, most)


def least_relative_gap(a: Column, b: Column) -> Column:
    """The smallest |x - y| / max(x, y, 1) over all pairs; -1 where either side is empty."""
    gaps = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.abs(x - y) / F.greatest(x, y, F.lit(1)))))
    return F.coalesce(F.array_min(gaps), F.lit(-1.0))


def char_ngrams(text: Column, n: int) -> Column:
    """The n-grams within words, a space standing at either end of each, as often as they occur; a word too short for one gives itself."""
    padded = F.transform(F.filter(F.split(text, " "), lambda t: t != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))
    return F.flatten(F.transform(padded, grams))
