"""Similarities of sets, vectors and texts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def _dot(a: Column, b: Column) -> Column:
    zero = F.lit(0.0).cast("double")
    both = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double"), zero) * F.coalesce(y.cast("double"), zero))
    return F.aggregate(both, zero, lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; a shorter vector is filled up with zeros, a zero vector has none."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(_dot(a, b) / norms)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def edit_ratio(a: Column, b: Column) -> Column:
    """Levenshtein distance over the longer length; 0 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 0.0).otherwise(F.levenshtein(a, b) / longest)


def token_overlap(a: Column, b: Column, masked) -> Column:
    """Places where two token arrays of one length agree or both hold a masked token."""
    same = F.zip_with(a, b, lambda x, y: F.when((x == y) | (masked(x) & masked(y)), 1).otherwise(0))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x)
