"""Goods and design classes held as arrays. Class 99 stands for all of 1 to 45."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALL = 99


def expand(c: Column) -> Column:
    return F.when(F.array_contains(c, ALL), F.sequence(F.lit(1), F.lit(45))).otherwise(F.array_sort(F.array_distinct(c)))


def overlap(a: Column, b: Column) -> Column:
    """The shared classes of two expanded lists, sorted."""
    return F.array_sort(F.array_intersect(expand(a), expand(b)))


def overlap_score(a: Column, b: Column) -> Column:
    """Shared classes by the smaller list; 1 if either holds 99, 0 if either is empty."""
    smaller = F.least(F.size(expand(a)), F.size(expand(b)))
    return (
        F.when(F.array_contains(a, ALL) | F.array_contains(b, ALL), F.lit(1.0))
        .when(F.coalesce(smaller, F.lit(0)) <= 0, F.lit(0.0))
        .otherwise(F.size(overlap(a, b)) / smaller)
    )


def matches(classes: Column, wanted: Column) -> Column:
    """Retrieval's filter: a shared class, or a row that covers all classes. 99 in `wanted` is no wildcard here."""
    return F.arrays_overlap(classes, wanted) | F.array_contains(classes, ALL)


def locarno_matches(codes: Column, wanted: list[str]) -> Column:
    """A code or its main class (before the hyphen) is wanted."""
    return F.exists(codes, lambda c: c.isin(wanted) | F.split(c, "-", -1)[0].isin(wanted))
