"""Expressions on cases stored as ``array<double>``; all run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def squared_distance(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))


def centred(x: Column) -> Column:
    return F.transform(x, lambda v: v - total(x) / F.size(x))


def average_ranks(x: Column) -> Column:
    """Rank of each component within its case; ties share their average rank."""
    less = lambda v: F.size(F.filter(x, lambda u: u < v))
    equal = lambda v: F.size(F.filter(x, lambda u: u == v))
    return F.transform(x, lambda v: less(v) + (equal(v) + 1) / F.lit(2.0))


def weighted(values: Column, weights: list[float] | None) -> Column:
    """Sum of values times weights."""
    if weights is None:
        return total(values)
    return total(F.zip_with(values, F.array(*[F.lit(float(w)) for w in weights]), lambda v, w: v * w))


def pairwise(f: Callable[[Column, Column], Column], x: Column, y: Column) -> Column:
    return F.zip_with(x, y, f)
