"""Vectors as lists of columns or as ``array<double>`` columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plantmon.functions.numeric import col


def total(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def pack(cols: Sequence[str | Column]) -> Column:
    return F.array(*[col(c).cast("double") for c in cols])


def array_sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def l1(v: Column) -> Column:
    return array_sum(F.transform(v, F.abs))


def l2(v: Column) -> Column:
    return F.sqrt(array_sum(F.transform(v, lambda x: x * x)))


def linf(v: Column) -> Column:
    return F.array_max(F.transform(v, F.abs))


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x * y))


def matvec(matrix: Sequence[Sequence[float]], cols: Sequence[Column]) -> list[Column]:
    """Rows of a fitted matrix times a list of columns."""
    return [total([F.lit(float(w)) * c for w, c in zip(row, cols, strict=True)]) for row in matrix]


def argmax(v: Column) -> Column:
    """0-based position of the first largest entry."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("long")


def median(v: Column) -> Column:
    """Median of a short array without nulls; null when empty."""
    ordered = F.array_sort(v)
    n = F.size(ordered)
    low = F.get(ordered, ((n - 1) / 2).cast("int"))
    high = F.get(ordered, (n / 2).cast("int"))
    return (low + high) / 2


def max_of(cols: Sequence[Column]) -> Column:
    return cols[0] if len(cols) == 1 else F.greatest(*cols)
