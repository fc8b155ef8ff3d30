"""Finite-value handling, guarded arithmetic and half-even rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: str | Column) -> Column:
    """True for a present, finite number; never null."""
    c = col(c).cast("double")
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(INF)), F.lit(False))


def finite_or_null(c: str | Column) -> Column:
    """NaN and infinities become null: Spark aggregates skip null, not NaN."""
    c = col(c).cast("double")
    return F.when(is_finite(c), c)


def number_or_null(c: str | Column) -> Column:
    """NaN becomes null, infinities stay: what an average or a rank may count."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c), c)


def exceeds(score: str | Column, limit: str | Column) -> Column:
    """The strict alarm, never null; a missing score or limit raises none.

    Spark orders NaN above every number, so the comparison alone would alarm.
    """
    score = col(score).cast("double")
    return F.coalesce((score > col(limit)) & ~F.isnan(score), F.lit(False))


def ratio(top: Column, bottom: Column, floor: float = 1.0) -> Column:
    """``top / max(bottom, floor)``."""
    return top / F.greatest(bottom, F.lit(floor))


def half_even(c: str | Column) -> Column:
    """Round half to even as a bigint, the rounding used by every split size."""
    return F.bround(col(c)).cast("long")


def infinity_text(c: str | Column) -> Column:
    """Number as text, with an unresolved (+inf) threshold written ``infinity``."""
    c = col(c)
    return F.when(c == F.lit(INF), F.lit("infinity")).otherwise(c.cast("string"))
