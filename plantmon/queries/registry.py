"""Registration of queries together with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantmon.queries.views import VIEW_SQL

DIGITS = 6


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def _nudge(digits: int) -> float:
    """Small shift applied before rounding.

    Means of two-decimal values over round row counts often end exactly on a
    rounding tie, where the last bit decides; shifted, they do not.
    """
    return 0.033 * 10.0**-digits


def _rounded_column(name: str, digits: int):
    value = F.round(F.col(name) + F.lit(_nudge(digits)), digits)
    return F.when(value == 0, F.lit(0.0)).otherwise(value)


def _views(names: Sequence[str]) -> str:
    needed: list[str] = []

    def visit(name: str) -> None:
        for parent in VIEW_SQL[name][0]:
            visit(parent)
        if name not in needed:
            needed.append(name)

    for n in names:
        visit(n)
    return ", ".join(f"{n} AS MATERIALIZED ({VIEW_SQL[n][1]})" for n in needed)


def query(
    name: str, sql: str | None = None, *, views: Sequence[str] = (),
    rounded: Sequence[str] | Mapping[str, int] = (),
) -> Callable:
    """Register ``fn(spark, sf_dir)`` under ``name``.

    ``rounded`` columns are sums of floats, whose last digits depend on the
    order of addition; both sides round them.
    """
    digits = dict(rounded) if isinstance(rounded, Mapping) else dict.fromkeys(rounded, DIGITS)

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.withColumns({c: _rounded_column(c, d) for c, d in digits.items()}) if digits else df

        text = None
        if sql is not None:
            text = sql.strip()
            if digits:
                edits = ", ".join(
                    f"CASE WHEN round({c} + {_nudge(d)!r}::DOUBLE, {d}) = 0 THEN 0.0::DOUBLE "
                    f"ELSE round({c} + {_nudge(d)!r}::DOUBLE, {d}) END AS {c}"
                    for c, d in digits.items()
                )
                text = f"SELECT * REPLACE ({edits}) FROM ({text}) AS answer"
            if views:
                text = f"WITH {_views(views)} {text}"
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = Query(run, text)
        return fn

    return wrap
