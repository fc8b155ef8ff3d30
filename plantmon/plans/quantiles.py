"""Exact quantiles by narrowing brackets, and per-group quantiles by rank.

The built-in exact ``percentile`` keeps every distinct value of a column in one
aggregation buffer. Here a sketch first brackets each wanted rank; a second
scan counts what lies below the bracket and collects only the values strictly
inside it, a bounded number. Neither pass shuffles rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantmon.plans.ranking import rank_within

COLLECT_LIMIT = 100_000
ACCURACY = 10_000
CUTS = 64


def interpolate_rank(lower: float, upper: float, rank: float) -> float:
    return lower + (upper - lower) * (rank - math.floor(rank))


def _wanted(n: int, prob: float) -> tuple[int, int, float]:
    rank = prob * (n - 1)
    return math.floor(rank), math.ceil(rank), rank


def _by_sort(values: DataFrame, name: str, k_lo: int, k_hi: int, rank: float) -> float:
    ranked = rank_within(values.where(F.col(name).isNotNull()).select(name), [], [name], "_k")
    rows = {r["_k"]: r[name] for r in ranked.where(F.col("_k").isin(k_lo, k_hi)).collect()}
    return interpolate_rank(rows[k_lo], rows[k_hi], rank)


def exact_quantiles(
    df: DataFrame,
    columns: Mapping[str, Column],
    probs: Sequence[float],
    *,
    limit: int = COLLECT_LIMIT,
    accuracy: int = ACCURACY,
) -> dict[str, list[float]]:
    """Linear-interpolated quantiles of each column over its non-null values."""
    names = list(columns)
    values = df.select(*[columns[n].cast("double").alias(n) for n in names])
    head = values.agg(
        *[
            F.struct(
                F.count(n).alias("n"),
                F.min(n).alias("lo"),
                F.max(n).alias("hi"),
                F.percentile_approx(
                    n,
                    [
                        min(1.0, max(0.0, p + side * 2.0 / accuracy))
                        for p in probs
                        for side in (-1, 1)
                    ],
                    accuracy,
                ).alias("sketch"),
            ).alias(n)
            for n in names
        ]
    ).first()

    found: dict[tuple[str, int], float] = {}
    brackets: dict[tuple[str, int], tuple[float, float]] = {}
    for n in names:
        stats = head[n]
        for i, p in enumerate(probs):
            if stats["n"] == 0:
                found[n, i] = math.nan
            elif stats["n"] <= limit or stats["lo"] == stats["hi"]:
                brackets[n, i] = (stats["lo"], stats["hi"])
            else:
                lo = stats["lo"] if p <= 2.0 / accuracy else stats["sketch"][2 * i]
                hi = stats["hi"] if p >= 1 - 2.0 / accuracy else stats["sketch"][2 * i + 1]
                brackets[n, i] = (lo, hi)

    collectable = {
        key: head[key[0]]["n"] <= limit or 8 * head[key[0]]["n"] / accuracy <= limit
        for key in brackets
    }
    while brackets:
        keys = list(brackets)
        aggs = []
        for j, key in enumerate(keys):
            lo, hi = brackets[key]
            c = F.col(key[0])
            inside = F.when((c > lo) & (c < hi), c)
            rest = (
                F.collect_list(inside).alias("values")
                if collectable[key]
                else F.percentile_approx(
                    inside, [s / CUTS for s in range(CUTS + 1)], accuracy
                ).alias("values")
            )
            aggs.append(
                F.struct(
                    F.count(F.when(c < lo, 1)).alias("below"),
                    F.count(F.when(c == lo, 1)).alias("at_lo"),
                    F.count(inside).alias("inside"),
                    F.count(F.when(c == hi, 1)).alias("at_hi") if hi > lo else F.lit(0).alias("at_hi"),
                    rest,
                ).alias(f"b{j}")
            )
        row = values.agg(*aggs).first()
        for j, key in enumerate(keys):
            part, (lo, hi) = row[f"b{j}"], brackets.pop(key)
            n = head[key[0]]["n"]
            k_lo, k_hi, rank = _wanted(n, probs[key[1]])
            start = part["below"] + part["at_lo"]
            stop = start + part["inside"]
            if k_lo < part["below"] or k_hi >= stop + part["at_hi"]:
                # The sketch missed the rank: settle this one by a sort.
                found[key] = _by_sort(values, key[0], k_lo, k_hi, rank)
                continue
            needs_inside = start <= k_lo < stop or start <= k_hi < stop
            if needs_inside and not collectable[key]:
                cuts = part["values"]
                at = [(k - start) / max(part["inside"], 1) * CUTS for k in (k_lo, k_hi)]
                slack = 1 + math.ceil(CUTS * 2 / accuracy)
                left, right = math.floor(at[0]) - slack, math.ceil(at[1]) + slack
                brackets[key] = (
                    cuts[left] if left >= 0 else lo,
                    cuts[right] if right <= CUTS else hi,
                )
                collectable[key] = part["inside"] <= limit
                continue
            ordered = sorted(part["values"]) if needs_inside else []

            def at_rank(k: int) -> float:
                if k < start:
                    return lo
                return ordered[k - start] if k < stop else hi

            found[key] = interpolate_rank(at_rank(k_lo), at_rank(k_hi), rank)
    return {n: [found[n, i] for i in range(len(probs))] for n in names}


def grouped_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Mapping[str, float],
) -> DataFrame:
    """One row per group with the named quantiles, for any number of groups."""
    by = list(by)
    present = df.where(F.col(value).isNotNull()).select(*by, value)
    ranked = rank_within(present, by, [value], "_k", size_name="_n")
    aggs = []
    for name, p in probs.items():
        rank = F.lit(float(p)) * (F.col("_n") - 1)
        low = F.max(F.when(F.col("_k") == F.floor(rank), F.col(value)))
        high = F.max(F.when(F.col("_k") == F.ceil(rank), F.col(value)))
        frac = F.max(rank - F.floor(rank))
        aggs.append((low + (high - low) * frac).alias(name))
    wanted = F.lit(False)
    for p in probs.values():
        rank = F.lit(float(p)) * (F.col("_n") - 1)
        wanted = wanted | (F.col("_k") == F.floor(rank)) | (F.col("_k") == F.ceil(rank))
    return ranked.where(wanted).groupBy(*by).agg(*aggs)
