"""Experiment runs: leaderboards, constraints and the best run."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from plantmon.functions.numeric import finite_or_null
from plantmon.plans import lookup, over_frames, rank_within, running, stage
from plantmon.plans.ordered import BLOCK_ROWS

# Fixed value: normal quantile of the 95 % interval.
Z95 = 1.96
# Runs of a key that one task folds in a round.
FOLD_ROWS = 262_144


def leaderboard(runs: DataFrame, trial: Sequence[str], metrics: Sequence[str],
                failures: DataFrame | None = None) -> DataFrame:
    """Mean, std, min, max, median, count and 95 % half-width per trial and metric.

    All metrics lie in one table of (trial, metric, value), ordered by one sort,
    and the numbers of its rows tell which two values are in the middle. So a
    trial may have any number of repeats, and more metrics are more rows, not
    more sorts.
    """
    trial = list(trial)
    clean = runs.select(*trial, *[finite_or_null(m).alias(f"_v{i}") for i, m in enumerate(metrics)])
    held = F.explode(F.array(*[F.struct(F.lit(i).alias("_m"), F.col(f"_v{i}").alias("_x")) for i in range(len(metrics))]))
    long = clean.select(*trial, held.alias("_e")).select(*trial, "_e._m", "_e._x")
    group = [*trial, "_m"]
    ranked = rank_within(long.where(F.col("_x").isNotNull()), group, ["_x"], "_k", size_name="_size")
    low, high = F.col("_k") == F.expr("(_size - 1) div 2"), F.col("_k") == F.expr("_size div 2")
    middles = ranked.where(low | high).groupBy(*trial).agg(*[
        ((F.max(F.when((F.col("_m") == i) & low, F.col("_x"))) + F.max(F.when((F.col("_m") == i) & high, F.col("_x")))) / 2).alias(f"{m}_median")
        for i, m in enumerate(metrics)
    ])
    aggs = []
    for i, m in enumerate(metrics):
        x = f"_v{i}"
        aggs += [
            F.avg(x).alias(f"{m}_mean"), F.stddev_samp(x).alias(f"{m}_std"), F.min(x).alias(f"{m}_min"),
            F.max(x).alias(f"{m}_max"), F.count(x).alias(f"{m}_count"),
        ]
    table = clean.groupBy(*trial).agg(*aggs).join(middles, trial, "left")
    for m in metrics:
        width = Z95 * F.coalesce(F.col(f"{m}_std"), F.lit(0.0))
        table = table.withColumn(
            f"{m}_ci95", width / F.sqrt(F.greatest(F.col(f"{m}_count"), F.lit(1)).cast("double"))
        )
    table = table.withColumn("completed", F.col(f"{metrics[0]}_count"))
    if failures is None:
        return table.withColumn("failed", F.lit(0).cast("long"))
    counts = failures.groupBy(*trial).agg(F.count("*").alias("failed"))
    return table.join(counts, trial, "left").withColumn("failed", F.coalesce("failed", F.lit(0).cast("long")))


_OPS = {
    "<=": lambda a, b: a <= b,
    "<": lambda a, b: a < b,
    ">=": lambda a, b: a >= b,
    ">": lambda a, b: a > b,
    "==": lambda a, b: a == b,
}


def rank_trials(
    board: DataFrame, primary: str, mode: str = "min",
    ties: Sequence[tuple[str, str]] = (), constraints: Sequence[tuple[str, str, float]] = (),
) -> DataFrame:
    """Trials meeting the constraints on means, best first."""
    for metric, op, value in constraints:
        if op not in _OPS:
            raise ValueError(f"unknown constraint {op!r}; use one of {list(_OPS)}")
        board = board.where(_OPS[op](F.col(f"{metric}_mean"), F.lit(float(value))))
    order = []
    for metric, direction in [(primary, mode), *ties]:
        c = F.col(f"{metric}_mean")
        order.append(c.desc_nulls_last() if direction == "max" else c.asc_nulls_last())
    return board.orderBy(*order)


def best_trial(board: DataFrame, primary: str, mode: str = "min",
               ties: Sequence[tuple[str, str]] = ()) -> DataFrame:
    return rank_trials(board, primary, mode, ties).limit(1)


def _fold(cur: tuple | None, rows: Iterable[tuple], eps: float) -> tuple | None:
    """Best of ``cur`` and the (order, rmse, r2) rows in arrival order."""
    for row in rows:
        if cur is None or row[1] < cur[1] - eps:
            cur = row
        elif abs(row[1] - cur[1]) <= eps and not math.isnan(row[2]):
            if math.isnan(cur[2]) or row[2] > cur[2] + eps:
                cur = row
    return cur


def best_run(runs: DataFrame, key: Sequence[str], order: str, rmse: str = "rmse", r2: str = "r2",
             eps: float = 0.0, *, size: int = BLOCK_ROWS, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Best run per key: lowest RMSE, a higher R2 among runs within ``eps`` of it.

    Without a tolerance this is one aggregate. With one the outcome depends on
    the order of arrival, as each accepted run moves the reference. A key's runs
    are cut into blocks; from the last run that wins in any case on, a round
    finds, for all keys at once, the next block
    holding a run that beats the current best and folds it with the blocks behind
    it, ``fold_rows`` runs in all. So no task sees more than that of a key, blocks
    without an improvement are only scanned, and there are at most as many rounds
    as a key has such stretches, however often its best changes. A missing RMSE never wins; a missing R2 loses to any.
    """
    key = list(key)
    fields = [order, rmse, r2]
    clean = runs.select(
        *key, order, finite_or_null(rmse).alias(rmse), finite_or_null(r2).alias(r2)
    ).where(F.col(rmse).isNotNull())
    if eps <= 0:
        rank = F.struct(F.col(rmse), -F.coalesce(F.col(r2), F.lit(float("-inf"))), F.col(order))
        best = clean.groupBy(*key).agg(F.min_by(F.struct(*fields), rank).alias("b"))
        return best.select(*key, "b.*")

    ranked = rank_within(clean, key, [order], "_at")
    # A run lower than all before it by more than ``eps`` is accepted whatever
    # the best was, which is one of those before. Only what follows the last
    # such run of its key has to be folded.
    lagged = over_frames(ranked, key, "_at", 1, 0, lambda w: {"_prev": F.lag(rmse).over(w)}, size=size)
    seen = stage(running(lagged, key, "_at", {"_low": ("min", F.col("_prev"))}, size=size).drop("_prev"), "runs")
    sure = F.col("_low").isNull() | (F.col(rmse) < F.col("_low") - F.lit(eps))
    winners = stage(
        seen.where(sure).groupBy(*key).agg(F.max("_at").alias("_start"), F.max_by(F.struct(*fields), "_at").alias("b")), "winners"
    )
    rows = lookup(seen, winners.select(*key, "_start"), key, "inner").where(F.col("_at") > F.col("_start"))
    rows = stage(rows.select(*key, *fields, F.expr(f"_at div {int(size)}").alias("_block")), "later")
    old = [f"_{c}" for c in fields]
    schema = StructType([*[rows.schema[k] for k in key], *[rows.schema[c] for c in fields],
                         StructField("_block", LongType())])

    def fold_block(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        cur = None if pd.isna(first[old[1]]) else tuple(first[c] for c in old)
        ordered = pdf.sort_values(order)[fields].astype({r2: float})
        best = _fold(cur, ordered.itertuples(index=False, name=None), eps)
        out = pd.DataFrame([best], columns=fields)
        for k in key:
            out[k] = first[k]
        out["_block"] = pdf["_block"].max()
        out[r2] = out[r2].astype(object).where(out[r2].notna(), None)
        return out[[f.name for f in schema]]

    stretch = max(1, fold_rows // size)
    state = winners.select(*key, "b.*", F.lit(-1).cast("long").alias("_block"))
    while True:
        now = state.select(*key, *[F.col(c).alias(o) for c, o in zip(fields, old, strict=True)],
                           F.col("_block").alias("_done"))
        ahead = lookup(rows, now, key, "inner").where(F.col("_block") > F.col("_done"))
        lower = F.col(rmse) < F.col(old[1]) - F.lit(eps)
        near = F.abs(F.col(rmse) - F.col(old[1])) <= F.lit(eps)
        richer = F.col(r2).isNotNull() & (
            F.col(old[2]).isNull() | (F.col(r2) > F.col(old[2]) + F.lit(eps))
        )
        better = ahead.where(lower | (near & richer))
        target = stage(better.groupBy(*key).agg(F.min("_block").alias("_from")), "next")
        if not target.take(1):
            return state.drop("_block")
        todo = lookup(rows, target.join(now.drop("_done"), key), key, "inner").where(
            (F.col("_block") >= F.col("_from")) & (F.col("_block") < F.col("_from") + stretch)
        ).drop("_from")
        folded = stage(todo.groupBy(*key).applyInPandas(fold_block, schema), "folded")
        state = stage(state.join(folded, key, "left_anti").unionByName(folded), "best")


def runs_union(spark, paths: Sequence[str], schema: str) -> DataFrame:
    """One row per run from the JSON metric files of many experiments."""
    return spark.read.schema(schema).json(list(paths)).withColumn("source", F.col("_metadata.file_path"))

