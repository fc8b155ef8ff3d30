"""Outlier detection: fitted on train rows, marked or removed anywhere."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantmon.functions.numeric import finite_or_null
from plantmon.functions.vectors import max_of, median
from plantmon.plans import exact_quantiles, over_frames, rank_within, row_positions, stage
from plantmon.plans.ordered import BLOCK_ROWS

# Spread floor, MAD-to-sigma factor and default cut-offs.
SPREAD_FLOOR = 1e-12
MAD_FACTOR = 0.6745
IQR_MULTIPLIER = 1.5
Z_THRESHOLD = 3.0
MAD_THRESHOLD = 4.5


@dataclass(frozen=True)
class LocalRule:
    """Hampel-like rule on the neighbours within ``radius`` rows."""

    radius: int = 8
    mad_threshold: float = 6.0
    min_side: int = 3
    both_sides: bool = True
    min_abs: float = 0.0
    force_abs: float | None = None


@dataclass(frozen=True)
class OutlierRule:
    method: str = "iqr"
    iqr_multiplier: float = IQR_MULTIPLIER
    z_threshold: float = Z_THRESHOLD
    mad_threshold: float = MAD_THRESHOLD
    tail_percent: float = 0.01
    tail_side: str = "both"
    max_removal_ratio: float = 0.1
    min_remaining_rows: int = 0
    local: LocalRule | None = None

    def tail_fraction(self) -> float:
        """A tail of at most 1 is a fraction, above 1 it is a percentage.

        A tail of half the rows or more would mark everything.
        """
        share = self.tail_percent if self.tail_percent <= 1 else self.tail_percent / 100.0
        if not 0 <= share < 0.5:
            raise ValueError(f"tail_percent={self.tail_percent} is not under half of the rows")
        return share


@dataclass(frozen=True)
class OutlierModel:
    """Fitted statistics per channel, applied as literals."""

    rule: OutlierRule
    columns: tuple[str, ...]
    stats: dict[str, tuple[float, ...]] = field(default_factory=dict)

    def channel_severity(self, c: str) -> Column:
        x, rule, s = finite_or_null(c), self.rule, self.stats[c]
        if rule.method == "iqr":
            q1, q3 = s
            iqr = max(q3 - q1, SPREAD_FLOOR)
            out = F.greatest((F.lit(q1) - x) / F.lit(iqr), (x - F.lit(q3)) / F.lit(iqr))
            return out - F.lit(rule.iqr_multiplier)
        if rule.method == "zscore":
            mean, std = s
            return F.abs((x - F.lit(mean)) / F.lit(max(std, SPREAD_FLOOR))) - F.lit(rule.z_threshold)
        if rule.method == "mad":
            mid, mad = s
            scaled = F.lit(MAD_FACTOR) * F.abs(x - F.lit(mid)) / F.lit(max(mad, SPREAD_FLOOR))
            return scaled - F.lit(rule.mad_threshold)
        low, high = s
        width = F.lit(max(high - low, SPREAD_FLOOR))
        below, above = (F.lit(low) - x) / width, (x - F.lit(high)) / width
        return {"min": below, "max": above, "both": F.greatest(below, above)}[rule.tail_side]

    def severity(self) -> Column:
        """Largest channel severity of the row, floored at 0."""
        worst = max_of([self.channel_severity(c) for c in self.columns])
        return F.greatest(F.coalesce(worst, F.lit(0.0)), F.lit(0.0))


def fit_outliers(train: DataFrame, columns: Sequence[str], rule: OutlierRule) -> OutlierModel:
    values = {c: finite_or_null(c) for c in columns}
    if rule.method == "iqr":
        q = exact_quantiles(train, values, [0.25, 0.75])
        stats = {c: tuple(q[c]) for c in columns}
    elif rule.method == "zscore":
        row = train.agg(
            *[F.avg(v).alias(f"m_{c}") for c, v in values.items()],
            *[F.stddev_pop(v).alias(f"s_{c}") for c, v in values.items()],
        ).first()
        stats = {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in columns}
    elif rule.method == "mad":
        mid = exact_quantiles(train, values, [0.5])
        off = {c: F.abs(v - F.lit(mid[c][0])) for c, v in values.items()}
        mad = exact_quantiles(train, off, [0.5])
        stats = {c: (mid[c][0], mad[c][0]) for c in columns}
    elif rule.method == "tail_percent":
        if rule.tail_side not in ("min", "max", "both"):
            raise ValueError("tail_side is one of min, max, both")
        p = rule.tail_fraction()
        q = exact_quantiles(train, values, [p, 1.0 - p])
        stats = {c: tuple(q[c]) for c in columns}
    else:
        raise ValueError(f"unknown outlier method {rule.method!r}")
    return OutlierModel(rule, tuple(columns), stats)


def _distances(values: Column, center: Column) -> Column:
    return F.transform(values, lambda v: F.abs(v - center))


def local_severity(
    df: DataFrame,
    by: Sequence[str],
    index: str,
    columns: Sequence[str],
    rule: LocalRule,
    name: str = "local_severity",
    *,
    size: int = BLOCK_ROWS,
) -> DataFrame:
    """Severity against the median of the neighbours, by row position in the key.

    A neighbourhood holds at most ``2 * radius`` rows, so the collected arrays
    are bounded by the rule.
    """
    r, pos = max(1, rule.radius), "_at"
    placed = row_positions(df, by, index, pos, size=size)

    def frames(w):
        left, right = w.rowsBetween(-r, -1), w.rowsBetween(1, r)
        out = {"_left": F.count(F.lit(1)).over(left), "_right": F.count(F.lit(1)).over(right)}
        for i, c in enumerate(columns):
            x = finite_or_null(c)
            out[f"_n{i}"] = F.concat(F.collect_list(x).over(left), F.collect_list(x).over(right))
        return out

    framed = over_frames(placed, by, pos, r, r, frames, size=size)
    if rule.both_sides:
        enough = (F.col("_left") >= rule.min_side) & (F.col("_right") >= rule.min_side)
    else:
        enough = F.col("_left") + F.col("_right") >= rule.min_side
    for i, _ in enumerate(columns):
        framed = framed.withColumn(f"_m{i}", median(F.col(f"_n{i}")))
    worst = []
    for i, c in enumerate(columns):
        mid = F.col(f"_m{i}")
        off = F.abs(finite_or_null(c) - mid)
        mad = median(_distances(F.col(f"_n{i}"), mid))
        score = F.lit(MAD_FACTOR) * off / F.greatest(mad, F.lit(SPREAD_FLOOR))
        hit = (score > rule.mad_threshold) & (off >= rule.min_abs)
        if rule.force_abs is not None:
            hit = hit | (off >= rule.force_abs)
        worst.append(F.when(hit, score))
    value = F.when(enough, F.coalesce(max_of(worst), F.lit(0.0))).otherwise(F.lit(0.0))
    return framed.select(*df.columns, value.alias(name))


def score_outliers(
    df: DataFrame,
    model: OutlierModel,
    by: Sequence[str],
    index: str,
    *,
    size: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``severity`` and ``marked``; the local rule joins in when configured."""
    severity = model.severity()
    if model.rule.local is not None:
        df = local_severity(df, by, index, model.columns, model.rule.local, "_local", size=size)
        severity = F.greatest(severity, F.col("_local"))
    scored = df.withColumn("severity", severity).drop("_local")
    return scored.withColumn("marked", F.col("severity") > 0)


def _to_go(scored: DataFrame, keys: Sequence[str], ratio: float) -> tuple[Column, int]:
    """Which of the ``marked`` rows go, as a condition, and how many rows stay."""
    counts = scored.agg(F.count("*").alias("n"), F.count(F.when(F.col("marked"), 1)).alias("m")).first()
    cap = math.floor(counts["n"] * ratio)
    if ratio > 0 and cap == 0 and counts["m"]:
        cap = 1
    left = counts["n"] - min(counts["m"], cap)
    if counts["m"] <= cap:
        return F.col("marked"), left
    if cap == 0:
        return F.lit(False), left
    marked = scored.where("marked").select(*keys, "severity")
    ranked = rank_within(marked, [], [F.col("severity").desc(), *keys], "_rank")
    # Rows are as bad as the last one to go, or worse: one row decides for all.
    last = ranked.where(F.col("_rank") == cap - 1).first()
    types = dict(scored.dtypes)
    place = F.struct((-F.col("severity")).alias("s"), *keys)
    bound = F.struct(F.lit(-last["severity"]).alias("s"), *[F.lit(last[k]).cast(types[k]).alias(k) for k in keys])
    return F.col("marked") & (place <= bound), left


def cap_removals(
    scored: DataFrame, keys: Sequence[str], ratio: float, name: str = "removed"
) -> DataFrame:
    """Flag the marked rows to remove: at most ``floor(n * ratio)``, worst first.

    With a positive ratio at least one row may go. Ties in severity fall back
    to the key. Marked rows alone are ranked, by a distributed sort.
    """
    return scored.withColumn(name, _to_go(scored, keys, ratio)[0])


def fit_apply_outliers(
    df: DataFrame,
    columns: Sequence[str],
    rule: OutlierRule,
    by: Sequence[str],
    index: str,
    *,
    split: str = "split",
    train: str = "train",
    remove_elsewhere: bool = False,
    remove_train: bool = True,
    mark_elsewhere: bool = True,
    size: int = BLOCK_ROWS,
) -> DataFrame:
    """Fit on the train split; remove there, only mark other splits.

    Without ``remove_train`` train rows are only marked; without
    ``mark_elsewhere`` other splits are left alone.

    Adds ``severity``, ``marked`` and ``removed``; the caller filters on
    ``removed``, which leaves the removed ids available for the report.
    """
    model = fit_outliers(df.where(F.col(split) == train), columns, rule)
    scored = stage(score_outliers(df, model, [*by, split], index, size=size), "outliers")
    keys = [*by, index]
    mine = F.coalesce(F.col(split) == train, F.lit(False))
    gone = F.lit(False)
    if remove_train:
        gone, left = _to_go(scored.where(mine), keys, rule.max_removal_ratio)
        _check_remaining(left, rule)
    else:
        _check_remaining(scored.where(mine).count(), rule)
    if not mark_elsewhere:
        scored = scored.withColumns({
            "severity": F.when(mine, F.col("severity")).otherwise(0.0), "marked": mine & F.col("marked")
        })
    elsewhere = F.lit(False)
    if remove_elsewhere and mark_elsewhere:
        elsewhere, _ = _to_go(scored.where(~mine), keys, rule.max_removal_ratio)
    return scored.where(F.col(split).isNotNull()).withColumn("removed", F.when(mine, gone).otherwise(elsewhere))


def _check_remaining(left: int, rule: OutlierRule) -> None:
    if left < rule.min_remaining_rows:
        raise ValueError(
            f"outlier removal leaves {left} rows, fewer than min_remaining_rows={rule.min_remaining_rows}"
        )


def multipass_outliers(
    df: DataFrame,
    columns: Sequence[str],
    rule: OutlierRule,
    by: Sequence[str],
    index: str,
    passes: int = 2,
    *,
    size: int = BLOCK_ROWS,
) -> DataFrame:
    """Refit on the survivors up to ``passes`` times; severity is that of the pass a row fell in.

    The IQR rule measures the distance beyond the fence here, as it does in a
    single pass. A pass is one more fitted model: whether a row has survived, and
    its severity, follow from the models so far in one projection of the input,
    and no pass writes or joins rows. The local rule looks at surviving
    neighbours, so with it a pass writes the survivors with their new severity,
    next to the rows that fell before; still nothing is joined.
    """
    keys = [*by, index]
    local = rule.local is not None
    state = stage(df, "rows").withColumn("severity", F.lit(0.0)).withColumn("marked", F.lit(False))
    severity = F.lit(0.0)
    for _ in range(max(1, passes)):
        alive = state.where(~F.col("marked")).drop("severity", "marked")
        if alive.count() <= rule.min_remaining_rows:
            raise ValueError("outlier removal would leave too few rows")
        model = fit_outliers(alive, columns, rule)
        if local:
            scored = score_outliers(alive, model, by, index, size=size)
            fallen = state.where("marked").select(*scored.columns)
            after = stage(scored.unionByName(fallen), "pass")
            more = after.where("marked").count() > state.where("marked").count()
            state = after
        else:
            severity = F.when(severity > 0, severity).otherwise(model.severity())
            state = state.select(*df.columns, severity.alias("severity"), (severity > 0).alias("marked"))
            more = not alive.where(model.severity() > 0).isEmpty()
        if not more:
            break
    gone, left = _to_go(state, keys, rule.max_removal_ratio)
    _check_remaining(left, rule)
    return state.withColumn("removed", gone)


def outlier_report(flagged: DataFrame, rule: OutlierRule, by: Sequence[str] = ()) -> DataFrame:
    """Row counts per split (or over the whole table)."""
    return flagged.groupBy(*by).agg(
        F.lit(rule.method).alias("method"),
        F.count("*").alias("original_rows"),
        F.count(F.when(F.col("marked"), 1)).alias("marked_rows"),
        F.count(F.when(F.col("removed"), 1)).alias("removed_rows"),
        F.count(F.when(~F.col("removed"), 1)).alias("remaining_rows"),
    )


def removed_ids(flagged: DataFrame, keys: Sequence[str]) -> DataFrame:
    return flagged.where("removed").select(*keys, "severity")
