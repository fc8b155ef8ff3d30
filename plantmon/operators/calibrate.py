"""Whole-episode calibration, envelopes and dynamic thresholds.

``+inf`` marks a threshold that cannot be resolved. It stays a number: a null
would turn the strict alarm comparison into null as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantmon.functions.numeric import INF, exceeds, is_finite
from plantmon.plans import lookup, positions, rank_within, running

# States of a calibration.
READY, INSUFFICIENT, INCOMPLETE = "ready", "insufficient_resolution", "incomplete_evidence"
# Fixed value: relative slack of the support range check.
SUPPORT_SLACK = 1e-12


def alarm(score: str = "score", threshold: str = "threshold") -> Column:
    """Strict exceedance; a missing score never alarms."""
    return exceeds(score, threshold)


def episode_max(scores: DataFrame, episode: Sequence[str], stream: str = "score_name",
                score: str = "score") -> DataFrame:
    """Largest score per episode and stream."""
    return scores.groupBy(*episode, stream).agg(F.max(score).alias("max_score"))


def conformal_rank(m: Column, risk: float) -> Column:
    """ceil((m + 1)(1 - risk))."""
    return F.ceil((m + 1) * F.lit(1.0 - risk)).cast("long")


def conformal_thresholds(maxima: DataFrame, risk: float, stream: str = "score_name",
                         value: str = "max_score", streams: Sequence[str] | None = None) -> DataFrame:
    """Per stream the rank-th smallest episode maximum, +inf beyond the last.

    Ranks come from a distributed sort, as a stream may have any number of
    episodes. The threshold row of a stream survives even when no maximum has
    the wanted rank. ``streams`` declares the streams: one without any complete
    episode gets its row too, and one that is not declared fails the job.
    """
    ranked = rank_within(maxima.select(stream, value), [stream], [value], "_k", size_name="episodes")
    ranked = ranked.withColumn("rank", conformal_rank(F.col("episodes"), risk))
    picked = F.max(F.when(F.col("_k") == F.col("rank") - 1, F.col(value)))
    table = ranked.groupBy(stream).agg(
        F.first("episodes").alias("episodes"), F.first("rank").alias("rank"),
        F.coalesce(picked, F.lit(INF)).alias("threshold"),
    )
    if streams is not None:
        declared = maxima.sparkSession.createDataFrame([(s,) for s in streams], f"`{stream}` string")
        both = declared.withColumn("_declared", F.lit(True)).join(table, stream, "full_outer")
        unknown = F.raise_error(F.concat(F.lit("stream is not declared: "), F.col(stream))).cast("double")
        limit = F.when(F.col("_declared").isNull(), unknown).otherwise(F.coalesce("threshold", F.lit(INF)))
        n = F.coalesce("episodes", F.lit(0).cast("long"))
        table = both.select(
            stream, n.alias("episodes"), conformal_rank(n, risk).alias("rank"), limit.alias("threshold")
        )
    return table.withColumn("finite", is_finite("threshold"))


def apply_thresholds(
    scores: DataFrame, thresholds: DataFrame, stream: str = "score_name", strict: bool = False
) -> DataFrame:
    """Scores with their stream's threshold and alarm; every score stays.

    A stream without a threshold row has the threshold +inf and no alarm, or
    fails the job if ``strict``.
    """
    joined = lookup(scores, thresholds.select(stream, F.col("threshold").alias("_t")), stream)
    missing = F.raise_error(F.concat(F.lit("no threshold for stream "), F.col(stream))).cast("double")
    limit = F.coalesce("_t", missing if strict else F.lit(INF))
    return joined.withColumn("threshold", limit).drop("_t").withColumn("alarm", alarm())


def expected_coordinates(episodes: DataFrame, coordinates: DataFrame, episode: str) -> DataFrame:
    """Every coordinate each calibration episode must hold.

    The score family is declared up front, so its coordinates ride along as a
    literal array. Checking coverage does not need this grid, see
    :func:`score_coverage`.
    """
    types = dict(coordinates.dtypes)
    grid = F.array(*[
        F.struct(*[F.lit(row[f]).cast(types[f]).alias(f) for f in coordinates.columns])
        for row in coordinates.distinct().collect()
    ])
    return episodes.select(episode).distinct().select(episode, F.inline(grid))


def score_coverage(scores: DataFrame, episode: str, coordinates: DataFrame) -> DataFrame:
    """Per episode: missing, repeated and undeclared coordinates, one row each.

    Counting distinct declared coordinates against their number finds missing
    ones without building the full expected grid.
    """
    fields = coordinates.columns
    declared = coordinates.distinct()
    need = declared.count()
    counts = scores.groupBy(episode, *fields).agg(F.count("*").alias("_n"))
    known = lookup(counts, declared.withColumn("_known", F.lit(True)), fields)
    known = known.withColumn("_known", F.coalesce(F.col("_known"), F.lit(False)))
    return known.groupBy(episode).agg(
        (F.lit(need) - F.count(F.when(F.col("_known"), 1))).alias("missing"),
        F.count(F.when(F.col("_n") > 1, 1)).alias("repeated"),
        F.count(F.when(~F.col("_known"), 1)).alias("undeclared"),
    )


def conformal_status(maxima: DataFrame, risk: float, value: str = "max_score",
                     coverage: DataFrame | None = None) -> DataFrame:
    """Rank, resolution, status and quantile of one calibration, one row.

    Any episode with incomplete coverage or an unsupported (non-finite) maximum
    makes the evidence incomplete; too few episodes make it insufficient.
    """
    ranked = rank_within(maxima.select(F.col(value).alias("v")), [], ["v"], "_k")
    m = F.coalesce(F.max("_k") + 1, F.lit(0))
    head = ranked.agg(
        m.alias("episodes"), conformal_rank(m, risk).alias("rank"),
        F.count(F.when(~is_finite("v"), 1)).alias("unsupported"),
    ).first()
    n, rank = head["episodes"], head["rank"]
    broken = head["unsupported"]
    if coverage is not None:
        bad = (F.col("missing") > 0) | (F.col("repeated") > 0) | (F.col("undeclared") > 0)
        broken += coverage.where(bad).count()
    status = INCOMPLETE if broken else (INSUFFICIENT if rank > n else READY)
    quantile = INF if status != READY else ranked.where(F.col("_k") == rank - 1).first()["v"]
    return maxima.sparkSession.createDataFrame(
        [(n, rank, 1.0 / (n + 1), status, float(quantile))],
        "episodes bigint, rank bigint, resolution double, status string, quantile double",
    )


def age_envelope(samples: DataFrame, age: str, value: str, quantile: float,
                 minimum_samples: int = 1) -> DataFrame:
    """Upper curve over reference age: an order statistic per age, made monotone.

    Ages must run from 0 without a hole and each needs enough samples.
    """
    ranked = rank_within(samples.select(age, value), [age], [value], "_k", size_name="_n")
    at = F.ceil(F.lit(quantile) * (F.col("_n") - 1))
    per = ranked.groupBy(age).agg(
        F.first("_n").alias("samples"), F.max(F.when(F.col("_k") == at, F.col(value))).alias("raw")
    )
    numbered = positions(per, [], age, "_at")
    table = running(numbered, [], age, {"envelope": ("max", F.col("raw"))})
    fault = (
        F.when(F.col(age) != F.col("_at"), F.lit("ages must run from 0 without a hole"))
        .when(F.col("samples") < minimum_samples, F.lit("too few samples for an age"))
    )
    checked = F.when(fault.isNotNull(), F.raise_error(fault).cast("double")).otherwise(F.col("envelope"))
    return table.select(age, "samples", "raw", checked.alias("envelope"))


NORMS = ("input_norm", "input_delta_norm", "exogenous_delta_norm")


def region_support(samples: DataFrame, region: str, minimum_samples: int = 1,
                   norms: Sequence[str] = NORMS) -> DataFrame:
    """Range of every norm seen per region; regions with too few samples drop out."""
    aggs = [F.count("*").alias("samples")]
    for n in norms:
        aggs += [F.min(n).alias(f"min_{n}"), F.max(n).alias(f"max_{n}")]
    return samples.groupBy(region).agg(*aggs).where(F.col("samples") >= minimum_samples)


def input_envelope(df: DataFrame, support: DataFrame, coefficients: DataFrame, region: str,
                   norms: Sequence[str] = NORMS) -> DataFrame:
    """Linear envelope of the norms, +inf outside the region's support.

    ``coefficients`` holds ``c0..cK`` per region: an intercept, then one per norm.
    """
    table = support.join(coefficients, region, "inner")
    joined = lookup(df, table, region)
    inside = F.col("samples").isNotNull()
    value = F.col("c0")
    for i, n in enumerate(norms):
        low, high = F.col(f"min_{n}"), F.col(f"max_{n}")
        slack = F.lit(SUPPORT_SLACK) * F.greatest(F.lit(1.0), F.abs(low), F.abs(high))
        inside = inside & (F.col(n) >= low - slack) & (F.col(n) <= high + slack)
        value = value + F.col(f"c{i + 1}") * F.col(n)
    supported = F.coalesce(inside & is_finite(value) & (value >= 0), F.lit(False))
    return joined.select(
        *df.columns, supported.alias("input_supported"),
        F.when(supported, value).otherwise(F.lit(INF)).alias("input_envelope"),
    )


def age_lookup(df: DataFrame, envelope: DataFrame, age: str) -> DataFrame:
    """Envelope value of each row's reference age, +inf beyond the curve."""
    table = envelope.select(age, F.col("envelope").alias("_env"))
    joined = lookup(df, table, age)
    return joined.select(
        *df.columns, F.col("_env").isNotNull().alias("age_supported"),
        F.coalesce("_env", F.lit(INF)).alias("age_envelope"),
    )


def deterministic_radius(steps: DataFrame, window: Sequence[str], input_env: str, age_env: str,
                         norm: str) -> DataFrame:
    """Sum over a window's steps of (input + age envelope) times the block norm.

    One unsupported step leaves the whole radius at +inf.
    """
    source = F.col(input_env) + F.col(age_env)
    value = F.sum(F.when(is_finite(source), source * F.col(norm)))
    broken = F.count(F.when(~is_finite(source), 1)) > 0
    radius = F.when(broken | ~is_finite(value), F.lit(INF)).otherwise(value)
    return steps.groupBy(*window).agg(F.count("*").alias("steps"), radius.alias("radius"))


def normalized_excess(statistic: str, anchor: str, radius: str, scale: str) -> Column:
    """max(0, T - anchor - radius) / scale, +inf where the radius is unsupported."""
    over = F.greatest(F.lit(0.0), F.col(statistic) - F.col(anchor) - F.col(radius)) / F.col(scale)
    return F.when(is_finite(radius), over).otherwise(F.lit(INF))


def dynamic_threshold(
    df: DataFrame, calibration: DataFrame | None, on: Sequence[str] = (), *, floor: float = 0.0,
    statistic: str = "statistic", anchor: str = "gamma_anchor", radius: str = "radius",
    scale: str = "scale",
) -> DataFrame:
    """Threshold, alarm, status and reason per row.

    ``calibration`` carries ``quantile`` and ``status`` per ``on`` key. A
    missing or unready calibration or an unsupported radius disables the alarm
    with a +inf threshold instead of guessing.
    """
    on = list(on)
    if calibration is None:
        joined = df.withColumn("quantile", F.lit(INF)).withColumn("calibration_status", F.lit(None).cast("string"))
    else:
        table = calibration.select(*on, "quantile", F.col("status").alias("calibration_status"))
        if on:
            joined = lookup(df, table, on)
        else:
            row = table.first()
            joined = df.withColumn("quantile", F.lit(float(row["quantile"]))).withColumn(
                "calibration_status", F.lit(row["calibration_status"]))
    value = F.greatest(
        F.lit(floor), F.col(anchor) + F.col(radius) + F.col(scale) * F.col("quantile")
    )
    reason = (
        F.when(~is_finite(radius), F.lit("radius unsupported"))
        .when(F.col("calibration_status").isNull(), F.lit("calibration missing"))
        .when(F.col("calibration_status") != READY, F.col("calibration_status"))
        .when(~is_finite(value), F.lit("threshold not representable"))
    )
    out = joined.withColumn("reason", reason)
    ready = F.col("reason").isNull()
    out = out.withColumn("threshold", F.when(ready, value).otherwise(F.lit(INF)))
    return out.withColumns(
        {
            "alarm": exceeds(statistic, "threshold"),
            "threshold_status": F.when(ready, F.lit("ready")).otherwise(F.lit("disabled")),
        }
    ).drop("quantile", "calibration_status")

