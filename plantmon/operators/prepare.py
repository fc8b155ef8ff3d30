"""Chains of operators: a prepared data set, and the protocol on normal data."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantmon.operators import calibrate, clean, masks, metrics, outliers, scale, scores, splits
from plantmon.plans import lookup, stage


@dataclass(frozen=True)
class Prepared:
    """Prepared rows with their ``split``, the fitted scaler and all summaries."""

    data: DataFrame
    scaler: scale.Scaler
    summaries: dict[str, DataFrame] = field(default_factory=dict)


def prepare(
    df: DataFrame,
    by: Sequence[str],
    index: str,
    channels: Sequence[str],
    *,
    split: Callable[[DataFrame], DataFrame],
    missing: str = "interpolate_then_drop",
    outlier_rule: outliers.OutlierRule | None = None,
    scaler: str = "standard",
    label: str | None = None,
    mask: Callable[[DataFrame], DataFrame] | None = None,
) -> Prepared:
    """Missing values, split, outliers, scaling, masks: always in this order.

    Statistics come from train rows; outliers are removed there and only marked
    elsewhere. Each step that feeds several others is staged once.
    """
    cleaned = stage(split(clean.handle_missing(df, by, index, channels, missing)), "cleaned")
    summaries = {"missing": clean.missing_summary(df, cleaned, channels, missing)}
    summaries["split"] = cleaned.groupBy("split").agg(F.count("*").alias("rows"))
    if label is not None:
        summaries["labels"] = metrics.label_counts(cleaned, "split", label)
    if outlier_rule is not None:
        flagged = outliers.fit_apply_outliers(cleaned, channels, outlier_rule, by, index)
        summaries["outliers"] = outliers.outlier_report(flagged, outlier_rule, ["split"])
        summaries["removed"] = outliers.removed_ids(flagged, [*by, index])
        cleaned = flagged.where(~F.col("removed")).drop("severity", "removed")
    fitted = scale.fit_scaler(cleaned.where(F.col("split") == "train"), channels, scaler)
    summaries["scaler"] = fitted.to_frame(df.sparkSession)
    data = fitted.transform(cleaned)
    if mask is not None:
        data = mask(data)
        summaries["masks"] = masks.mask_summary(data, channels, ["split"])
    return Prepared(data, fitted, summaries)


SCORED_STAGES = ("detection_calibration", "attribution_calibration", "frozen_normal_test")


@dataclass(frozen=True)
class Protocol:
    """Long scores with threshold and alarm, and both calibrations."""

    scores: DataFrame
    detection: DataFrame
    attribution: DataFrame


def normal_protocol(
    df: DataFrame, pos: str, raw: str, channels: Sequence[str], plan: splits.StagePlan, risk: float,
    *, components: int | None = None,
) -> Protocol:
    """PCA on train, score scales on estimate, thresholds on whole calibration episodes.

    Every alarm uses the detection threshold; the attribution calibration is
    fitted on its own stage and never raises one.
    """
    streams = ["hotelling_t2", "spe_q"]
    rows = splits.assign_stage(df, pos, plan).where(F.col("stage").isNotNull())
    model = scores.fit_pca(rows.where("stage = 'train'"), channels, components)
    scored = scores.pca_scores(rows.where("stage <> 'train'"), model)
    scored = stage(scored.select(pos, raw, "stage", "stage_start", *streams), "scored")
    rms = scored.where("stage = 'estimate'").agg(
        *[F.sqrt(F.avg(F.col(s) * F.col(s))).alias(s) for s in streams]
    ).first()
    unit = {s: rms[s] if rms[s] is not None and rms[s] > scale.CONSTANT else 1.0 for s in streams}
    scaled = scored.withColumns({s: F.col(s) / F.lit(unit[s]) for s in streams})
    scaled = scaled.where(F.col("stage").isin(list(SCORED_STAGES)))

    episodes = splits.stage_episodes(scaled, pos, raw, plan).where("complete")
    number = F.expr(f"(`{pos}` - stage_start) div {int(plan.episode_length)}")
    inside = lookup(scaled.withColumn("stage_episode", number),
                    episodes.select("stage", "stage_episode"), ["stage", "stage_episode"], "inner", hot_share=None)
    maxima = stage(
        inside.groupBy("stage", "stage_episode").agg(*[F.max(s).alias(s) for s in streams])
        .unpivot(["stage", "stage_episode"], streams, "score_name", "max_score"),
        "maxima",
    )
    fitted = {
        s: calibrate.conformal_thresholds(maxima.where(F.col("stage") == s), risk, streams=streams)
        for s in splits.CALIBRATION_STAGES
    }
    long = scaled.unpivot([pos, raw, "stage"], streams, "score_name", "score")
    alarms = calibrate.apply_thresholds(long, fitted["detection_calibration"], strict=True)
    return Protocol(alarms, fitted["detection_calibration"], fitted["attribution_calibration"])
