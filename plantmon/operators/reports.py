"""Per-episode reports derived from pointwise decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantmon.functions.numeric import infinity_text
from plantmon.operators.isolate import OUTCOMES
from plantmon.plans import lookup, over_frames
from plantmon.plans.ordered import BLOCK_ROWS


def first_alarm(df: DataFrame, by: Sequence[str], index: str, alarm: Column, onset: Column) -> DataFrame:
    """Index of the first alarm at or after the onset, null without one."""
    hit = F.when(alarm & (F.col(index) >= onset), F.col(index))
    return df.groupBy(*by).agg(F.min(hit).alias("first_alarm"))


def detection_report_columns(index: str, alarm: Column, onset: Column) -> list[Column]:
    before, after = F.col(index) < onset, F.col(index) >= onset
    return [
        F.count("*").alias("row_count"),
        F.count(F.when(before, 1)).alias("pre_fault_row_count"),
        F.count(F.when(after, 1)).alias("post_onset_row_count"),
        F.count(F.when(before & alarm, 1)).alias("pre_fault_alarm_count"),
        F.count(F.when(after & alarm, 1)).alias("post_onset_alarm_count"),
        F.min(F.when(after & alarm, F.col(index))).alias("first_post_onset_alarm"),
    ]


def finish_detection_report(counts: DataFrame, onset: str) -> DataFrame:
    pre, post = F.col("pre_fault_row_count"), F.col("post_onset_row_count")
    return counts.withColumns(
        {
            "pre_fault_alarm_rate": F.when(pre > 0, F.col("pre_fault_alarm_count") / F.greatest(pre, F.lit(1))).otherwise(F.lit(0.0)),
            "post_onset_alarm_rate": F.when(post > 0, F.col("post_onset_alarm_count") / F.greatest(post, F.lit(1))),
            "detection_delay_steps": F.col("first_post_onset_alarm") - F.col(onset),
        }
    )


def episode_detection_report(
    df: DataFrame, onsets: DataFrame, episode: str, index: str, alarm: str = "alarm"
) -> DataFrame:
    """Pre- and post-onset alarm counts and rates, first alarm and delay.

    Plain aggregates: a huge episode is pre-aggregated where its rows lie.
    """
    joined = lookup(df, onsets.select(episode, "onset", "fault_id"), episode, "inner",
                    salt_by=[episode, index])
    counts = joined.groupBy(episode, "fault_id", "onset").agg(
        *detection_report_columns(index, F.col(alarm), F.col("onset"))
    )
    return finish_detection_report(counts, "onset")


def json_list(values: Column) -> Column:
    """Sorted text list as compact JSON."""
    return F.to_json(F.array_sort(values))


def episode_isolation_report(df: DataFrame, episode: Sequence[str]) -> DataFrame:
    """Outcome counts, certified rows and the families reported or considered.

    The candidate sets are unfolded before the distinct union, which is bounded
    by the number of families.
    """
    outcome = F.col("isolation_outcome")
    counts = [F.count(F.when(outcome == o, 1)).alias(o) for o in OUTCOMES]
    main = df.groupBy(*episode).agg(
        *counts, F.count(F.when(F.col("isolation_certified"), 1)).alias("certified_row_count"),
        json_list(F.collect_set("reported_family")).alias("reported_families"),
    )
    sets = (
        df.select(*episode, F.explode("candidates").alias("_c"))
        .groupBy(*episode).agg(json_list(F.collect_set("_c")).alias("candidate_ids"))
    )
    return main.join(sets, list(episode), "left").withColumn(
        "candidate_ids", F.coalesce("candidate_ids", F.lit("[]"))
    )


def score_trajectory(df: DataFrame, columns: Sequence[str], threshold: str = "threshold",
                     lists: Sequence[str] = ()) -> DataFrame:
    """Flat table for plotting: lists as JSON, an unresolved threshold as text."""
    out = []
    for c in columns:
        if c == threshold:
            out.append(infinity_text(c).alias(c))
        elif c in lists:
            out.append(F.to_json(c).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def trace_violations(
    trace: DataFrame, by: Sequence[str], order: str, *, episode: str = "episode", stage: str = "stage",
    index: str = "raw_index", reset: str = "reset_count", identity: str = "monitor_identity",
    size: int = BLOCK_ROWS,
) -> DataFrame:
    """Monitor trace entries that break its rules; expected empty.

    The reset counter grows by 0 or 1, exactly where episode, stage or index
    breaks, and one trace has one monitor identity.
    """
    def frames(w):
        return {f"_p_{c}": F.lag(c).over(w) for c in (episode, stage, index, reset, identity)}

    seen = over_frames(trace, by, order, 1, 0, frames, size=size)
    step = F.col(reset) - F.col(f"_p_{reset}")
    broke = (
        (F.col(episode) != F.col(f"_p_{episode}")) | (F.col(stage) != F.col(f"_p_{stage}"))
        | (F.col(index) != F.col(f"_p_{index}") + 1)
    )
    checks = {
        "reset_step": ~step.isin(0, 1),
        "reset_mismatch": broke != (step > 0),
        "identity_changed": F.col(identity) != F.col(f"_p_{identity}"),
    }
    found = F.filter(
        F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in checks.items()]),
        lambda v: v.isNotNull(),
    )
    return seen.select(*trace.columns, F.explode(found).alias("violation"))
