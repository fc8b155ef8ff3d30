"""Labels, provenance and truth attached to rows by key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantmon.functions.numeric import INF, finite_or_null, is_finite
from plantmon.plans import lookup, positions, running
from plantmon.plans.ordered import BLOCK_ROWS


def attach_provenance(rows: DataFrame, provenance: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join row-level provenance on the full key, which is unique and spread."""
    return rows.join(provenance, list(keys), "left")


def attach_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Group values for the surviving rows only."""
    return rows.join(groups, list(keys), "inner")


def fault_family(df: DataFrame, fault_id: str, families: DataFrame) -> DataFrame:
    """``family`` of each fault id: 0 is normal, an undeclared id fails the job."""
    keyed = families.select(F.col("fault_id").alias(fault_id), F.col("family").alias("_family"))
    joined = lookup(df, keyed, fault_id)
    family = F.when(F.col(fault_id) == 0, F.lit("normal")).otherwise(F.col("_family"))
    unknown = F.raise_error(F.concat(F.lit("undeclared fault id "), F.col(fault_id).cast("string")))
    return joined.withColumn("family", F.coalesce(family, unknown.cast("string"))).drop("_family")


def label_by_onset(df: DataFrame, onsets: DataFrame, by: str, index: str) -> DataFrame:
    """``fault_label``: the episode's fault id from its onset on, 0 before.

    Episodes without an onset row are normal throughout.
    """
    table = onsets.select(by, F.col("onset").alias("_onset"), F.col("fault_id").alias("_fault"))
    joined = lookup(df, table, by, salt_by=[by, index])
    active = F.col(index) >= F.col("_onset")
    label = F.when(F.coalesce(active, F.lit(False)), F.col("_fault")).otherwise(F.lit(0))
    return joined.withColumn("fault_label", label.cast("long")).drop("_onset", "_fault")


def open_span(
    df: DataFrame, spans: DataFrame, by: Sequence[str], index: str, name: str = "_open",
    *, start: str = "start", size: int = BLOCK_ROWS,
) -> DataFrame:
    """Add the span of the same key that started last at or before each row.

    Span starts and rows are put on one line per key and the start is carried
    forward. For spans that do not overlap this finds the only candidate
    without a range join, however many spans or rows a key has.
    """
    marks = spans.select(
        *by, (F.col(start).cast("long") * 2).alias("_at"),
        F.struct(*[c for c in spans.columns if c not in by]).alias(name), F.lit(None).alias("_row"),
    )
    rest = [c for c in df.columns if c not in by]
    rows = df.select(
        *by, (F.col(index).cast("long") * 2 + 1).alias("_at"), F.lit(None).alias(name),
        F.struct(*rest).alias("_row"),
    )
    carried = running(
        marks.unionByName(rows), by, "_at", {name: ("last", F.col(name))}, size=2 * size
    )
    return carried.where(F.col("_row").isNotNull()).select(
        *by, *[F.col(f"_row.{c}").alias(c) for c in rest], name
    )


def label_by_interval(
    df: DataFrame, intervals: DataFrame, by: str, index: str, *, normal: int = 0,
    size: int = BLOCK_ROWS,
) -> DataFrame:
    """``fault_label`` where the index falls in one of the episode's intervals.

    ``intervals`` has ``start`` and ``stop`` (both inclusive) and ``fault_id``;
    intervals of one episode do not overlap.
    """
    located = open_span(df, intervals, [by], index, size=size)
    inside = F.coalesce(F.col(index) <= F.col("_open.stop"), F.lit(False))
    label = F.when(inside, F.col("_open.fault_id")).otherwise(F.lit(normal))
    return located.select(*df.columns, label.cast("long").alias("fault_label"))


def pair_labels(
    features: DataFrame, labels: DataFrame, on: Sequence[str], label: str,
    *, case: Column | None = None, required: bool = False,
) -> DataFrame:
    """Join features with labels stored under a matching key.

    With ``case`` a positive label becomes the case id and a missing one the
    case id too; with ``required`` a missing label fails the job.
    """
    have = labels.select(*on, F.col(label).alias("_label"))
    joined = features.join(have, list(on), "left")
    value = F.col("_label")
    if case is not None:
        value = F.when(value.isNull(), case).otherwise(F.when(value > 0, case).otherwise(F.lit(0)))
    if required:
        value = F.coalesce(value, F.raise_error(F.lit("feature row without a label")).cast("int"))
    return joined.withColumn(label, value.cast("long")).drop("_label")


def unlabelled_keys(features: DataFrame, labels: DataFrame, on: Sequence[str]) -> DataFrame:
    return features.select(*on).distinct().join(labels.select(*on).distinct(), list(on), "left_anti")


def zip_series(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two recordings on the rows both have."""
    return left.join(right, list(keys), "inner")


def rows_in_episodes(
    scores: DataFrame, episodes: DataFrame, by: Sequence[str], index: str, *, size: int = BLOCK_ROWS
) -> DataFrame:
    """Scores whose index lies in ``[raw_start, raw_stop)`` of an episode."""
    ids = [c for c in episodes.columns if c not in {*by, "raw_start", "raw_stop"}]
    located = open_span(scores, episodes, by, index, start="raw_start", size=size)
    return located.where(F.col(index) < F.col("_open.raw_stop")).select(
        *scores.columns, *[F.col(f"_open.{c}").alias(c) for c in ids]
    )


def scores_outside(scores: DataFrame, stage_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scores at keys the stage does not hold; expected empty."""
    return scores.join(stage_rows.select(*keys), list(keys), "left_anti")


def bind_truth(outputs: DataFrame, truth: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Labels joined to outputs after scoring; each output needs exactly one.

    A missing or repeated label fails the job when the label is read.
    """
    table = truth.groupBy(*keys).agg(F.count(F.lit(1)).alias("_labels"), F.first(label).alias("_label"))
    joined = outputs.join(table, list(keys), "left")
    kind = truth.schema[label].dataType
    fault = F.when(F.col("_labels").isNull(), F.lit("an output has no label")).when(
        F.col("_labels") > 1, F.lit("an output has several labels")
    )
    checked = F.when(fault.isNotNull(), F.raise_error(fault).cast(kind)).otherwise(F.col("_label"))
    return joined.withColumn(label, checked).drop("_labels", "_label")


def truth_coverage(outputs: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Matched, unlabelled and unscored keys; the last two must be 0."""
    a = outputs.select(*keys, F.lit(1).alias("_o"))
    b = truth.select(*keys, F.lit(1).alias("_t"))
    full = a.join(b, list(keys), "full_outer")
    return full.agg(
        F.count(F.when(F.col("_o").isNotNull() & F.col("_t").isNotNull(), 1)).alias("matched"),
        F.count(F.when(F.col("_t").isNull(), 1)).alias("unlabelled"),
        F.count(F.when(F.col("_o").isNull(), 1)).alias("unscored"),
    )


def attach_counts(table: DataFrame, events: DataFrame, on: str, name: str) -> DataFrame:
    """Event counts per key, 0 where there are none."""
    counts = events.groupBy(on).agg(F.count("*").alias(name))
    return table.join(counts, on, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def anchor_asof(
    df: DataFrame, by: Sequence[str], index: str, accepted: Column, *, size: int = BLOCK_ROWS
) -> DataFrame:
    """Latest accepted anchor at or before each row, and its age."""
    marked = running(
        df, by, index, {"anchor_index": ("max", F.when(accepted, F.col(index)))}, size=size
    )
    return marked.withColumn("anchor_age", F.col(index) - F.col("anchor_index"))


def replay_compare(
    expected: DataFrame, actual: DataFrame, keys: Sequence[str], value: str = "score",
    tolerance: float = 1e-7,
) -> DataFrame:
    """One row: key mismatches, largest absolute difference, verdict.

    Values must be of one kind: a number against a missing value or an infinity,
    or infinities of different sign, do not match. Missing matches missing.
    """
    kind = F.when(is_finite(value), 0).when(F.col(value) == INF, 1).when(F.col(value) == -INF, 2).otherwise(3)
    a = expected.select(*keys, finite_or_null(value).alias("_a"), kind.alias("_kind_a"), F.lit(1).alias("_in_a"))
    b = actual.select(*keys, finite_or_null(value).alias("_b"), kind.alias("_kind_b"), F.lit(1).alias("_in_b"))
    full = a.join(b, list(keys), "full_outer")
    row = full.agg(
        F.count(F.when(F.col("_in_a").isNull(), 1)).alias("only_actual"),
        F.count(F.when(F.col("_in_b").isNull(), 1)).alias("only_expected"),
        F.coalesce(F.max(F.abs(F.col("_a") - F.col("_b"))), F.lit(0.0)).alias("max_abs_delta"),
        F.count(F.when(F.col("_kind_a") != F.col("_kind_b"), 1)).alias("_unlike"),
    )
    return row.withColumn(
        "matches",
        (F.col("only_actual") == 0) & (F.col("only_expected") == 0)
        & (F.col("_unlike") == 0) & (F.col("max_abs_delta") <= F.lit(tolerance)),
    ).drop("_unlike")


def segment_frame(
    df: DataFrame, segment: str, order: str, *, label: object | None = None, size: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``time`` (row number in the segment) and an optional scalar label."""
    timed = positions(df, [segment], order, "time", size=size)
    return timed if label is None else timed.withColumn("label", F.lit(label))


def case_map(pairs: Mapping[object, object]) -> Column:
    """Literal map column for a short, declared list of pairs."""
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])

