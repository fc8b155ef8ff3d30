"""Regression, classification and contribution metrics as aggregates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantmon.functions.numeric import col, ratio
from plantmon.functions.vectors import argmax
from plantmon.plans import stage

# Below this total variation R2 is undefined; floor of F1's divisor.
TINY = 1e-12
MOST_CLASSES = 1_000


def label_counts(df: DataFrame, split: str, label: str) -> DataFrame:
    """Rows per split and label text; a missing label keeps its own row."""
    return df.groupBy(split, F.col(label).cast("string").alias(label)).agg(F.count("*").alias("rows"))


def split_inventory(df: DataFrame, split: str, segment: str) -> DataFrame:
    """Rows per split and segment with subtotals, ``null`` marking a total."""
    return df.rollup(split, segment).agg(
        F.grouping_id().cast("long").alias("level"), F.count("*").alias("rows")
    )


def regression_metrics(
    df: DataFrame, target: str, y_true: str, y_pred: str, *, max_abs: bool = False
) -> DataFrame:
    """MSE, RMSE, MAE and R2 per target and overall (``target`` null).

    ``df`` is long: one row per sample and target. Per-target sums are formed
    once; the overall row adds them up, so each target keeps its own mean.
    """
    err = F.col(y_pred) - F.col(y_true)
    per = df.groupBy(target).agg(
        F.count("*").alias("n"),
        F.sum(err * err).alias("sse"),
        F.sum(F.abs(err)).alias("sae"),
        (F.var_pop(y_true) * F.count("*")).alias("sst"),
        F.max(F.abs(err)).alias("top"),
    )
    merged = per.groupingSets([[F.col(target)], []], F.col(target)).agg(
        F.sum("n").alias("n"), F.sum("sse").alias("sse"), F.sum("sae").alias("sae"),
        F.sum("sst").alias("sst"), F.max("top").alias("top"),
    )
    r2 = F.when(F.col("sst") > TINY, 1 - F.col("sse") / F.col("sst")).otherwise(F.lit(float("nan")))
    out = [
        target,
        F.col("n").alias("rows"),
        (F.col("sse") / F.col("n")).alias("mse"),
        F.sqrt(F.col("sse") / F.col("n")).alias("rmse"),
        (F.col("sae") / F.col("n")).alias("mae"),
        r2.alias("r2"),
    ]
    return merged.select(*out, *([F.col("top").alias("max_abs")] if max_abs else []))


def reconstruction_metrics(df: DataFrame, target: str, y_true: str, y_pred: str) -> DataFrame:
    return regression_metrics(df, target, y_true, y_pred, max_abs=True)


def horizon_rmse(df: DataFrame, step: str, y_true: str, y_pred: str, floor: float = 1e-12) -> DataFrame:
    """RMSE per horizon step and its ratio to the first step."""
    err = F.col(y_pred) - F.col(y_true)
    per = df.groupBy(step).agg(F.sqrt(F.avg(err * err)).alias("rmse"))
    head = per.agg(F.min_by("rmse", step).alias("first"), F.max("rmse").alias("top")).first()
    if head["first"] is None:  # no step has an error to compare with
        return per.withColumn("ratio_to_first", F.lit(None).cast("double")).withColumn(
            "max_ratio", F.lit(None).cast("double")
        )
    base = max(head["first"], floor)
    return per.withColumn("ratio_to_first", F.col("rmse") / F.lit(base)).withColumn(
        "max_ratio", F.lit(head["top"] / base)
    )


def weighted_horizon_loss(
    df: DataFrame, step: str, y_true: str, y_pred: str, steps: int, mode: str = "all_time",
    final_weight: float = 1.0, loss: str = "mse",
) -> DataFrame:
    """Mean loss over all steps, the last step, or with linearly growing weights."""
    err = F.col(y_pred) - F.col(y_true)
    value = err * err if loss == "mse" else F.abs(err)
    if mode == "last_only":
        return df.where(F.col(step) == steps).agg(F.avg(value).alias("loss"))
    if mode == "all_time":
        return df.agg(F.avg(value).alias("loss"))
    if mode != "weighted_last":
        raise ValueError(f"unknown loss mode {mode!r}")
    slope = (final_weight - 1.0) / (steps - 1) if steps > 1 else 0.0
    weight = (1.0 + (F.col(step) - 1) * F.lit(slope)) / F.lit((1.0 + final_weight) / 2 if steps > 1 else 1.0)
    return df.agg(F.avg(value * weight).alias("loss"))


def predicted_class(scores: str | Column) -> Column:
    """0-based class of the largest logit."""
    return argmax(col(scores))


def confusion_counts(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    return df.groupBy(F.col(y_true).alias("true_class"), F.col(y_pred).alias("pred_class")).agg(
        F.count("*").alias("rows")
    )


def class_union(counts: DataFrame) -> DataFrame:
    return counts.select(F.col("true_class").alias("class")).union(counts.select("pred_class")).distinct()


def confusion_matrix(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """Square matrix over the union of classes: one row per true class.

    A class is a column, so there are MOST_CLASSES at most; beyond that take
    :func:`confusion_counts`, which has a row for each pair that occurs.
    """
    counts = confusion_counts(df, y_true, y_pred)
    classes = [r["class"] for r in class_union(counts).orderBy("class").limit(MOST_CLASSES + 1).collect()]
    if len(classes) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes: use confusion_counts")
    cells = [
        F.coalesce(F.sum(F.when(F.col("pred_class") == c, F.col("rows"))), F.lit(0)).alias(f"pred_{c}")
        for c in classes
    ]
    every = class_union(counts).withColumnRenamed("class", "true_class")
    return every.join(counts, "true_class", "left").groupBy("true_class").agg(*cells)


def class_metrics(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """Precision, recall and F1 per class, from the confusion counts alone."""
    counts = confusion_counts(df, y_true, y_pred)
    sides = counts.select(
        F.explode(
            F.array(
                F.struct(F.col("true_class").alias("class"), F.lit("t").alias("side")),
                F.struct(F.col("pred_class").alias("class"), F.lit("p").alias("side")),
            )
        ).alias("s"),
        (F.col("true_class") == F.col("pred_class")).alias("hit"),
        "rows",
    )
    per = sides.groupBy("s.class").agg(
        F.coalesce(F.sum(F.when(F.col("hit") & (F.col("s.side") == "t"), F.col("rows"))), F.lit(0)).cast("double").alias("tp"),
        F.coalesce(F.sum(F.when(F.col("s.side") == "p", F.col("rows"))), F.lit(0)).cast("double").alias("predicted"),
        F.coalesce(F.sum(F.when(F.col("s.side") == "t", F.col("rows"))), F.lit(0)).cast("double").alias("actual"),
    )
    precision, recall = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("actual"))
    return per.select("class", precision.alias("precision"), recall.alias("recall")).withColumn(
        "f1", 2 * F.col("precision") * F.col("recall")
        / F.greatest(F.col("precision") + F.col("recall"), F.lit(TINY)),
    )


def classification_metrics(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """Accuracy and macro F1, one row."""
    counts = confusion_counts(df, y_true, y_pred)
    hits = F.sum(F.when(F.col("true_class") == F.col("pred_class"), F.col("rows")).otherwise(0))
    none = F.lit(None).cast("double")
    a = counts.agg((hits / F.sum("rows")).alias("accuracy"), none.alias("macro_f1"))
    b = class_metrics(df, y_true, y_pred).agg(none.alias("accuracy"), F.avg("f1").alias("macro_f1"))
    return a.unionByName(b).agg(F.max("accuracy").alias("accuracy"), F.max("macro_f1").alias("macro_f1"))


def contribution_metrics(
    df: DataFrame, first: Sequence[str], second: Sequence[str] | None = None, *,
    sparsity_threshold: float = 1e-6, eps: float = 1e-12,
    diagonal: Sequence[str] | None = None, fm: Sequence[str] | None = None,
    cross: Sequence[str] | None = None,
) -> DataFrame:
    """Mean magnitudes of two contribution parts, per dimension and overall.

    The overall row has a null ``dimension``. Without a second part it is all
    zero; without explicit ``fm`` and ``cross`` parts both equal the second part.
    """
    dims = len(first)
    aggs = [F.count("*").alias("n")]
    for i in range(dims):
        b = F.lit(0.0) if second is None else F.abs(F.col(second[i]))
        aggs += [
            F.sum(F.abs(F.col(first[i]))).alias(f"a{i}"), F.sum(b).alias(f"b{i}"),
            F.sum((b <= F.lit(sparsity_threshold)).cast("long")).alias(f"z{i}"),
        ]
    parts = {"diagonal": diagonal, "fm": fm, "cross": cross}
    for name, cols in parts.items():
        if cols:
            aggs.append(F.avg(sum((F.abs(F.col(c)) for c in cols[1:]), F.abs(F.col(cols[0]))) / len(cols)).alias(name))
    row = df.agg(*aggs)
    n = F.col("n")

    def entry(dim: Column, a: Column, b: Column, z: Column, count: Column) -> Column:
        return F.struct(
            dim.alias("dimension"), (a / count).alias("first_mean_abs"),
            (b / count).alias("second_mean_abs"),
            ((b / count) / F.greatest(a / count, F.lit(eps))).alias("ratio"),
            (z / count).alias("sparsity"),
        )

    plus = lambda p: sum((F.col(f"{p}{i}") for i in range(1, dims)), F.col(f"{p}0"))
    rows = [entry(F.lit(None).cast("int"), plus("a"), plus("b"), plus("z"), n * dims)]
    rows += [entry(F.lit(i), F.col(f"a{i}"), F.col(f"b{i}"), F.col(f"z{i}"), n) for i in range(dims)]
    both_missing = fm is None and cross is None
    second_mean = plus("b") / (n * dims)
    value = {
        "diagonal": F.col("diagonal") if diagonal else F.lit(0.0),
        "fm": F.col("fm") if fm else (second_mean if both_missing else F.lit(0.0)),
        "cross": F.col("cross") if cross else (second_mean if both_missing else F.lit(0.0)),
    }
    out = row.select(
        F.explode(F.array(*rows)).alias("r"),
        *[v.alias(f"{k}_mean_abs") for k, v in value.items()],
    )
    overall = F.col("r.dimension").isNull()
    return out.select("r.*", *[F.when(overall, F.col(f"{k}_mean_abs")).alias(f"{k}_mean_abs") for k in value])


def channel_contribution(df: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Mean magnitude per channel, largest first."""
    row = df.agg(*[F.avg(F.abs(F.col(c))).alias(c) for c in channels])
    long = row.unpivot([], list(channels), "channel", "magnitude")
    return long.orderBy(F.col("magnitude").desc(), "channel")


def histogram(df: DataFrame, value: str | Column, bins: int = 24) -> DataFrame:
    """Counts in equal bins between the smallest and largest value, both included."""
    v = df.select(col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    low, high = v.agg(F.min("v"), F.max("v")).first()
    if low is None:
        return v.sparkSession.createDataFrame([], "bin bigint, lower double, upper double, rows bigint")
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    spot = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("long")
    counts = v.groupBy(spot.alias("bin")).agg(F.count("*").alias("rows"))
    every = v.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return every.join(counts, "bin", "left").select(
        "bin", (F.lit(low) + F.col("bin") * width).alias("lower"),
        (F.lit(low) + (F.col("bin") + 1) * width).alias("upper"),
        F.coalesce(F.col("rows"), F.lit(0).cast("long")).alias("rows"),
    )


@dataclass(frozen=True)
class Moments:
    """Row count, mean vector and population covariance of a set of channels."""

    channels: tuple[str, ...]
    n: int
    mean: np.ndarray
    covariance: np.ndarray


WIDE = 8  # channels from which on sums are matrices
MERGED = 8  # partial sums that one task merges


@dataclass
class _Partial:
    """Sums over rows about a centre: pairs of channels counted, their sums and their products.

    ``count[i, j]`` rows hold both channels, ``total[i, j]`` sums channel i over
    them. Without missing values both are the same for every partner and kept as
    one number and one column.
    """

    rows: int
    centre: np.ndarray
    count: np.ndarray
    total: np.ndarray
    product: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray, present: np.ndarray) -> _Partial:
        seen = np.where(present & np.isfinite(values), values, 0.0)
        centre = seen.sum(axis=0) / np.maximum((present & np.isfinite(values)).sum(axis=0), 1)
        off = np.where(present, values - centre, 0.0)
        if present.all():
            return cls(len(values), centre, np.full((1, 1), float(len(values))), off.sum(axis=0)[:, None], off.T @ off)
        here = present.astype(float)
        return cls(len(values), centre, here.T @ here, off.T @ here, off.T @ off)

    def about(self, centre: np.ndarray) -> _Partial:
        """The same sums about another centre."""
        d = (self.centre - centre)[:, None]
        product = self.product + d.T * self.total + d * self.total.T + d * d.T * self.count
        return _Partial(self.rows, centre, self.count, self.total + d * self.count, product)

    def plus(self, other: _Partial) -> _Partial:
        """Sums of both, about the centre between them, which keeps the numbers small."""
        n = self.rows + other.rows
        centre = (self.centre * self.rows + other.centre * other.rows) / max(n, 1)
        a, b = self.about(centre), other.about(centre)
        return _Partial(n, centre, a.count + b.count, a.total + b.total, a.product + b.product)

    def record(self) -> list[bytes | int]:
        return [self.rows, *[np.ascontiguousarray(x, dtype=np.float64).tobytes() for x in (self.centre, self.count, self.total, self.product)]]

    @classmethod
    def read(cls, rows: int, centre: bytes, count: bytes, total: bytes, product: bytes) -> _Partial:
        p = len(centre) // 8
        count, total, product = (np.frombuffer(x) for x in (count, total, product))
        return cls(rows, np.frombuffer(centre), count.reshape((1, 1) if len(count) == 1 else (p, p)), total.reshape(p, -1), product.reshape(p, p))


_PARTIAL = "id long, n long, centre binary, count binary, total binary, product binary"
_PARTIAL_ARROW = pa.schema([("id", pa.int64()), ("n", pa.int64()), *[(c, pa.binary()) for c in ("centre", "count", "total", "product")]])


def _wide_moments(df: DataFrame, cols: list[Column], names: tuple[str, ...]) -> Moments:
    """Matrix sums per Arrow batch, merged inside a task and then in a tree of tasks."""
    p = len(cols)

    def record(key: int, part: _Partial) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([key, *part.record()], _PARTIAL_ARROW.types, strict=True)], schema=_PARTIAL_ARROW)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        whole: _Partial | None = None
        for batch in batches:
            for i in range(0, batch.num_rows, max(1, 4_000_000 // p)):
                some = batch.slice(i, max(1, 4_000_000 // p))
                present = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in some.columns], axis=1)
                values = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in some.columns], axis=1)
                part = _Partial.of(values, present)
                whole = part if whole is None else whole.plus(part)
        if whole is not None:
            yield record(TaskContext.get().partitionId(), whole)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        whole: _Partial | None = None
        for i in range(table.num_rows):
            part = _Partial.read(*[table.column(c)[i].as_py() for c in _PARTIAL_ARROW.names[1:]])
            whole = part if whole is None else whole.plus(part)
        return pa.Table.from_batches([record(key[0].as_py(), whole)])

    level = stage(df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).mapInArrow(partial, _PARTIAL), "moments")
    last = level.agg(F.max("id")).first()[0]
    if last is None:
        return Moments(names, 0, np.full(p, np.nan), np.full((p, p), np.nan))
    while last:
        level = stage(level.withColumn("id", F.expr(f"id div {MERGED}")).groupBy("id").applyInArrow(merge, _PARTIAL), "moments")
        last //= MERGED
    whole = _Partial.read(*level.first()[1:])
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = whole.centre + np.diag(np.broadcast_to(whole.total, (p, p))) / np.diag(np.broadcast_to(whole.count, (p, p)))
        covariance = whole.product / whole.count - (whole.total / whole.count) * (whole.total / whole.count).T
    return Moments(names, whole.rows, mean, covariance)


def estimate_moments(df: DataFrame, channels: Sequence[str | Column], names: Sequence[str] | None = None) -> Moments:
    """Mean and covariance in one scan; missing values are left out pair by pair.

    A few channels are p(p+1)/2 built-in aggregates, which merge central
    co-moments pairwise. From WIDE channels on, where such a plan would have
    thousands of columns, each Arrow batch adds one matrix product and the sums
    are merged in a tree. Both stay accurate when the mean is large against the
    spread.
    """
    names = tuple(names or [c for c in channels if isinstance(c, str)])
    cols = [col(c).cast("double") for c in channels]
    p = len(cols)
    if p >= WIDE:
        return _wide_moments(df, cols, names)
    aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]
    aggs += [
        F.covar_pop(cols[i], cols[j]).alias(f"c{i}_{j}") for i in range(p) for j in range(i, p)
    ]
    row = df.agg(*aggs).first()
    mean = np.array([row[f"m{i}"] for i in range(p)], dtype=float)
    cov = np.empty((p, p))
    for i in range(p):
        for j in range(i, p):
            cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
    return Moments(names, row["n"], mean, cov)


def moments_frame(spark, moments: Moments) -> DataFrame:
    rows = [
        (moments.channels[i], moments.channels[j], moments.n, float(moments.mean[i]),
         float(moments.mean[j]), float(moments.covariance[i, j]))
        for i in range(len(moments.channels)) for j in range(i, len(moments.channels))
    ]
    return spark.createDataFrame(
        rows, "left string, right string, rows bigint, left_mean double, right_mean double, covariance double"
    )


def score_summary(df: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(score).alias("mean_score"), F.max(score).alias("max_score"))
