"""Train-only scaling. A fitted scaler is one row per channel."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantmon.functions.numeric import col, finite_or_null

# Fixed value: a channel with no more spread than this counts as constant.
CONSTANT = 1e-12


@dataclass(frozen=True)
class Scaler:
    """Fitted centre and scale per channel; applied as literals, without a join."""

    method: str
    center: dict[str, float]
    scale: dict[str, float]
    constant: tuple[str, ...] = ()
    rows: int = 0
    feature_range: tuple[float, float] = field(default=(0.0, 1.0))

    def forward(self, c: str, value: str | Column | None = None) -> Column:
        v = col(c if value is None else value)
        if self.method == "none":
            return v
        unit = (v - F.lit(self.center[c])) / F.lit(self.scale[c])
        if self.method == "standard":
            return unit
        low, high = self.feature_range
        return unit * F.lit(high - low) + F.lit(low)

    def backward(self, c: str, value: str | Column | None = None) -> Column:
        v = col(c if value is None else value)
        if self.method == "none":
            return v
        if self.method == "minmax":
            low, high = self.feature_range
            v = (v - F.lit(low)) / F.lit(high - low)
        return v * F.lit(self.scale[c]) + F.lit(self.center[c])

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.forward(c) for c in self.center})

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.backward(c) for c in self.center})

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (c, self.method, float(self.center[c]), float(self.scale[c]), c in self.constant)
            for c in self.center
        ]
        return spark.createDataFrame(
            rows, "channel string, method string, center double, scale double, constant boolean"
        )

    def summary(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(self.method, self.rows, len(self.center), len(self.constant))],
            "method string, rows bigint, channels bigint, constant_columns bigint",
        )


def fit_scaler(
    train: DataFrame,
    columns: Sequence[str],
    method: str = "standard",
    feature_range: tuple[float, float] = (0.0, 1.0),
) -> Scaler:
    """Fit on the given rows only; one scan, one row of partial aggregates."""
    method = method.strip().lower()
    if method not in ("none", "standard", "minmax"):
        raise ValueError(f"unknown scaling method {method!r}; use none, standard or minmax")
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        v = finite_or_null(c)
        if method == "standard":
            aggs += [F.avg(v).alias(f"c{i}"), F.stddev_pop(v).alias(f"s{i}")]
        elif method == "minmax":
            aggs += [F.min(v).alias(f"c{i}"), (F.max(v) - F.min(v)).alias(f"s{i}")]
        else:
            aggs += [F.lit(0.0).alias(f"c{i}"), F.lit(1.0).alias(f"s{i}")]
    row = train.agg(*aggs).first()
    center = {c: row[f"c{i}"] for i, c in enumerate(columns)}
    spread = {c: row[f"s{i}"] for i, c in enumerate(columns)}
    empty = [c for c in columns if center[c] is None]
    if empty:
        raise ValueError(f"no finite training value in {empty}")
    constant = () if method == "none" else tuple(c for c in columns if spread[c] <= CONSTANT)
    scale = {c: 1.0 if c in constant else spread[c] for c in columns}
    return Scaler(method, center, scale, constant, row["rows"], feature_range)


def fit_stream_scale(scores: DataFrame, name: str = "score_name", score: str = "score",
                     floor: float = CONSTANT) -> DataFrame:
    """RMS of each named score stream, 1 where it vanishes."""
    rms = F.sqrt(F.avg(F.col(score) * F.col(score)))
    return scores.groupBy(name).agg(F.when(rms > floor, rms).otherwise(F.lit(1.0)).alias("scale"))
