"""Monitoring statistics, fitted models applied as literal expressions."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantmon.functions.numeric import INF, col, exceeds, number_or_null
from plantmon.functions.vectors import l1, l2, matvec, subtract, total
from plantmon.operators.metrics import estimate_moments
from plantmon.operators.scale import CONSTANT, Scaler
from plantmon.plans import exact_quantiles

# Variance floor of the diagonal T2 and spread floor of the
# eligibility score.
T2_VARIANCE_FLOOR = 1e-8
SPREAD_FLOOR = 1e-12


def reconstruction_score(true: Sequence[str | Column], pred: Sequence[str | Column]) -> Column:
    """Row mean of squared errors."""
    errs = [col(t) - col(p) for t, p in zip(true, pred, strict=True)]
    return total([e * e for e in errs]) / len(errs)


def q_score(values: Sequence[str | Column]) -> Column:
    """Row mean of squares; used for both Q and SPE."""
    return total([col(v) * col(v) for v in values]) / len(values)


@dataclass(frozen=True)
class DiagonalT2:
    """Sum of squared deviations over the variance of each channel."""

    center: tuple[float, ...]
    variance: tuple[float, ...]

    def score(self, values: Sequence[str | Column]) -> Column:
        terms = []
        for v, m, s in zip(values, self.center, self.variance, strict=True):
            d = col(v) - F.lit(m)
            terms.append(d * d * F.lit(1.0 / max(s, T2_VARIANCE_FLOOR)))
        return total(terms)


def fit_t2(normal: DataFrame, values: Sequence[str | Column]) -> DiagonalT2:
    return fit_t2_many(normal, [values])[0]


def fit_t2_many(normal: DataFrame, groups: Sequence[Sequence[str | Column]]) -> list[DiagonalT2]:
    """One reference per group of channels, all from one scan."""
    aggs = []
    for g, values in enumerate(groups):
        for i, v in enumerate(values):
            aggs += [F.avg(number_or_null(v)).alias(f"m{g}_{i}"), F.var_pop(number_or_null(v)).alias(f"v{g}_{i}")]
    row = normal.agg(*aggs).first()
    return [
        DiagonalT2(tuple(row[f"m{g}_{i}"] for i in range(len(values))),
                   tuple(row[f"v{g}_{i}"] for i in range(len(values))))
        for g, values in enumerate(groups)
    ]


def percentile_threshold(scores: DataFrame, score: str | Column, far: float) -> float:
    """The (1 - far) percentile of normal scores; missing ones do not count."""
    return exact_quantiles(scores, {"s": number_or_null(score)}, [1.0 - far])["s"][0]


def inequality_factor(far: float) -> float:
    return math.sqrt((1.0 - far) / max(far, 1e-12))


def inequality_threshold(scores: DataFrame, score: str | Column, far: float) -> float:
    """Mean plus the one-sided distribution-free multiple of the deviation.

    Missing scores do not count; without any score the threshold is +inf.
    """
    value = number_or_null(score)
    row = scores.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s")).first()
    return _bound(row["m"], row["s"], far)


def _bound(mean: float | None, deviation: float | None, far: float) -> float:
    return INF if mean is None else mean + inequality_factor(far) * deviation


# Legal parts of a procedure name ``mode-statistic-threshold``.
MODES = ("re", "lv", "custom")
STATISTICS = ("t2", "q", "spe", "custom")
THRESHOLDS = ("kde", "ineq", "pdf")
# Accepted names of the covariance estimate.
COVARIANCE_METHODS = ("diag", "diagonal", "lstsq", "least_squares", "pinv", "pseudo_inverse")


@dataclass(frozen=True)
class Procedure:
    mode: str
    statistic: str
    threshold: str

    @property
    def name(self) -> str:
        return f"{self.mode}-{self.statistic.upper()}-{self.threshold}"


def parse_procedure(text: str) -> Procedure:
    parts = text.strip().lower().split("-")
    if len(parts) != 3:
        raise ValueError(f"procedure {text!r} is not mode-statistic-threshold")
    for part, legal in zip(parts, (MODES, STATISTICS, THRESHOLDS), strict=True):
        if part not in legal:
            raise ValueError(f"{part!r} in procedure {text!r} is not one of {legal}")
    return Procedure(*parts)


@dataclass(frozen=True)
class FittedProcedure:
    procedure: Procedure
    score: Column
    threshold: float


def fit_procedures(
    normal: DataFrame,
    procedures: Sequence[str],
    far: float,
    *,
    true: Sequence[str] = (),
    pred: Sequence[str] = (),
    latent: Sequence[str] = (),
    custom: str | Column | None = None,
    covariance_method: str = "diag",
) -> list[FittedProcedure]:
    """Fit reference and threshold of every procedure on normal rows.

    Every legal ``covariance_method`` gives the diagonal reference.

    ``kde`` and ``pdf`` both mean the (1 - far) percentile. All T2 references
    come from one scan and all thresholds from one more per kind.
    """
    if covariance_method.strip().lower() not in COVARIANCE_METHODS:
        raise ValueError(f"covariance method {covariance_method!r} is not one of {COVARIANCE_METHODS}")
    parsed = [parse_procedure(p) for p in procedures]
    scores: dict[str, Column] = {}
    pending: dict[str, list[Column]] = {}
    for p in parsed:
        if p.mode == "custom" or p.statistic == "custom":
            if custom is None:
                raise ValueError("a custom procedure needs a custom score")
            scores[p.name] = col(custom)
            continue
        values = (
            [col(t) - col(q) for t, q in zip(true, pred, strict=True)]
            if p.mode == "re" else [col(c) for c in latent]
        )
        if not values:
            raise ValueError(f"procedure {p.name} has no input columns")
        if p.statistic == "t2":
            pending[p.name] = values
        else:
            scores[p.name] = q_score(values)
    if pending:
        fitted = fit_t2_many(normal, list(pending.values()))
        scores |= {n: m.score(v) for (n, v), m in zip(pending.items(), fitted, strict=True)}
    by_rank = {p.name: scores[p.name] for p in parsed if p.threshold != "ineq"}
    by_moment = {p.name: scores[p.name] for p in parsed if p.threshold == "ineq"}
    cut: dict[str, float] = {}
    if by_rank:
        safe = {f"s{i}": number_or_null(s) for i, s in enumerate(by_rank.values())}
        found = exact_quantiles(normal, safe, [1.0 - far])
        cut |= {n: found[f"s{i}"][0] for i, n in enumerate(by_rank)}
    if by_moment:
        row = normal.agg(
            *[F.avg(number_or_null(s)).alias(f"m{i}") for i, s in enumerate(by_moment.values())],
            *[F.stddev_pop(number_or_null(s)).alias(f"d{i}") for i, s in enumerate(by_moment.values())],
        ).first()
        cut |= {n: _bound(row[f"m{i}"], row[f"d{i}"], far) for i, n in enumerate(by_moment)}
    return [FittedProcedure(p, scores[p.name], cut[p.name]) for p in parsed]


def detection_counts(alarm: Column, label: Column) -> list[Column]:
    """Conditional sums: false alarms, misses, detections, normal and fault rows."""
    normal, fault = label == 0, label == 1
    return [
        F.count(F.when(alarm & normal, 1)).alias("false_alarms"),
        F.count(F.when(~alarm & fault, 1)).alias("missed"),
        F.count(F.when(alarm & fault, 1)).alias("detected"),
        F.count(F.when(normal, 1)).alias("normal_rows"),
        F.count(F.when(fault, 1)).alias("fault_rows"),
    ]


def detection_rates(counts: DataFrame) -> DataFrame:
    """FAR, MDR and FDR; a missing class divides by 1."""
    normal = F.greatest(F.col("normal_rows"), F.lit(1))
    fault = F.greatest(F.col("fault_rows"), F.lit(1))
    return counts.withColumns(
        {
            "far": F.col("false_alarms") / normal,
            "mdr": F.col("missed") / fault,
            "fdr": F.col("detected") / fault,
        }
    )


def detection_metrics(
    df: DataFrame, score: str | Column, threshold: float | Column, label: str | Column,
    by: Sequence[str] = (),
) -> DataFrame:
    """Counts and rates of the strict alarm ``score > threshold``.

    A missing score is no alarm, so on a fault row it counts as missed.
    """
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    counts = df.groupBy(*by).agg(*detection_counts(exceeds(score, limit), col(label)))
    return detection_rates(counts)


def evaluate_procedures(df: DataFrame, fitted: Sequence[FittedProcedure], label: str) -> DataFrame:
    """One row of detection metrics per procedure, from one scan.

    Every count of every procedure is an aggregate of the same pass; the
    one-row result is then unfolded, so data rows are not multiplied.
    """
    settings = {f.procedure.name: (f.score, f.threshold) for f in fitted}
    return sweep(df, settings, label)


def sweep(df: DataFrame, settings: Mapping[str, tuple[Column, float]], label: str) -> DataFrame:
    y = col(label)
    aggs, rows = [], []
    names = ("false_alarms", "missed", "detected")
    for i, (_, (score, limit)) in enumerate(settings.items()):
        cols = detection_counts(exceeds(score, F.lit(float(limit))), y)[:3]
        aggs += [c.alias(f"{n}_{i}") for n, c in zip(names, cols, strict=True)]
    aggs += [F.count(F.when(y == 0, 1)).alias("normal_rows"), F.count(F.when(y == 1, 1)).alias("fault_rows")]
    row = df.agg(*aggs)
    for i, (name, (_, limit)) in enumerate(settings.items()):
        rows.append(F.struct(
            F.lit(name).alias("procedure"), F.lit(float(limit)).alias("threshold"),
            *[F.col(f"{n}_{i}").alias(n) for n in names],
        ))
    long = row.select(F.explode(F.array(*rows)).alias("r"), "normal_rows", "fault_rows")
    return detection_rates(long.select("r.*", "normal_rows", "fault_rows"))


def detection_aggregate(metrics: DataFrame) -> DataFrame:
    """Mean rates over procedures."""
    return metrics.agg(F.avg("far").alias("afar"), F.avg("mdr").alias("amdr"), F.avg("fdr").alias("afdr"))


def fit_sweep(normal: DataFrame, scores: Mapping[str, Column], fars: Sequence[float]) -> dict[str, tuple[Column, float]]:
    """Percentile thresholds of many (score, FAR) settings from the same two scans."""
    found = exact_quantiles(
        normal, {f"s{i}": number_or_null(s) for i, s in enumerate(scores.values())}, [1.0 - f for f in fars]
    )
    return {
        f"{name}@{far}": (score, found[f"s{i}"][j])
        for i, (name, score) in enumerate(scores.items())
        for j, far in enumerate(fars)
    }


# --- principal components ----------------------------------------------------


@dataclass(frozen=True)
class Pca:
    scaler: Scaler
    channels: tuple[str, ...]
    components: np.ndarray
    eigenvalues: np.ndarray

    def latent(self) -> list[Column]:
        unit = [self.scaler.forward(c) for c in self.channels]
        return matvec(self.components, unit)

    def t2(self) -> Column:
        return total([z * z / F.lit(float(v)) for z, v in zip(self.latent(), self.eigenvalues, strict=True)])

    def q(self) -> Column:
        """Sum, not mean, of squared residuals."""
        p = len(self.channels)
        unit = [self.scaler.forward(c) for c in self.channels]
        residual = matvec(np.eye(p) - self.components.T @ self.components, unit)
        return total([r * r for r in residual])


def fit_pca(train: DataFrame, channels: Sequence[str], components: int | None = None) -> Pca:
    """Loadings of the standardised channels from the covariance partial sums.

    Only the p x p covariance reaches the driver.
    """
    moments = estimate_moments(train, channels)
    n, p = moments.n, len(channels)
    if n < 2:
        raise ValueError("PCA needs at least two rows")
    spread = np.sqrt(np.diag(moments.covariance))
    safe = np.where(spread > CONSTANT, spread, 1.0)
    scaler = Scaler(
        "standard", dict(zip(channels, moments.mean.tolist(), strict=True)),
        dict(zip(channels, safe.tolist(), strict=True)), rows=n,
    )
    limit = min(p, n - 1)
    k = max(1, min(limit, (p + 1) // 2)) if components is None else int(components)
    if k > limit:
        raise ValueError(f"at most {limit} components are available")
    correlation = moments.covariance / np.outer(safe, safe)
    values, vectors = np.linalg.eigh(correlation)
    order = np.argsort(values)[::-1][:k]
    eigenvalues = np.maximum(values[order] * n / (n - 1), CONSTANT)
    return Pca(scaler, tuple(channels), vectors[:, order].T, eigenvalues)


def pca_scores(df: DataFrame, model: Pca) -> DataFrame:
    return df.withColumn("hotelling_t2", model.t2()).withColumn("spe_q", model.q())


# --- linear forecasts --------------------------------------------------------


@dataclass(frozen=True)
class LinearForecast:
    """Least-squares weights per target column."""

    inputs: tuple[str, ...]
    weights: dict[str, tuple[float, ...]]
    intercept: dict[str, float]

    def predict(self, target: str) -> Column:
        terms = [F.lit(w) * F.col(c) for w, c in zip(self.weights[target], self.inputs, strict=True)]
        return total(terms) + F.lit(self.intercept[target])


def fit_linear(train: DataFrame, inputs: Sequence[str], targets: Sequence[str]) -> LinearForecast:
    """Normal equations from one scan of covariance sums."""
    m = estimate_moments(train, [*inputs, *targets])
    k = len(inputs)
    weights, intercept = {}, {}
    for j, t in enumerate(targets):
        w, *_ = np.linalg.lstsq(m.covariance[:k, :k], m.covariance[:k, k + j], rcond=None)
        weights[t] = tuple(float(x) for x in w)
        intercept[t] = float(m.mean[k + j] - m.mean[:k] @ w)
    return LinearForecast(tuple(inputs), weights, intercept)


def one_step_error(pairs: DataFrame, predicted: Sequence[str | Column], target: Sequence[str]) -> Column:
    """Mean squared one-step prediction error at the target index."""
    return reconstruction_score([F.col(t) for t in target], predicted)


# --- online scores -----------------------------------------------------------


def fit_eligibility(estimate: DataFrame, channels: Sequence[str]) -> Callable[[], Column]:
    """RMS of the measurements in units of the estimate stage's spread."""
    row = estimate.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(channels)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(channels)],
    ).first()
    terms = []
    for i, c in enumerate(channels):
        unit = (F.col(c) - F.lit(row[f"m{i}"])) / F.lit(max(row[f"s{i}"], SPREAD_FLOOR))
        terms.append(unit * unit)
    return lambda: F.sqrt(total(terms) / len(terms))


def residual_norm(target: Column, prediction: Column) -> Column:
    """Euclidean norm of an array residual."""
    return l2(subtract(target, prediction))


def guard_score(observed: Column, predicted: Column, scale: float) -> Column:
    """Residual norm over its scale; 0 without a prediction."""
    return F.when(predicted.isNull(), F.lit(0.0)).otherwise(l2(subtract(observed, predicted)) / F.lit(scale))


def guard_threshold(predicted: Column, control: Column, *, floor: float, anchor: float,
                    intercept: float, input_weight: float, quantile: float) -> Column:
    """Static guard limit; unresolved (+inf) without a prediction."""
    limit = F.lit(floor + anchor + quantile) + F.lit(intercept) + F.lit(input_weight) * l1(control)
    return F.when(predicted.isNull(), F.lit(INF)).otherwise(limit)


# --- whitening ---------------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    channels: tuple[str, ...]
    mean: np.ndarray
    operator: np.ndarray
    shrinkage: float
    eigenvalues: np.ndarray
    condition: float
    stable: bool
    samples: int
    reason: str | None = None

    def whitened(self) -> list[Column]:
        centred = [F.col(c) - F.lit(float(m)) for c, m in zip(self.channels, self.mean, strict=True)]
        return matvec(self.operator, centred)

    def project(self) -> list[Column]:
        """Operator applied without centring, as a branch would."""
        return matvec(self.operator, [F.col(c) for c in self.channels])


def fit_whitening(
    estimate: DataFrame, channels: Sequence[str], *, ridge: float = 1e-6, floor: float = 1e-8,
    minimum_samples: int = 2, max_condition: float = 1e8,
) -> Whitening:
    """Shrunk inverse square root of the covariance, or identity when unsafe.

    The shrinkage towards a scaled identity has a closed form in the covariance
    and the mean fourth power of the centred norm, so two scans of partial sums
    suffice.
    """
    p = len(channels)
    m = estimate_moments(estimate, channels)
    need = max(minimum_samples, p + 1)
    if m.n < need:
        return Whitening(tuple(channels), m.mean, np.eye(p), 0.0, np.ones(p), 1.0, False, m.n,
                         f"{m.n} samples are fewer than {need}")
    squares = total([(F.col(c) - F.lit(float(mu))) * (F.col(c) - F.lit(float(mu)))
                     for c, mu in zip(channels, m.mean, strict=True)])
    fourth = estimate.agg(F.avg(squares * squares)).first()[0]
    frob = float(np.sum(m.covariance**2))
    mu = float(np.trace(m.covariance) / p)
    spread = (frob - p * mu * mu) / p
    noise = min((fourth - frob) / (p * m.n), spread)
    shrink = 0.0 if noise == 0 or spread == 0 else noise / spread
    cov = (1.0 - shrink) * m.covariance + shrink * mu * np.eye(p) + ridge * np.eye(p)
    values, vectors = np.linalg.eigh(0.5 * (cov + cov.T))
    kept = np.maximum(values, floor)
    condition = float(kept.max() / kept.min())
    operator = (vectors / np.sqrt(kept)) @ vectors.T
    stable = bool(np.isfinite(condition) and condition <= max_condition and np.isfinite(operator).all())
    return Whitening(
        tuple(channels), m.mean, operator if stable else np.eye(p), float(shrink), kept[::-1],
        condition, stable, m.n, None if stable else "covariance is numerically unstable",
    )


@dataclass(frozen=True)
class Branch:
    name: str
    matrix: tuple[tuple[float, ...], ...]
    enabled: bool = True


def branch_scores(df: DataFrame, residual: Sequence[str], branches: Sequence[Branch]) -> DataFrame:
    """``score_<branch>``: norm of every enabled branch's projection."""
    cols = [F.col(c) for c in residual]
    out = {}
    for b in branches:
        if b.enabled:
            out[f"score_{b.name}"] = F.sqrt(total([z * z for z in matvec(b.matrix, cols)]))
    return df.withColumns(out)


def branch_scores_array(vector: Column, branches: Sequence[Branch]) -> dict[str, Column]:
    """The same on an array column, for stacked residuals of any width."""
    out = {}
    for b in branches:
        if b.enabled:
            rows = [
                F.aggregate(F.zip_with(vector, F.lit([float(w) for w in row]), lambda x, w: x * w),
                            F.lit(0.0), lambda a, x: a + x)
                for row in b.matrix
            ]
            out[b.name] = l2(F.array(*rows))
    return out

