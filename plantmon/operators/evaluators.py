"""Named evaluations, so that a report can be chosen by configuration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from plantmon.operators import metrics, runs, scores

EVALUATORS: dict[str, Callable[..., DataFrame]] = {
    "regression": metrics.regression_metrics,
    "reconstruction": metrics.reconstruction_metrics,
    "classification": metrics.classification_metrics,
    "contribution": metrics.contribution_metrics,
    "fault_detection": scores.detection_metrics,
    "leaderboard": runs.leaderboard,
}


def register_evaluator(name: str, fn: Callable[..., DataFrame]) -> None:
    """Add a table function under a new name."""
    if name in EVALUATORS:
        raise ValueError(f"evaluator {name!r} is already registered")
    EVALUATORS[name] = fn


def evaluate(name: str, df: DataFrame, **options: object) -> DataFrame:
    """Run the named evaluator on a table."""
    if name not in EVALUATORS:
        raise ValueError(f"unknown evaluator {name!r}; use one of {sorted(EVALUATORS)}")
    return EVALUATORS[name](df, **options)
