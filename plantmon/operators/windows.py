"""Windowed samples: history, target and control blocks cut from contiguous rows.

A window is legal when its rows carry consecutive index values and share the
partitioning columns, so segment changes and deleted rows both break it. Arrays
are rows x channels; their length is fixed by the window, never by the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantmon.functions.vectors import l2, pack
from plantmon.plans import over_frames, rank_within
from plantmon.plans.ordered import BLOCK_ROWS

# Accepted names of the three sequence tasks and the default
# horizons of control windows.
SEQUENCE_TASKS = {
    "n_to_1": "n_to_1",
    "many_to_one": "n_to_1",
    "sequence_to_one": "n_to_1",
    "last": "n_to_1",
    "one": "n_to_1",
    "n_to_n": "n_to_n",
    "many_to_many": "n_to_n",
    "sequence_to_sequence": "n_to_n",
    "all": "n_to_n",
    "n_to_m": "n_to_m",
    "future": "n_to_m",
}
PAST_HORIZON, PREDICTION_HORIZON, CONTROL_HORIZON = 10, 20, 5


def global_positions(df: DataFrame, keys: Sequence[str], name: str = "row_number") -> DataFrame:
    """0-based row number over the whole table, in key order."""
    return rank_within(df, [], list(keys), name)


def cut_windows(
    df: DataFrame,
    by: Sequence[str],
    index: str,
    blocks: Mapping[str, tuple[Sequence[str | Column], int, int]],
    *,
    keep: Sequence[str] = (),
    where: Column | None = None,
    size: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per legal window start.

    ``blocks`` maps an output name to ``(channels, offset, length)`` relative to
    the start row. ``by`` holds every column that must not change inside a
    window.
    """
    first = min(0, *[o for _, o, _ in blocks.values()]) if blocks else 0
    last = max([o + n - 1 for _, o, n in blocks.values()])
    used = [c for cols, _, _ in blocks.values() for c in cols if isinstance(c, str)]
    extra = [c for c in df.columns if c in {*used, *keep, *by, index}]
    free = any(not isinstance(c, str) for cols, _, _ in blocks.values() for c in cols)
    slim = df if free or where is not None else df.select(*extra)

    def frames(w):
        out = {
            "_first": F.lag(index, -first).over(w) if first else F.col(index),
            "_last": F.lead(index, last).over(w) if last else F.col(index),
        }
        for name, (cols, offset, length) in blocks.items():
            out[name] = F.collect_list(pack(cols)).over(w.rowsBetween(offset, offset + length - 1))
        return out

    framed = over_frames(slim, by, index, -first, max(last, 0), frames, size=size)
    legal = (F.col("_first") == F.col(index) + first) & (F.col("_last") == F.col(index) + last)
    if where is not None:
        legal = legal & where
    return framed.where(legal).select(*by, index, *keep, *blocks)


def window_dynamic(
    df: DataFrame, by: Sequence[str], index: str, controls: Sequence[str], outputs: Sequence[str],
    lookback: int, horizon: int, *, size: int = BLOCK_ROWS,
) -> DataFrame:
    """Flattened control and output history, and the future after it."""
    both = [*controls, *outputs]
    cut = cut_windows(
        df, by, index,
        {"_h": (both, 0, lookback), "_f": (both, lookback, horizon),
         "_y": (outputs, lookback, horizon)},
        size=size,
    )
    return cut.select(
        *by, F.col(index).alias("start"), F.flatten("_h").alias("history"),
        F.flatten("_f").alias("future"), F.flatten("_y").alias("target"),
    )


def sequence_blocks(
    task: str, inputs: Sequence[str], targets: Sequence[str], length: int,
    target_length: int | None, offset: int,
) -> dict[str, tuple[Sequence[str], int, int]]:
    name = SEQUENCE_TASKS.get(task.strip().lower().replace("-", "_"))
    if name is None:
        raise ValueError(f"unknown sequence task {task!r}; use one of {sorted(set(SEQUENCE_TASKS.values()))}")
    if name == "n_to_n":
        return {"x": (inputs, 0, length), "target": (targets, offset, length)}
    rows = 1 if name == "n_to_1" else (target_length or 1)
    return {"x": (inputs, 0, length), "target": (targets, length + offset, rows)}


def window_sequence(
    df: DataFrame, by: Sequence[str], index: str, inputs: Sequence[str], targets: Sequence[str],
    length: int, task: str = "n_to_1", *, target_length: int | None = None, offset: int = 0,
    stride: int = 1, stride_on: str | None = None, squeeze: bool = False, size: int = BLOCK_ROWS,
) -> DataFrame:
    """Input rows and target rows of a sequence task.

    ``stride`` counts rows of ``stride_on`` (the index by default; a global row
    number from :func:`global_positions` strides over the whole table).
    """
    blocks = sequence_blocks(task, inputs, targets, length, target_length, offset)
    grid = stride_on or index
    where = (F.col(grid) % stride == 0) if stride > 1 else None
    cut = cut_windows(df, by, index, blocks, keep=[grid] if grid != index else [], where=where, size=size)
    at = blocks["target"][1]
    target = F.get("target", F.lit(0)) if squeeze and blocks["target"][2] == 1 else F.col("target")
    return cut.select(
        *by, F.col(index).alias("start"), (F.col(index) + at).alias("target_start"), "x",
        target.alias("target"),
    )


def window_mpc(
    df: DataFrame, by: Sequence[str], index: str, *,
    state: Sequence[str] = (), output: Sequence[str] = (), control: Sequence[str] = (),
    reference: Sequence[str] = (), target: Sequence[str] | None = None,
    past: int = PAST_HORIZON, prediction: int = PREDICTION_HORIZON, control_steps: int = CONTROL_HORIZON,
    size: int = BLOCK_ROWS,
) -> DataFrame:
    """Past matrix state|output|control|reference and the horizons that follow.

    The span covers the longer of the prediction and the control horizon.
    """
    goal = list(target) if target is not None else list(output or state)
    blocks = {"past": ([*state, *output, *control, *reference], 0, past),
              "target_future": (goal, past, prediction)}
    if control:
        blocks["control_future"] = (list(control), past, control_steps)
    if reference:
        blocks["reference_future"] = (list(reference), past, prediction)
    cut = cut_windows(df, by, index, blocks, size=size)
    return cut.withColumnRenamed(index, "start")


def window_multi_horizon(
    df: DataFrame, by: Sequence[str], index: str, controls: Sequence[str], measurements: Sequence[str],
    history: int, horizon: int, *, keep: Sequence[str] = (), size: int = BLOCK_ROWS,
) -> DataFrame:
    """Past and future blocks and, per step, the history shifted to that step.

    Keyed by the anchor index, the first future row.
    """
    cut = cut_windows(
        df, by, index,
        {"_u": (controls, 0, history + horizon), "_y": (measurements, 0, history + horizon)},
        keep=keep, size=size,
    )
    steps = F.sequence(F.lit(1), F.lit(horizon))

    def shifted(name: str) -> Column:
        return F.transform(steps, lambda s: F.slice(F.col(name), s, F.lit(history)))

    return cut.select(
        *by, *keep, (F.col(index) + history).alias("anchor_index"),
        F.slice("_u", 1, history).alias("past_u"),
        F.slice("_y", 1, history).alias("past_y"),
        F.slice("_u", history + 1, horizon).alias("future_u"),
        F.slice("_y", history + 1, horizon).alias("target_future"),
        F.get("_y", F.lit(history - 1)).alias("current_y"),
        shifted("_u").alias("target_past_u"),
        shifted("_y").alias("target_past_y"),
    )


def window_targets(windows: DataFrame, target: str = "target") -> DataFrame:
    """Flattened target vector per sample."""
    keys = [c for c in windows.columns if c in ("episode", "segment", "start")]
    nested = dict(windows.dtypes)[target].startswith("array<array")
    return windows.select(*keys, (F.flatten(target) if nested else F.col(target)).alias("target"))


def window_summary(windows: DataFrame, x: str, target: str) -> DataFrame:
    """Sample count and the row and channel dimensions of a window table."""
    return windows.agg(
        F.count("*").alias("samples"),
        F.max(F.size(x)).cast("long").alias("input_length"),
        F.max(F.size(F.get(x, F.lit(0)))).cast("long").alias("input_dim"),
        F.max(F.size(target)).cast("long").alias("target_length"),
        F.max(F.size(F.get(target, F.lit(0)))).cast("long").alias("target_dim"),
    )


def covered_rows(
    df: DataFrame, by: Sequence[str], index: str, is_start: Column, span: int,
    *, size: int = BLOCK_ROWS,
) -> DataFrame:
    """Rows inside at least one window, given which rows start one.

    A row asks whether a start lies within the last ``span`` index values; no
    window is exploded into its rows.
    """
    flagged = df.withColumn("_start", is_start.cast("int"))

    def frames(w):
        return {"_covered": F.max("_start").over(w.rangeBetween(-(span - 1), 0))}

    return over_frames(flagged, by, index, span - 1, 0, frames, size=size).where(
        F.col("_covered") == 1
    ).drop("_start", "_covered")


def ar_regressors(
    df: DataFrame, by: Sequence[str], index: str, outputs: Sequence[str], order: int,
    exogenous: Sequence[str] = (), *, size: int = BLOCK_ROWS,
) -> DataFrame:
    """ARX design: the last ``order`` output rows, oldest first, then current inputs."""
    blocks = {"_past": (outputs, -order, order), "_now": (outputs, 0, 1)}
    cut = cut_windows(df, by, index, blocks, keep=list(exogenous), size=size)
    design = F.flatten("_past")
    if exogenous:
        design = F.concat(design, pack(exogenous))
    return cut.select(*by, index, design.alias("design"), F.get("_now", F.lit(0)).alias("target"))


def delta_norms(
    df: DataFrame, by: Sequence[str], index: str, inputs: Sequence[str],
    exogenous: Sequence[str] = (), *, size: int = BLOCK_ROWS,
) -> DataFrame:
    """Norm of the input, of its change and of the exogenous change.

    The change is 0 on a row without a contiguous predecessor.
    """
    def frames(w):
        out = {"_before": F.lag(index).over(w)}
        for c in [*inputs, *exogenous]:
            out[f"_p_{c}"] = F.lag(c).over(w)
        return out

    framed = over_frames(df, by, index, 1, 0, frames, size=size)
    linked = F.coalesce(F.col("_before") == F.col(index) - 1, F.lit(False))

    def change(cols: Sequence[str]) -> Column:
        if not cols:
            return F.lit(0.0)
        step = l2(pack([F.col(c) - F.col(f"_p_{c}") for c in cols]))
        return F.when(linked, step).otherwise(F.lit(0.0))

    return framed.select(
        *df.columns, l2(pack(inputs)).alias("input_norm"),
        change(inputs).alias("input_delta_norm"), change(exogenous).alias("exogenous_delta_norm"),
    )


def stack_residuals(
    df: DataFrame, by: Sequence[str], index: str, residual: Sequence[str], length: int,
    *, size: int = BLOCK_ROWS,
) -> DataFrame:
    """The last ``length`` residual vectors in time order, flattened.

    ``by`` names episode, stage and anchor: a window never crosses any of them.
    """
    cut = cut_windows(df, by, index, {"_r": (residual, -(length - 1), length)}, size=size)
    return cut.select(*by, index, F.flatten("_r").alias("stacked"))

