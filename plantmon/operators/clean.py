"""Missing values, finite rows, dropped labels and contiguity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantmon.functions.numeric import finite_or_null, is_finite
from plantmon.operators.roles import complete_rows
from plantmon.plans import over_frames, row_positions, running
from plantmon.plans.ordered import BLOCK_ROWS


def finite_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(complete_rows(df, columns))


def drop_label_values(df: DataFrame, label: str, values: Sequence[object]) -> tuple[DataFrame, DataFrame]:
    """Rows without the given labels, compared as text, and a count per value."""
    spark = df.sparkSession
    wanted = [str(v) for v in values]
    if label not in df.columns:
        return df, spark.createDataFrame([(v, 0, False) for v in wanted],
                                         "value string, dropped_rows bigint, column_found boolean")
    text = F.col(label).cast("string")
    hit = F.coalesce(text.isin(wanted), F.lit(False))
    counts = df.agg(*[F.count(F.when(text == v, 1)).alias(f"c{i}") for i, v in enumerate(wanted)])
    report = counts.select(
        F.explode(
            F.array(*[F.struct(F.lit(v).alias("value"), F.col(f"c{i}").alias("dropped_rows"))
                      for i, v in enumerate(wanted)])
        ).alias("r")
    ).select("r.value", "r.dropped_rows", F.lit(True).alias("column_found"))
    return df.where(~hit), report


def nan_to_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NaN and infinities become 0; a null, which Spark readers give for an empty
    field, counts as missing too."""
    return df.withColumns(
        {c: F.when(is_finite(c), F.col(c).cast("double")).otherwise(F.lit(0.0)) for c in columns}
    )


def fill_gaps(
    df: DataFrame,
    by: Sequence[str],
    index: str,
    columns: Sequence[str],
    method: str = "linear",
    *,
    size: int = BLOCK_ROWS,
) -> DataFrame:
    """Fill missing values within each key, by row position.

    ``linear`` interpolates between the nearest present rows and repeats the
    edge value outside them; ``ffill`` carries forward, then backward. A channel
    with no value in a key stays null.
    """
    if method not in ("linear", "ffill"):
        raise ValueError(f"unknown fill method {method!r}")
    pos = "_at"
    kept = [c for c in df.columns if c not in columns]
    clean = df.withColumns({c: finite_or_null(c) for c in columns})
    placed = row_positions(clean, by, index, pos, size=size)
    values = {}
    for c in columns:
        at = F.when(F.col(c).isNotNull(), F.col(pos))
        values |= {f"_pv_{c}": ("last", F.col(c)), f"_nv_{c}": ("next", F.col(c))}
        if method == "linear":
            values |= {f"_pi_{c}": ("max", at), f"_ni_{c}": ("next", at)}
    bounded = running(placed, by, pos, values, size=size)
    out = []
    for c in columns:
        v0, v1 = F.col(f"_pv_{c}"), F.col(f"_nv_{c}")
        if method == "linear":
            i0, i1 = F.col(f"_pi_{c}"), F.col(f"_ni_{c}")
            between = F.when(i1 > i0, (v1 - v0) / (i1 - i0) * (F.col(pos) - i0) + v0)
            out.append(F.coalesce(F.col(c), between, v0, v1).alias(c))
        else:
            out.append(F.coalesce(F.col(c), v0, v1).alias(c))
    filled = bounded.select(*kept, *out)
    return filled.select(*df.columns)


STRATEGIES = ("none", "drop", "interpolate_then_drop", "ffill_bfill_then_drop")


def handle_missing(
    df: DataFrame,
    by: Sequence[str],
    index: str,
    columns: Sequence[str],
    strategy: str = "interpolate_then_drop",
    *,
    size: int = BLOCK_ROWS,
) -> DataFrame:
    """Apply a missing-value strategy and drop what is still not finite."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; use one of {STRATEGIES}")
    if strategy == "none":
        return df
    if strategy != "drop":
        method = "ffill" if strategy.startswith("ffill") else "linear"
        df = fill_gaps(df, by, index, columns, method, size=size)
    return finite_rows(df, columns)


def missing_summary(
    before: DataFrame, after: DataFrame, columns: Sequence[str], strategy: str
) -> DataFrame:
    """Original, removed and still non-finite row counts, one row."""
    zero = F.lit(0).cast("long")
    bad = F.count(F.when(~complete_rows(after, columns), 1))
    a = before.agg(F.count("*").alias("original"), zero.alias("kept"), zero.alias("bad"))
    b = after.agg(zero.alias("original"), F.count("*").alias("kept"), bad.alias("bad"))
    return a.unionByName(b).agg(
        F.lit(strategy).alias("strategy"),
        F.sum("original").alias("original_rows"),
        (F.sum("original") - F.sum("kept")).alias("removed_rows"),
        F.sum("bad").alias("remaining_non_finite_rows"),
    )


def contiguous_pairs(
    df: DataFrame, by: Sequence[str], index: str, columns: Sequence[str] = (),
    *, size: int = BLOCK_ROWS,
) -> DataFrame:
    """Rows whose predecessor has exactly the previous index.

    The predecessor's channels are added as ``prev_*``.
    """
    def cols(w):
        return {"_before": F.lag(index).over(w),
                **{f"prev_{c}": F.lag(c).over(w) for c in columns}}

    framed = over_frames(df, by, index, 1, 0, cols, size=size)
    return framed.where(F.col("_before") == F.col(index) - 1).drop("_before")


def one_step_pairs(
    df: DataFrame, by: Sequence[str], index: str, columns: Sequence[str], *, size: int = BLOCK_ROWS
) -> DataFrame:
    """Pairs ``(x_t, x_t+1)`` keyed by the target's index."""
    pairs = contiguous_pairs(df, by, index, columns, size=size)
    return pairs.select(
        *by, index, *[F.col(f"prev_{c}").alias(f"{c}_now") for c in columns],
        *[F.col(c).alias(f"{c}_next") for c in columns],
    )


def run_columns(
    df: DataFrame, by: Sequence[str], index: str, constant: Sequence[str] = (), *,
    start: str | None = "run_start", number: str | None = "run_id", size: int = BLOCK_ROWS,
) -> DataFrame:
    """Contiguous runs: the index each starts at and its number within the key.

    A run breaks where the index jumps or a ``constant`` column changes.
    """
    def cols(w):
        same = F.lag(index).over(w) == F.col(index) - 1
        for c in constant:
            same = same & F.lag(c).over(w).eqNullSafe(F.col(c))
        return {"_breaks": ~F.coalesce(same, F.lit(False))}

    flagged = over_frames(df, by, index, 1, 0, cols, size=size, keep_block=True)
    values = {}
    if start:
        values[start] = ("max", F.when(F.col("_breaks"), F.col(index)))
    if number:
        values[number] = ("sum", F.col("_breaks").cast("long"))
    out = running(flagged, by, index, values, size=size).drop("_breaks")
    return out.withColumn(number, F.col(number) - 1) if number else out


def run_starts(
    df: DataFrame, by: Sequence[str], index: str, constant: Sequence[str] = (),
    name: str = "run_start", *, size: int = BLOCK_ROWS,
) -> DataFrame:
    """Name each contiguous run by the index it starts at."""
    return run_columns(df, by, index, constant, start=name, number=None, size=size)


def run_ids(
    df: DataFrame, by: Sequence[str], index: str, constant: Sequence[str] = (),
    name: str = "run_id", *, size: int = BLOCK_ROWS,
) -> DataFrame:
    """Number of contiguity breaks seen before this row, 0 for the first run."""
    return run_columns(df, by, index, constant, start=None, number=name, size=size)
