"""Writers. Results are never overwritten silently."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantmon.plans.joins import lookup
from plantmon.plans.staging import stage as staged

FILE_ROWS = 500_000
# Up to this number of targets Spark appends shuffled rows to a file for each;
# beyond it a task holds what it sends in memory and sorts it.
SORTED_ABOVE = 200
_FILES = "_files"


def write_pointwise(df: DataFrame, path: str) -> None:
    """Per-time decisions as JSON lines; an existing path is an error."""
    df.write.mode("errorifexists").json(path)


def write_report_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Fixed columns in fixed order, with a header."""
    df.select(*columns).write.mode("errorifexists").option("header", True).csv(path)


def write_summaries(summaries: Mapping[str, DataFrame], root: str, kind: str = "parquet") -> dict[str, str]:
    """Every pipeline summary as its own table under ``root``."""
    paths = {}
    for name, df in summaries.items():
        paths[name] = f"{root.rstrip('/')}/{name}"
        writer = df.write.mode("errorifexists")
        writer.parquet(paths[name]) if kind == "parquet" else writer.option("header", True).csv(paths[name])
    return paths


def write_scores(df: DataFrame, path: str, stage: str = "stage", *, files_per_stage: int | None = None,
                 file_rows: int = FILE_ROWS) -> None:
    """Long score table partitioned by stage, so a stage is read alone.

    Rows are spread over ``files_per_stage`` tasks per stage by a hash of the
    row; a stage with most of the rows is not written by a single task. A stage
    with more than that many times ``file_rows`` rows is cut further, so that what
    a task sorts and writes stays about as large up to 200 tasks.
    """
    if files_per_stage:
        needed = F.greatest(F.lit(files_per_stage), F.ceil(F.count(F.lit(1)) / file_rows)).cast("int")
        files = staged(df.groupBy(stage).agg(needed.alias(_FILES)), "files")
        tasks = min(files.agg(F.sum(_FILES)).first()[0] or 1, SORTED_ABOVE)
        salt = F.pmod(F.xxhash64(*df.columns), F.coalesce(_FILES, F.lit(files_per_stage)))
        df = lookup(df, files, stage).repartition(tasks, F.col(stage), salt).select(*df.columns)
    df.write.mode("errorifexists").partitionBy(stage).parquet(path)


def append_metrics(df: DataFrame, path: str) -> None:
    """Append metric events to a parquet log."""
    df.write.mode("append").parquet(path)
