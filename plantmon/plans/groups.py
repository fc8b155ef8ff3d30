"""Python folds over many small sorted groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

Rows = list[tuple]


def fold_groups(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    fn: Callable[[tuple, dict[str, np.ndarray]], Rows],
    schema: StructType,
) -> DataFrame:
    """Apply ``fn(key, columns)`` to every group and collect the rows it returns.

    Spark partitions by the key and sorts; a task then walks its rows in Arrow
    batches and holds no more than the current batch and one open group. Unlike
    a grouped map it pays nothing per group, which matters when there are far
    more groups than rows per group. The caller's key bounds a group's size.
    """
    by = list(by)
    names = [f.name for f in schema]
    sorted_rows = df.repartition(*by).sortWithinPartitions(*by, *order)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_rows: pd.DataFrame | None = None

        def close(frame: pd.DataFrame, last: bool) -> tuple[Rows, pd.DataFrame | None]:
            changed = np.zeros(len(frame), dtype=bool)
            changed[0] = True
            for k in by:
                col = frame[k].to_numpy()
                changed[1:] |= col[1:] != col[:-1]
            starts = np.flatnonzero(changed).tolist()
            ends = [*starts[1:], len(frame)]
            columns = {c: frame[c].to_numpy() for c in frame.columns}
            done = len(starts) if last else len(starts) - 1
            out: Rows = []
            for a, b in zip(starts[:done], ends[:done], strict=True):
                out += fn(tuple(columns[k][a] for k in by), {c: v[a:b] for c, v in columns.items()})
            return out, None if last else frame.iloc[starts[-1]:]

        for batch in batches:
            if batch.empty:
                continue
            frame = batch if open_rows is None else pd.concat([open_rows, batch], ignore_index=True)
            rows, open_rows = close(frame, False)
            if rows:
                yield pd.DataFrame(rows, columns=names)
        if open_rows is not None:
            rows, _ = close(open_rows, True)
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return sorted_rows.mapInPandas(walk, schema)
