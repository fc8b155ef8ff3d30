"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_BYTES = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, UPPER.lower())


def shield(df: DataFrame, needed: list[str]) -> tuple[DataFrame, Callable[[DataFrame, list[str]], DataFrame]]:
    """``df`` with every column but ``needed`` renamed out of the way, and the way back.

    ``back(out, results)`` takes the columns of ``out`` that came from ``df``
    under their own names and in their order. A result replaces an extra column
    of its name (in any case), other results follow at the end.
    """
    names, found = [], set()
    for i, c in enumerate(df.columns):
        taken = c in needed and c not in found
        names.append(c if taken else f"extra{i}~")
        found |= {c} if taken else set()
    lost = [c for c in needed if c not in found]
    if lost:
        raise ValueError(f"columns not found: {', '.join(lost)}")
    given = list(zip(df.columns, names, strict=True))

    def back(out: DataFrame, results: list[str]) -> DataFrame:
        left = {r.lower(): r for r in results if r not in needed}
        columns = []
        for c, n in given:
            if n in needed:
                if n in out.columns:
                    columns.append(F.col(n))
            elif c.lower() in left:
                columns.append(F.col(left.pop(c.lower())))
            else:
                columns.append(F.col(f"`{n}`").alias(c))
        return out.select(*columns, *[F.col(r) for r in left.values()])

    return df.toDF(*names), back


def with_columns(fields: list[tuple[str, T.DataType]], df: DataFrame) -> T.StructType:
    """The schema of ``df`` with ``fields`` set or added."""
    known = {name: kind for name, kind in fields}
    kept = [T.StructField(f.name, known.pop(f.name, f.dataType), True) for f in df.schema.fields]
    return T.StructType(kept + [T.StructField(n, k, True) for n, k in known.items()])


def set_columns(batch: pa.RecordBatch, values: dict[str, pa.Array]) -> pa.RecordBatch:
    """``batch`` with columns replaced or appended, in the order of ``with_columns``."""
    names = batch.schema.names
    arrays = {n: batch.column(i) for i, n in enumerate(names)} | values
    return pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))


def map_arrow(
    df: DataFrame, schema: T.StructType | str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]]
) -> DataFrame:
    """Apply a function to every Arrow batch; ``make`` builds it once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


# One random odd 64-bit number for each byte, and the odd base of the word hash.
_BYTE_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_VALUES = _BYTE_VALUES[np.frombuffer(LOWER_BYTES, np.uint8)]
_IS_SPACE = np.isin(np.arange(256), list(SPACE.encode()))
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class WordHasher:
    """64-bit hashes of all words of many texts at once, straight from Arrow's buffer.

    A word's hash is a polynomial in its bytes' values modulo 2^64, taken as a
    difference of running sums and divided by the power of its place, then
    scrambled. Words are ``[^\\x20\\x09-\\x0D]+``; with ``lower`` A-Z count as a-z.
    """

    def __init__(self, lower: bool = True):
        self.values = _LOWER_VALUES if lower else _BYTE_VALUES
        self.powers = self.inverses = np.empty(0, np.uint64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words, one text after the other, and words per text; null has none."""
        texts = pc.fill_null(texts, "") if texts.null_count else texts
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        first, last = int(offsets[0]), int(offsets[-1])
        if last == first:
            return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[first:last]
        offsets = offsets.astype(np.int64) - first
        if len(data) > len(self.powers):
            self.powers, self.inverses = _powers(_BASE, len(data)), _powers(_BASE_INVERSE, len(data))
        space = _IS_SPACE[data]
        # A word begins after a space or at the start of a text, and ends likewise.
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = space[:-1]
        edge[offsets] = True
        starts = np.flatnonzero(edge[:-1] & ~space)
        edge[:-1] = space
        edge[offsets] = True
        ends = np.flatnonzero(edge[1:] & ~space)
        sums = np.empty(len(data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(self.values[data] * self.powers[: len(data)], out=sums[1:])
        hashes = (sums[ends + 1] - sums[starts]) * self.inverses[starts]
        return mixed(hashes), np.diff(np.searchsorted(starts, offsets))


def mixed(values: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the public splitmix64 finaliser)."""
    values = values.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        values ^= values >> np.uint64(shift)
        values *= np.uint64(factor)
    return values ^ (values >> np.uint64(31))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of ``n`` consecutive word hashes."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += words[j : j + len(total)]
    return mixed(total)


def slices(sizes: np.ndarray, limit: int) -> Iterator[slice]:
    """Consecutive runs of rows holding about ``limit`` units each."""
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > limit:
            yield slice(start, i)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))
