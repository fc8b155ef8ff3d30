"""Recordings from files, as tables keyed by their source and row."""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plantmon.functions.text import fault_id_from_name
from plantmon.plans import rank_within
from plantmon.sources import arrays
from plantmon.sources.ranges import list_files, reachable

Paths = str | Sequence[str]


def read_csv(spark: SparkSession, path: Paths, schema: StructType | str | None = None) -> DataFrame:
    """Comma-separated file with a header; types are inferred without a schema."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_dat(spark: SparkSession, path: Paths, columns: Sequence[str]) -> DataFrame:
    """Whitespace-separated numbers without a header; a blank line is no row."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    cells = lines.select(F.split(F.trim("value"), r"\s+").alias("c"), F.col("_metadata.file_path").alias("source"))
    return cells.select("source", *[F.get("c", F.lit(i)).cast("double").alias(n) for i, n in enumerate(columns)])


def read_table(spark: SparkSession, path: Paths, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return df.select(*columns) if columns else df


def resolve_paths(spark: SparkSession, root: str, patterns: Sequence[str]) -> list[str]:
    """Files of the given patterns, sorted; a pattern without a match is an error."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    found: list[str] = []
    for pattern in patterns:
        glob = hadoop.Path(f"{root.rstrip('/')}/{pattern}")
        files = glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob)
        names = sorted(f.getPath().toString() for f in (files or []))
        if not names:
            raise FileNotFoundError(f"no file matches {pattern} under {root}")
        found += [n for n in names if n not in found]
    return found


def _arrays(content: bytes, npz: bool) -> dict[str, np.ndarray]:
    loaded = np.load(io.BytesIO(content), allow_pickle=False)
    return {k: loaded[k] for k in loaded.files} if npz else {"x": loaded}


def read_arrays(
    spark: SparkSession, path: Paths, x_width: int, y_width: int = 0, *, columns: Sequence[str] | None = None,
    part_bytes: int = arrays.PART_BYTES, chunk: int = 65_536,
) -> DataFrame:
    """``.npy`` and ``.npz`` files of any size: ``source, key, raw_index, x0.., y0..``.

    Headers tell where the numbers lie, so a file is cut into ranges of about
    ``part_bytes``, each read by a task of its own, ``chunk`` rows at a time; of
    more than ``arrays.RANGES`` files and ranges a task takes several. With
    ``columns`` only these are returned; of an array kept by columns the others
    are not read. Compressed archives have no ranges: one task unpacks such a file
    as a stream. A store that only Spark reaches is read a file a record.
    """
    files = list_files(spark, path)
    if not reachable(files):
        whole = spark.read.format("binaryFile").load(path).select("path", "content")
        schema = arrays.array_schema(x_width, y_width, columns)
        return decode_arrays(whole, x_width, y_width, chunk=chunk).select(*schema.fieldNames())
    schema = arrays.array_schema(x_width, y_width, columns)
    options = {"x_width": x_width, "y_width": y_width, "part_bytes": part_bytes, "chunk": chunk}
    size = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    if size["files"] + size["bytes"] // part_bytes > arrays.RANGES:
        tasks = max(spark.sparkContext.defaultParallelism, size["files"] // arrays.TASK_FILES, size["bytes"] // arrays.PART_BYTES)
        return arrays.read_in_tasks(files, schema, options, min(tasks, arrays.RANGES))
    paths = sorted(r["path"] for r in files.select("path").collect())
    spark.dataSource.register(arrays.ArrayFiles)
    return spark.read.format("array_files").schema(schema).options(paths=json.dumps(paths), **options).load()


def decode_arrays(
    files: DataFrame, x_width: int, y_width: int = 0, *, chunk: int = 65_536
) -> DataFrame:
    """Array files given as ``(path, content)`` rows.

    One file is one record of a distributed scan, and leaves it in chunks of
    rows. A ``.npz`` needs a key ``x`` (with an optional ``y``) or exactly one
    array. The caller states the widths, so the schema is known before reading.
    """
    xs, ys = [f"x{i}" for i in range(x_width)], [f"y{i}" for i in range(y_width)]
    ddl = "source string, key string, raw_index bigint, " + ", ".join(f"{c} double" for c in [*xs, *ys])

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, content in zip(batch["path"], batch["content"], strict=True):
                held = _arrays(content, source.endswith(".npz"))
                if "x" not in held and len(held) != 1:
                    raise ValueError(f"{source}: needs an array 'x' or exactly one array")
                key = "x" if "x" in held else next(iter(held))
                parts = [held[key]] + ([held["y"]] if y_width else [])
                parts = [np.asarray(p, dtype=float).reshape(len(p), -1) for p in parts]
                widths = [p.shape[1] for p in parts]
                if widths != [w for w in (x_width, y_width) if w]:
                    raise ValueError(f"{source}: widths {widths} differ from the declared ones")
                values = np.concatenate(parts, axis=1)
                for a in range(0, len(values), chunk):
                    out = pd.DataFrame(values[a:a + chunk], columns=[*xs, *ys])
                    out.insert(0, "raw_index", np.arange(a, a + len(out), dtype=np.int64))
                    out.insert(0, "key", key)
                    out.insert(0, "source", source)
                    yield out

    return files.select("path", "content").mapInPandas(load, ddl)


def read_keyed_arrays(spark: SparkSession, path: Paths, width: int) -> DataFrame:
    """Every array of ``.npz`` files: ``source, key, raw_index, v0..``."""
    vs = [f"v{i}" for i in range(width)]
    ddl = "source string, key string, raw_index bigint, " + ", ".join(f"{c} double" for c in vs)

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, content in zip(batch["path"], batch["content"], strict=True):
                for key, array in sorted(_arrays(content, True).items()):
                    values = np.asarray(array, dtype=float).reshape(len(array), -1)
                    if values.shape[1] > width:
                        raise ValueError(f"{source}:{key} is wider than {width}")
                    out = pd.DataFrame(values, columns=vs[: values.shape[1]]).reindex(columns=vs)
                    out.insert(0, "raw_index", np.arange(len(out), dtype=np.int64))
                    out.insert(0, "key", key)
                    out.insert(0, "source", source)
                    yield out

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(load, ddl)


ADAPTERS: dict[str, Callable[..., DataFrame]] = {"csv": read_csv, "table": read_table}


def register_source(name: str, reader: Callable[..., DataFrame]) -> None:
    """Make a function returning a DataFrame available to cards by name."""
    if name in ADAPTERS:
        raise ValueError(f"source {name!r} is already registered")
    ADAPTERS[name] = reader


def read_card(spark: SparkSession, card: Mapping[str, object],
              reader: Callable[[SparkSession, list[str]], DataFrame] | None = None) -> DataFrame:
    """Splits a data card declares, in one table with a ``split`` column.

    The card holds ``root`` and file patterns under ``train``, ``eval``,
    ``test`` or ``data``; ``data`` counts as train. It may name a registered
    ``adapter`` that reads the files.
    """
    read = reader or (ADAPTERS[str(card["adapter"])] if "adapter" in card else read_csv)
    out = None
    for name in ("train", "data", "eval", "test"):
        patterns = card.get(name)
        if not patterns:
            continue
        files = resolve_paths(spark, str(card["root"]), [patterns] if isinstance(patterns, str) else list(patterns))
        part = read(spark, files).withColumn("split", F.lit("train" if name == "data" else name))
        if "source" not in part.columns:
            part = part.withColumn("source", F.col("_metadata.file_path"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("the card declares no files")
    return out


def fault_ids(df: DataFrame, name: str, out: str = "fault_id") -> DataFrame:
    return df.withColumn(out, fault_id_from_name(name))


def select_stored(df: DataFrame, stored: Sequence[str], features: Sequence[str], width: int,
                  positions_of: Sequence[int] | None = None) -> DataFrame:
    """Process variables by declared position, after an exact width check.

    Columns outside the declaration, such as a stored answer, never get through.
    """
    if len(stored) != width:
        raise ValueError(f"{len(stored)} stored columns, {width} declared")
    picked = list(positions_of) if positions_of is not None else list(range(len(features)))
    if positions_of is None and width != len(features):
        raise ValueError("without positions the width must equal the number of features")
    if picked and max(picked) >= width:
        raise ValueError("a declared position lies outside the stored columns")
    others = [c for c in df.columns if c not in stored]
    return df.select(*others, *[F.col(stored[p]).alias(f) for p, f in zip(picked, features, strict=True)])


def prediction_table(df: DataFrame, drop: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First column left is the target ``y0``; rows with any non-number go."""
    left = [c for c in df.columns if c not in drop]
    cast = df.select(*[F.expr(f"try_cast(`{c}` as double)").alias(c) for c in left])
    named = cast.dropna("any").toDF("y0", *[f"x{i}" for i in range(len(left) - 1)])
    return named if not order else rank_within(named, [], list(order), "raw_index")

