"""Byte ranges of files, read where a task runs, so that no record holds a file."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 1 << 20


def open_file(url: str) -> pa.NativeFile:
    """A file of any store that Arrow reaches, for reading at any place."""
    store, path = pyarrow.fs.FileSystem.from_uri(url) if "://" in url or url.startswith("file:") else (pyarrow.fs.LocalFileSystem(), url)
    return store.open_input_file(path)


def blocks(file: pa.NativeFile, offset: int, length: int, size: int = BLOCK) -> Iterator[bytes]:
    """The bytes of a range, ``size`` at a time."""
    end = offset + length
    while offset < end:
        data = file.read_at(min(size, end - offset), offset)
        if not data:
            raise OSError("the file ends before its range")
        yield data
        offset += len(data)


def list_files(spark: SparkSession, path: str | list[str], pattern: str = "*") -> DataFrame:
    """(path, bytes, modified) of every file; contents are not read. Like Spark's readers it passes over empty files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def reachable(files: DataFrame) -> bool:
    """Whether tasks can open these files by range; Spark may read stores that Arrow does not know."""
    first = files.select("path").head()
    if first is None:
        return True
    try:
        open_file(first["path"]).close()
    except (OSError, ValueError, pa.ArrowException):
        return False
    return True
