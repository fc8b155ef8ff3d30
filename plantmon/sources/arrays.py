"""Array files as a Spark data source: row ranges of ``.npy`` and ``.npz`` files, one task each."""

from __future__ import annotations

import ast
import json
import struct
import zipfile
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from plantmon.sources.ranges import open_file

PART_BYTES = 32 << 20
RANGES = 10_000  # files and ranges that the driver may plan as tasks of their own
TASK_FILES = 256


@dataclass(frozen=True)
class Stored:
    """An array in a file: where its numbers begin and how they lie.

    ``packed`` arrays are compressed and can only be read from their beginning;
    ``name`` is then their place in the archive.
    """

    key: str
    name: str
    offset: int
    rows: int
    width: int
    kind: str
    by_column: bool
    packed: bool = False

    @property
    def row_bytes(self) -> int:
        return self.width * np.dtype(self.kind).itemsize


def _header(head: bytes) -> tuple[int, tuple[int, ...], str, bool]:
    """(length, shape, type, order) of an array header, after the public format description."""
    if head[:6] != b"\x93NUMPY":
        raise ValueError("not an array file")
    wide = head[6] > 1
    size, start = (struct.unpack("<I", head[8:12])[0], 12) if wide else (struct.unpack("<H", head[8:10])[0], 10)
    if len(head) < start + size:
        raise EOFError(start + size)
    about = ast.literal_eval(head[start : start + size].decode("utf-8" if head[6] > 2 else "latin1"))
    if np.dtype(about["descr"]).hasobject:
        raise ValueError("arrays of objects are not read")
    return start + size, tuple(about["shape"]), np.dtype(about["descr"]).str, bool(about["fortran_order"])


def _describe(key: str, name: str, offset: int, read: object, packed: bool) -> Stored:
    head = read(4096)
    try:
        length, shape, kind, by_column = _header(head)
    except EOFError as more:
        length, shape, kind, by_column = _header(head + read(more.args[0] - len(head)))
    if not shape:
        raise ValueError(f"{key}: a single number has no rows")
    if by_column and len(shape) > 2:
        raise ValueError(f"{key}: column order is read for two dimensions only")
    width = int(np.prod(shape[1:], dtype=np.int64))
    return Stored(key, name, offset + length, shape[0], width, kind, by_column and len(shape) == 2, packed)


def describe_file(url: str) -> dict[str, Stored]:
    """The arrays of a file by name, from its headers alone."""
    with open_file(url) as file:
        if not url.endswith(".npz"):
            return {"x": _describe("x", "", 0, file.read, False)}
        out = {}
        with zipfile.ZipFile(file) as archive:
            for entry in archive.infolist():
                key = entry.filename.removesuffix(".npy")
                if entry.compress_type == zipfile.ZIP_STORED:
                    lengths = struct.unpack("<HH", file.read_at(30, entry.header_offset)[26:30])
                    file.seek(start := entry.header_offset + 30 + sum(lengths))
                    out[key] = _describe(key, entry.filename, start, file.read, False)
                else:
                    with archive.open(entry) as stream:
                        out[key] = _describe(key, entry.filename, 0, stream.read, True)
        return out


def _rows(file: pa.NativeFile, a: Stored, start: int, stop: int, columns: Sequence[int]) -> np.ndarray:
    """Rows of an array that lies open in the file; of one kept by columns only the wanted ones are read."""
    kind = np.dtype(a.kind)
    if a.by_column:
        read = [file.read_at((stop - start) * kind.itemsize, a.offset + (c * a.rows + start) * kind.itemsize) for c in columns]
        return np.stack([np.frombuffer(x, kind) for x in read], axis=1) if read else np.empty((stop - start, 0))
    data = file.read_at((stop - start) * a.row_bytes, a.offset + start * a.row_bytes)
    return np.frombuffer(data, kind).reshape(stop - start, a.width)[:, list(columns)]


def _stream(file: pa.NativeFile, a: Stored, chunk: int, columns: Sequence[int]) -> Iterator[np.ndarray]:
    """All rows of a compressed array, ``chunk`` at a time. One kept by columns has to be unpacked whole."""
    kind = np.dtype(a.kind)
    with zipfile.ZipFile(file) as archive, archive.open(a.name) as stream:
        stream.read(a.offset)
        if a.by_column:
            whole = np.frombuffer(stream.read(), kind).reshape(a.width, a.rows).T
            yield from (whole[i : i + chunk, list(columns)] for i in range(0, a.rows, chunk))
            return
        for start in range(0, a.rows, chunk):
            n = min(chunk, a.rows - start)
            yield np.frombuffer(stream.read(n * a.row_bytes), kind).reshape(n, a.width)[:, list(columns)]


@dataclass
class RowRange(InputPartition):
    url: str
    arrays: list[Stored]
    start: int
    stop: int


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.paths = json.loads(options["paths"])
        self.widths = [int(options["x_width"]), int(options.get("y_width", 0))]
        self.part_bytes = int(options.get("part_bytes", PART_BYTES))
        self.chunk = int(options.get("chunk", 65_536))
        self.names = schema.fieldNames()[3:]
        self.columns = [[int(n[1:]) for n in self.names if n[0] == side] for side in "xy"]

    def parts(self, url: str) -> list[RowRange]:
        found = describe_file(url)
        if "x" not in found and len(found) != 1:
            raise ValueError(f"{url}: needs an array 'x' or exactly one array")
        arrays = [found.get("x") or next(iter(found.values()))] + ([found["y"]] if self.widths[1] else [])
        widths = [a.width for a in arrays]
        if widths != [w for w in self.widths if w]:
            raise ValueError(f"{url}: widths {widths} differ from the declared ones")
        rows = arrays[0].rows
        if any(a.rows != rows for a in arrays):
            raise ValueError(f"{url}: the arrays differ in rows")
        step = rows if any(a.packed for a in arrays) else max(1, self.part_bytes // max(1, sum(a.row_bytes for a in arrays)))
        return [RowRange(url, arrays, i, min(i + step, rows)) for i in range(0, rows, max(1, step))]

    def partitions(self) -> list[InputPartition]:
        with ThreadPoolExecutor(16) as pool:
            found = [p for parts in pool.map(self.parts, self.paths) for p in parts]
        return found or [RowRange("", [], 0, 0)]

    def _chunks(self, part: RowRange) -> Iterator[list[np.ndarray]]:
        with open_file(part.url) as file:
            if any(a.packed for a in part.arrays):
                files = [file, *[open_file(part.url) for _ in part.arrays[1:]]]
                sides = [
                    _stream(f, a, self.chunk, c) if a.packed else (_rows(f, a, i, min(i + self.chunk, a.rows), c) for i in range(0, a.rows, self.chunk))
                    for f, a, c in zip(files, part.arrays, self.columns, strict=False)
                ]
                yield from (list(x) for x in zip(*sides, strict=True))
                return
            for i in range(part.start, part.stop, self.chunk):
                yield [_rows(file, a, i, min(i + self.chunk, part.stop), c) for a, c in zip(part.arrays, self.columns, strict=False)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition.arrays:
            return
        at = partition.start
        for sides in self._chunks(partition):
            n = len(sides[0])
            values = [side[:, k] for side in sides for k in range(side.shape[1])]
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(partition.url), n), pa.repeat(pa.scalar(partition.arrays[0].key), n), pa.array(np.arange(at, at + n, dtype=np.int64)),
                 *[pa.array(np.ascontiguousarray(v, dtype=np.float64)) for v in values]],
                names=["source", "key", "raw_index", *self.names],
            )
            at += n


class ArrayFiles(DataSource):
    """``spark.read.format("array_files")`` with ``paths`` (a JSON list), ``x_width`` and more, see ``read_arrays``."""

    @classmethod
    def name(cls) -> str:
        return "array_files"

    def schema(self) -> StructType:
        return array_schema(int(self.options["x_width"]), int(self.options.get("y_width", 0)))

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArrayReader(dict(self.options), schema)


def read_in_tasks(files: DataFrame, schema: StructType, options: dict[str, str], tasks: int) -> DataFrame:
    """The same rows where files or ranges are many: tasks read the headers, and a task takes several ranges.

    Neither paths nor ranges pass through the driver, and ``tasks`` does not grow with a small ``part_bytes``.
    """
    settings = {**options, "paths": "[]"}

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = ArrayReader(settings, schema)
        for batch in batches:
            for url in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"part": [json.dumps(asdict(p)) for p in reader.parts(url)]}, pa.schema([("part", pa.string())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = ArrayReader(settings, schema)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                part = json.loads(text)
                yield from reader.read(RowRange(part["url"], [Stored(**a) for a in part["arrays"]], part["start"], part["stop"]))

    ranges = files.select("path").repartition(tasks).mapInArrow(describe, "part string")
    return ranges.repartition(tasks).mapInArrow(read, schema)


def array_schema(x_width: int, y_width: int, columns: Sequence[str] | None = None) -> StructType:
    names = [f"x{i}" for i in range(x_width)] + [f"y{i}" for i in range(y_width)]
    lost = [c for c in columns or [] if c not in names]
    if lost:
        raise ValueError(f"columns not found: {', '.join(lost)}")
    kept = [n for n in names if columns is None or n in columns]
    return StructType([
        StructField("source", StringType()), StructField("key", StringType()), StructField("raw_index", LongType()), *[StructField(n, DoubleType()) for n in kept]
    ])
