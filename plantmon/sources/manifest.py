"""File manifests and checks of what a folder holds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantmon.plans import stage
from plantmon.sources.ranges import blocks, list_files, open_file, reachable


def _hashed(files: DataFrame) -> DataFrame:
    """(path, offset, length) rows with the SHA-256 of the range, read as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, opened, file = [], None, None
            for path, offset, length in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if path != opened:
                    opened, file = path, open_file(path)
                digest = hashlib.sha256()
                for data in blocks(file, offset, length):
                    digest.update(data)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], names=["path", "offset", "length", "sha256"])

    # One range a task as far as there are slots: a range is much work and few bytes of input.
    tasks = max(1, files.sparkSession.sparkContext.defaultParallelism * 4)
    spread = files.select("path", "offset", "length").repartition(tasks, "path", "offset")
    return spread.mapInArrow(run, "path string, offset long, length long, sha256 string")


def _name() -> Column:
    return F.regexp_extract("path", r"([^/]+)$", 1).alias("name")


def file_manifest(spark: SparkSession, path: str | Sequence[str], pattern: str = "*") -> DataFrame:
    """Path, size and SHA-256 of every file, streamed by the task that hashes it.

    A store that only Spark reaches is read a file a record.
    """
    files = list_files(spark, path, pattern)
    if not reachable(files):
        whole = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
        return whole.select(_name(), "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    found = _hashed(files.select("path", F.lit(0).cast("long").alias("offset"), F.col("bytes").alias("length")))
    return found.select(_name(), "path", F.col("length").alias("bytes"), "sha256")


RANGE_BYTES = 64 << 20


def _ranges(files: DataFrame, range_bytes: int) -> DataFrame:
    last = F.greatest(F.expr(f"(bytes - 1) div {int(range_bytes)}L"), F.lit(0))
    cut = files.select("path", "bytes", "modified", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"))
    offset = F.col("part") * range_bytes
    return cut.select("*", offset.alias("offset"), F.least(F.col("bytes") - offset, F.lit(range_bytes).cast("long")).alias("length"))


def range_manifest(
    spark: SparkSession, path: str | Sequence[str], pattern: str = "*", range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """The leaves of a hash tree: (name, path, bytes, modified, part, offset, length, sha256).

    Every range of ``range_bytes`` has a digest of its own, so a file of any size
    is hashed by many tasks, and later checks know which range changed.
    """
    cut = _ranges(list_files(spark, path, pattern), range_bytes)
    found = _hashed(cut).drop("length")
    return cut.join(found, ["path", "offset"]).select(_name(), "path", "bytes", "modified", "part", "offset", "length", "sha256")


def tree_digest(ranges: DataFrame) -> DataFrame:
    """(name, path, bytes, parts, tree): one digest a file, over the digests of its ranges in their order."""
    order = F.sort_array(F.collect_list(F.struct("part", "sha256")))
    return ranges.groupBy("name", "path", "bytes").agg(
        F.count(F.lit(1)).alias("parts"), F.sha2(F.array_join(F.transform(order, lambda x: x["sha256"]), ""), 256).alias("tree")
    )


def changed_ranges(
    spark: SparkSession, path: str | Sequence[str], index: DataFrame, pattern: str = "*", range_bytes: int = RANGE_BYTES,
    trust_times: bool = True,
) -> DataFrame:
    """(name, part, problem) of what differs from an earlier :func:`range_manifest`; expected empty.

    With ``trust_times`` a file whose size and time are as indexed is not read.
    Of the others every range is; those that agree with their digest are left
    out. ``range_bytes`` is that of the index.
    """
    files = list_files(spark, path, pattern)
    known = index.select("path", F.col("bytes").alias("_bytes"), F.col("modified").alias("_modified")).distinct()
    same = (F.col("bytes") == F.col("_bytes")) & (F.col("modified") == F.col("_modified"))
    both = files.join(known, "path", "full_outer")
    suspect = both.where(F.col("bytes").isNotNull() & ~(F.coalesce(same, F.lit(False)) & F.lit(trust_times)))
    suspect = stage(suspect.select("path", "bytes", "modified", F.col("_bytes").isNotNull().alias("_known")), "suspect")
    cut = _ranges(suspect.where("_known").drop("_known"), range_bytes)
    have = _hashed(cut).join(cut.select("path", "offset", "part"), ["path", "offset"]).select("path", "part", F.col("sha256").alias("_have"))
    want = index.join(suspect.where("_known").select("path"), "path", "left_semi").select("path", "part", "sha256")
    differ = have.join(want, ["path", "part"], "full_outer")
    problem = F.when(F.col("_have").isNull(), "cut off").when(F.col("sha256").isNull(), "added").when(F.col("_have") != F.col("sha256"), "changed")
    out = differ.select("path", "part", problem.alias("problem")).where(F.col("problem").isNotNull())
    none = F.lit(None).cast("long").alias("part")
    for rows, name in ((both.where(F.col("bytes").isNull()), "missing"), (suspect.where("not _known"), "not indexed")):
        out = out.unionByName(rows.select("path", none, F.lit(name).alias("problem")))
    return out.select(_name(), "part", "problem")


def archive_profile(df: DataFrame, segment: str, width: int, index: str) -> DataFrame:
    """Rows, width and index range per segment."""
    return df.groupBy(segment).agg(
        F.count("*").alias("rows"), F.lit(width).cast("long").alias("width"),
        F.min(index).alias("index_start"), F.max(index).alias("index_end"),
    )


def profile_mismatches(profile: DataFrame, expected: DataFrame, segment: str) -> DataFrame:
    """Segments that are missing, unexpected, or differ in rows or width."""
    want = expected.select(segment, F.col("rows").alias("_rows"), F.col("width").alias("_width"))
    both = profile.join(want, segment, "full_outer")
    problem = (
        F.when(F.col("_rows").isNull(), F.lit("unexpected"))
        .when(F.col("rows").isNull(), F.lit("missing"))
        .when(F.col("rows") != F.col("_rows"), F.lit("rows differ"))
        .when(F.col("width") != F.col("_width"), F.lit("width differs"))
    )
    return both.select(segment, problem.alias("problem")).where(F.col("problem").isNotNull())


def content_manifest(files: DataFrame) -> DataFrame:
    """The same for files whose content is at hand: rows of (path, content)."""
    content = F.col("content").cast("binary")
    return files.select("path", F.octet_length(content).cast("long").alias("bytes"), F.sha2(content, 256).alias("sha256"))


def manifest_mismatches(have: DataFrame, index: DataFrame) -> DataFrame:
    """Names whose presence or hash contradicts the index."""
    want = index.select("name", F.col("sha256").alias("_want"))
    both = have.select("name", "sha256").join(want, "name", "full_outer")
    problem = (
        F.when(F.col("_want").isNull(), F.lit("not indexed"))
        .when(F.col("sha256").isNull(), F.lit("missing"))
        .when(F.col("sha256") != F.col("_want"), F.lit("changed"))
    )
    return both.select("name", problem.alias("problem")).where(F.col("problem").isNotNull())


def verify_outputs(
    spark: SparkSession, path: str, index: DataFrame, pattern: str = "part-*", rows: int | None = None
) -> DataFrame:
    """Files whose presence or hash contradicts the index; expected empty.

    With ``rows``, the number of lines that are not blank must agree as well; a
    difference is one more problem, of no file.
    """
    found = manifest_mismatches(file_manifest(spark, path, pattern), index)
    if rows is None:
        return found
    lines = spark.read.option("pathGlobFilter", pattern).text(path).where(F.trim("value") != "")
    differ = lines.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != rows)
    return found.unionByName(differ.select(F.lit(None).cast("string").alias("name"), F.lit("row count differs").alias("problem")))
