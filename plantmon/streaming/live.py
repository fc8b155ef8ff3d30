"""Frozen rules applied to live records, and running reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from plantmon.functions.numeric import INF
from plantmon.operators.calibrate import alarm
from plantmon.operators.reports import detection_report_columns, finish_detection_report
from plantmon.operators.scale import Scaler
from plantmon.operators.splits import latest
from plantmon.plans.joins import fits
from plantmon.plans.staging import new_path, stage

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State store the keyed processors need; it also keeps state off the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Replay:
    """A recorded table played back as a file stream, slice after slice.

    ``records`` is the streaming table. A slice is written by as many tasks as
    the table has partitions; the next one appears only when the query has
    consumed it, so records keep their order across slices however many files
    a slice has. A slice spans at most ``batch_rows`` values of ``order``, which
    bounds what one episode brings at a time. Their number follows the longest
    episode, not the number of episodes: every slice wakes every episode it
    holds. An empty table is one empty slice.
    """

    def __init__(self, df: DataFrame, order: str, slices: int = 3, batch_rows: int = 1_000_000) -> None:
        spark = df.sparkSession
        low, high, rows = df.agg(F.min(order), F.max(order), F.count(F.lit(1))).first()
        low, high = (0, 0) if low is None else (low, high)
        slices = max(slices, -(-min(rows, high - low + 1) // batch_rows))
        width = max(1, -(-(high - low + 1) // slices))
        cuts = [low + i * width for i in range(slices)]
        at = F.col(order)
        self._path = new_path(spark, "feed")
        self._parts = [df.where((at >= c) & (at < c + width)) for c in cuts]
        self._parts[0].write.mode("append").parquet(self._path)
        self.records = spark.readStream.schema(df.schema).parquet(self._path)

    def steps(self) -> Iterator[None]:
        yield
        for part in self._parts[1:]:
            part.write.mode("append").parquet(self._path)
            yield


def live_scale(records: DataFrame, scaler: Scaler) -> DataFrame:
    """The frozen scaler; nothing is refitted online."""
    return scaler.transform(records)


def live_threshold(scores: DataFrame, thresholds: DataFrame, stream: str = "score_name") -> DataFrame:
    """Frozen thresholds joined to a live score stream, with the strict alarm.

    The thresholds are staged once, so every micro-batch sees the same ones; one
    row a stream. A stream without one keeps its scores, with the threshold +inf.
    """
    frozen = stage(thresholds.select(stream, F.col("threshold").alias("_t")), "frozen")
    joined = scores.join(frozen, stream, "left").withColumn("threshold", F.coalesce("_t", F.lit(INF)))
    return joined.drop("_t").withColumn("alarm", alarm())


def live_detection_report(
    records: DataFrame, onsets: DataFrame, episode: str = "episode", index: str = "raw_index",
    alarm_col: str = "alarm",
) -> DataFrame:
    """Running counts per episode, a stateful aggregate for update mode.

    The onsets are staged once, so their size is known: they are broadcast below
    the bounds of :func:`lookup`, and otherwise both sides are shuffled. Records
    never are: a slice of them can look small as a file, and would pass the driver.
    """
    frozen = stage(onsets.select(episode, "onset", "fault_id"), "frozen")
    how = "broadcast" if fits(frozen) else "merge"
    joined = records.join(frozen.hint(how), episode, "inner")
    return joined.groupBy(episode, "fault_id", "onset").agg(
        *detection_report_columns(index, F.col(alarm_col), F.col("onset"))
    )


def run_to_end(writer: Callable[[], DataStreamWriter], replay: Replay | None = None) -> None:
    """Run a query over everything available, once per slice of a replay.

    Each run resumes from the checkpoint of the one before, as after a restart.
    """
    for _ in replay.steps() if replay is not None else [None]:
        writer().trigger(availableNow=True).start().awaitTermination()


def drain(stream: DataFrame, replay: Replay | None = None, label: str = "drained") -> DataFrame:
    """Run an append stream to its end and return the written table."""
    spark = stream.sparkSession
    path, marks = new_path(spark, label), new_path(spark, "progress")

    def writer() -> DataStreamWriter:
        out = stream.writeStream.format("parquet").outputMode("append")
        return out.option("path", path).option("checkpointLocation", marks)

    run_to_end(writer, replay)
    return spark.read.schema(stream.schema).parquet(path)


def drain_updates(stream: DataFrame, keys: Sequence[str], replay: Replay | None = None,
                  label: str = "updates") -> DataFrame:
    """Run an update-mode aggregate; the newest version of each key is kept.

    A replayed micro-batch overwrites its own folder, so a restart after a lost
    executor leaves no duplicates.
    """
    spark = stream.sparkSession
    path, marks = new_path(spark, label), new_path(spark, "progress")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    def writer() -> DataStreamWriter:
        out = stream.writeStream.outputMode("update").foreachBatch(write)
        return out.option("checkpointLocation", marks)

    run_to_end(writer, replay)
    return latest(spark.read.parquet(path), list(keys), "version").drop("version")


def live_report(
    replay: Replay, onsets: DataFrame, episode: str = "episode", index: str = "raw_index",
    alarm_col: str = "alarm",
) -> DataFrame:
    """Detection report of a finished feed, with rates and delay."""
    running = live_detection_report(replay.records, onsets, episode, index, alarm_col)
    counts = drain_updates(running, [episode, "fault_id", "onset"], replay, "report")
    return finish_detection_report(counts, "onset")
