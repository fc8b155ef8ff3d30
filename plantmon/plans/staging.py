"""Cut lineage with a written table in the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_CHAIN: ContextVar[str | None] = ContextVar("chain", default=None)


def staging_root(spark: SparkSession) -> str:
    """Shared folder for staged tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session
    without that setting gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="run-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{_CHAIN.get() or staging_root(spark) + '/plantmon'}/{label}-{uuid.uuid4().hex}"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end of the block, every table staged inside it.

    Results that depend on them have to be written before. Tables staged
    elsewhere, such as prepared recordings, stay.
    """
    folder = f"{staging_root(spark)}/plantmon/chain-{uuid.uuid4().hex}"
    token = _CHAIN.set(folder)
    try:
        yield
    finally:
        _CHAIN.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, label: str = "stage", path: str | None = None) -> DataFrame:
    """Write ``df`` once as parquet, to a new path or the one given, and read it back.

    A staged table survives lost executors, keeps column pruning and filter
    pushdown, and gives Catalyst its real size. The schema is passed on read,
    so column metadata such as roles is kept.
    """
    spark = df.sparkSession
    path = path or new_path(spark, label)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
