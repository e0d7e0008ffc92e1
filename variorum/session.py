"""Session settings the engine is designed for."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # rows of long token arrays: small Arrow batches keep Python workers small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    """A session with ``SETTINGS``; ``more`` overrides them (dots written as double underscores)."""
    b = SparkSession.builder.appName("variorum")
    if master:
        b = b.master(master)
    for k, v in {**SETTINGS, **{k.replace("__", "."): v for k, v in more.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a folder of our own only where that is unset, as in local tests."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="variorum-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: branches that follow read it instead of repeating what made it, and a lost executor costs no more."""
    path = scratch_path(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: folders written so far, those of the innermost :func:`scratch` last
_written: list[list[str]] = [[]]


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, which the :func:`scratch` around it removes."""
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    _written[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, every intermediate table written inside.

    Results are lazy and may read those tables: write or collect them before the end.
    """
    _written.append([])
    try:
        yield
    finally:
        jvm = spark.sparkContext._jvm
        for path in _written.pop():
            there = jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` to be broadcast if it has at most ``most`` rows, which are counted; else joins are left to Spark."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt to as many tasks as shuffles have partitions. Kernels cost by token pair, not by byte,
    so partitions that adaptive execution would join as small must stay apart."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
