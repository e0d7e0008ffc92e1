"""Curation as a stream: every new snapshot of the curator's workbook re-runs overrides and summary.

One micro-batch may bring several snapshots of a file; only the newest edit of each reading
counts, and running a batch again writes the same rows. :mod:`.debounce` waits for a pause
in the edits and sends out only what they change.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import curate

EDITS = "app_id string, rdg_text string, feature string, curator_label string, edited_at timestamp_ntz"


def newest(edits: DataFrame, keys: list[str], when: str, columns: list[str]) -> DataFrame:
    """Of each key the row of latest ``when``, ties by the other columns."""
    row = F.struct(when, *columns)
    return edits.groupBy(*keys).agg(F.max(row).alias("_r")).select(*keys, f"_r.{when}", *[f"_r.{c}" for c in columns])


def merged(state: DataFrame | None, batch: DataFrame, keys: list[str], when: str, columns: list[str]) -> DataFrame:
    rows = batch.select(*keys, when, *columns)
    return newest(rows if state is None else state.unionByName(rows), keys, when, columns)


def _part(keys: list[str], parts: int):
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def _drop(spark: SparkSession, path: str) -> None:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def _manifest(spark: SparkSession, state_path: str, version: int) -> dict[int, int]:
    """Of each part of the state the version that holds it; at most as many rows as parts."""
    return dict(spark.read.schema("part int, held int").parquet(f"{state_path}/manifest/version={version}").collect()) if version >= 0 else {}


def _read(spark: SparkSession, state_path: str, held: dict[int, int], schema) -> DataFrame:
    paths = [f"{state_path}/data/version={v}/part={p}" for p, v in sorted(held.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def follow(
    edits: DataFrame, state_path: str, checkpoint: str, keys: list[str], when: str, columns: list[str],
    react: Callable[[DataFrame, int], None] | None = None, interval: str | None = "1 second", parts: int = 16,
):
    """Start a query that keeps the newest edit of each key under ``state_path`` and calls ``react`` with all of them after each batch.

    The state lies in ``parts`` parts by the hash of the key; a batch writes those anew
    that it touches, and a manifest of which version holds each part. It reads the
    manifest before its own, so a repeated batch changes nothing; versions that neither
    of the last two manifests names are removed. Without an interval all that is there
    is processed once.
    """
    schema = edits.select(*keys, when, *columns).schema

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        held = _manifest(spark, state_path, n - 1)
        rows = newest(batch, keys, when, columns).withColumn("part", _part(keys, parts)).persist()
        touched = sorted(r.part for r in rows.select("part").distinct().collect())
        before = _read(spark, state_path, {p: held[p] for p in touched if p in held}, schema)
        new = merged(before, rows, keys, when, columns).withColumn("part", _part(keys, parts))
        new.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{state_path}/data/version={n}")
        rows.unpersist()
        now = held | dict.fromkeys(touched, n)
        spark.createDataFrame(list(now.items()), "part int, held int").coalesce(1).write.mode("overwrite").parquet(f"{state_path}/manifest/version={n}")
        if n >= 2:  # what only manifests before the last one name
            needed = {*now.items(), *held.items()}
            for p, v in _manifest(spark, state_path, n - 2).items():
                if (p, v) not in needed:
                    _drop(spark, f"{state_path}/data/version={v}/part={p}")
        if react:
            react(latest(spark, state_path, n, schema), n)

    writer = edits.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def latest(spark: SparkSession, state_path: str, version: int, schema) -> DataFrame:
    """The state after the batch ``version`` (the last one or the one before it); none without a batch."""
    return _read(spark, state_path, _manifest(spark, state_path, version), schema)


def overrides(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the current state of the workbook decides, by feature and by reading."""
    return curate.consensus(state)
