"""Alignment store: a Parquet table with one row for each witness, stanza and word, into which later batches are merged.

Rows lie in buckets by witness and, inside, by stanza. A batch rewrites the buckets that it has
rows for, and no other file: adding a witness leaves nearly all of the others' alone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

KEY = ("witness_id", "stanza_id", "our_index")
WITNESSES, STANZAS = 64, 4  # buckets by witness, and of each of these by stanza


def _bucket(witnesses: int, stanzas: int) -> Column:
    return (F.pmod(F.xxhash64("witness_id"), F.lit(witnesses)) * stanzas + F.pmod(F.xxhash64("stanza_id"), F.lit(stanzas))).cast("int")


def _layout(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """Buckets of the store at ``path`` as its folder names tell, or None where there is no store."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
    found = [m for m in (re.fullmatch(r"layout=(\d+)x(\d+)", n) for n in names) if m]
    return (int(found[0][1]), int(found[0][2])) if found else None


def latest(rows: DataFrame, key: tuple[str, ...], order: list[str]) -> DataFrame:
    """One row of each key, the last by ``order``; rows with a null in their key are none's double and all stay."""
    whole = F.col("_whole")
    known = " and ".join(f"{c} is not null" for c in key)
    packed = rows.withColumn("_whole", F.struct(*rows.columns))
    last = packed.where(known).groupBy(*key).agg(F.max_by(whole, F.struct(*order)).alias("_whole"))
    return last.select("_whole.*").unionByName(rows.where(f"not ({known})"))


def merge_alignments(df: DataFrame, path: str, order: list[str], witnesses: int = WITNESSES, stanzas: int = STANZAS) -> None:
    """Merge rows into the store at ``path``, which is made if need be: a row replaces the one of its witness, stanza and index, others stay.

    Of rows of one batch with the same key the last by ``order`` (columns of ``df``) counts. A null witness,
    stanza or index never conflicts: such rows are added every time. Columns that the store
    doesn't have are added (null in older rows), those that the batch lacks are null in its rows.
    The number of buckets is that of the first write. The merged rows are written to the
    shared folder first, so nothing is read from files while they are replaced; one writer at a time.
    """
    spark = df.sparkSession
    have = _layout(spark, path)
    witnesses, stanzas = have or (witnesses, stanzas)
    root = f"{path}/layout={witnesses}x{stanzas}"
    new = written(latest(df, KEY, order).withColumn("bucket", _bucket(witnesses, stanzas)))
    rows = new
    if have:
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # no more than there are buckets
        old = spark.read.option("mergeSchema", True).parquet(root).where(F.col("bucket").isin(touched))
        kept = old.join(new.select(*KEY), list(KEY), "left_anti")
        rows = written(kept.unionByName(new, allowMissingColumns=True))
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", *KEY)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(root)


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the store; columns of later batches are null in older rows."""
    witnesses, stanzas = _layout(spark, path) or (0, 0)
    return spark.read.option("mergeSchema", True).parquet(f"{path}/layout={witnesses}x{stanzas}").drop("bucket")


def read_witness(spark: SparkSession, path: str, witness: str) -> DataFrame:
    """Rows of one witness; only its buckets are read."""
    witnesses, stanzas = _layout(spark, path) or (0, 0)
    rows = spark.read.option("mergeSchema", True).parquet(f"{path}/layout={witnesses}x{stanzas}")
    first = F.pmod(F.xxhash64(F.lit(witness)), F.lit(witnesses)) * stanzas
    return rows.where((F.col("bucket") >= first) & (F.col("bucket") < first + stanzas) & (F.col("witness_id") == witness)).drop("bucket")
