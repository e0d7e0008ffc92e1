"""Shared helpers: materialised tables in the shared folder, joins, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch, scratch_path  # noqa: F401  what operators write goes with the scratch around them

#: white space of the word definition shared by several operators: \x20 and \x09-\x0D
WORD = r"[^\x20\x09-\x0D]+"


def materialize(df: DataFrame, compact: bool = False) -> DataFrame:
    """Cut lineage through a Parquet table in the shared folder.

    Every later read sees the same rows, and a lost executor costs no
    recomputation of what stands before the table. ``compact`` deals rows to files of
    the size that adaptive execution aims at: for thin rows of many tasks, which
    would leave as many tiny files.
    """
    spark = df.sparkSession
    df = df.hint("rebalance") if compact else df
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """``df`` written once, and read again as ``buckets`` partitions by Spark's hash of ``key``: joins on ``key`` leave it where it is."""
    spark = df.sparkSession
    path = scratch_path(spark, "buckets")
    name = "variorum_" + path.rpartition("-")[2]
    df.write.format("parquet").option("path", path).bucketBy(buckets, key).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # of the catalog alone: the table is external
    return out


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df``, written and counted, to be broadcast if it has at most ``most`` rows; else joins are left to Spark."""
    df = materialize(df, compact=True)
    return F.broadcast(df) if df.count() <= most else df


def unlike(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it as long as ``df`` has such a column."""
    while name.lower() in map(str.lower, df.columns):
        name = f"_{name}"
    return name


def join_skewed(rows: DataFrame, keyed: DataFrame, on: list[str], hot: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, which holds each key once with ``n``, its number of rows (dropped).

    Keys with at least one in ``hot`` of all rows (at most ``hot`` keys) are
    broadcast, so that no task gathers their rows; the others meet by shuffle.
    """
    total = keyed.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * hot >= total
    few = F.broadcast(keyed.where(often).drop("n"))
    rest = rows.join(few.select(*on), on, "left_anti").join(keyed.where(~often).drop("n"), on)
    return rows.join(few, on).unionByName(rest)


def connected_components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` longs, undirected, to ``(node, root)``, root the smallest node reachable.

    Alternates large-star and small-star steps (each a group-by minimum with
    map-side combine and a join back) until the edge set is a set of stars.
    No node's neighbours are gathered in one row, so hubs only make skewed
    joins, which AQE splits. Nodes without an edge are not returned.
    Self-loops and nulls are ignored; no edges give no rows.
    """
    now = materialize(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a is not null and b is not null and a > b")
        .distinct()
    )
    sign = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == sign or not seen[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        sign = seen
        # large star: every larger neighbour of u points at the smallest node around u
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a > b").distinct()
        # small star: u and its smaller neighbours point at the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(small.union(least.select("a", F.col("m").alias("b"))).distinct())
