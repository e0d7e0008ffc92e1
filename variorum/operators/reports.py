"""Counts and distances over features and witnesses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small


def label_counts(readings: DataFrame, by: str = "path") -> DataFrame:
    """Readings of each file by what they were labelled, in either vocabulary."""
    has = lambda *xs: F.count_if(F.col("ana").isin(*xs))
    return readings.groupBy(by).agg(
        has("#meaningful", "#variants").alias("meaningful"), has("#trivial", "#readings").alias("trivial"),
        has("#missing").alias("missing"), has("#unknown").alias("unknown"), F.count(F.lit(1)).alias("readings"),
    )


def feature_frequencies(occurrences: DataFrame) -> DataFrame:
    """``feature, doc_freq, total_count`` of ``feature, witness, n``: witnesses that show a feature, and how often all do."""
    one = occurrences.groupBy("feature", "witness").agg(F.sum("n").alias("n"))
    return one.groupBy("feature").agg(F.count(F.lit(1)).alias("doc_freq"), F.sum("n").alias("total_count"))


def witness_distances(features: DataFrame) -> DataFrame:
    """``wit_a, wit_b, distance``: one minus the Jaccard coefficient of the feature sets of all pairs of witnesses, both ways round and themselves.

    Pairs come from the features they share; the result has one row a pair of
    witnesses, which is what is asked for.
    """
    f = features.select("witness", "feature").distinct()
    size = f.groupBy("witness").agg(F.count(F.lit(1)).alias("n"))
    # features shown by the same witnesses count as one with a weight, so a set that recurs is paired once
    shown = f.groupBy("feature").agg(F.array_sort(F.collect_set("witness")).alias("ws")).groupBy("ws").agg(F.count(F.lit(1)).alias("k"))
    shared = shown.select("k", "ws", F.explode("ws").alias("wit_a")).select("k", "wit_a", F.explode("ws").alias("wit_b")).groupBy("wit_a", "wit_b").agg(F.sum("k").alias("k"))
    a, b = size.toDF("wit_a", "na"), size.toDF("wit_b", "nb")
    grid = a.crossJoin(small(b)).join(shared, ["wit_a", "wit_b"], "left")
    k = F.coalesce("k", F.lit(0))
    return grid.select("wit_a", "wit_b", (1 - k / (F.col("na") + F.col("nb") - k)).alias("distance"))


def distance_matrix(distances: DataFrame, witnesses: list[str]) -> DataFrame:
    return distances.groupBy("wit_a").pivot("wit_b", witnesses).agg(F.first("distance"))


def most_common(rows: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The ``n`` most frequent values, ties by name."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(n)
