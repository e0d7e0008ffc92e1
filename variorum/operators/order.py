"""Neighbours in document order, over documents of any length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

MOST = 1_000_000  # rows of a range, about


def neighbours(rows: DataFrame, doc: list[str], order: list[str], value: str, most: int = MOST) -> DataFrame:
    """``rows`` plus ``before`` and ``after``: the ``value`` of the row before and behind in the order of ``order`` inside a document ``doc`` (none: all rows are one).

    Rows go to ranges of document order, of about ``most`` rows, so a document may fill many tasks and a task doesn't grow with the table. Each range looks inside itself;
    only its first and last row are exchanged, one of each for a range. A null value is
    a neighbour as any other; rows of equal place stand in no certain order.
    """
    keys = [*doc, *order]
    # written once: ranges must not change between the rows and their ends
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // most))
    ranged = written(rows.repartitionByRange(n, *keys).withColumn("_range", F.spark_partition_id()))
    row = F.struct(F.struct(*[F.col(c) for c in doc] or [F.lit(0)]).alias("doc"), F.col(value).alias("value"))
    inside = Window.partitionBy("_range").orderBy(*keys)
    here = ranged.repartition(n, "_range").withColumns({"_row": row, "_before": F.lag(row).over(inside), "_after": F.lead(row).over(inside)})
    ends = ranged.groupBy("_range").agg(F.min_by(row, F.struct(*keys)).alias("first"), F.max_by(row, F.struct(*keys)).alias("last"))
    along = Window.orderBy("_range")  # as many rows as ranges
    ends = ends.select("_range", F.lag("last").over(along).alias("_last"), F.lead("first").over(along).alias("_first"))
    # a side of one row a range: bounded by the number of partitions
    here = here.join(F.broadcast(ends), "_range").withColumns({"_before": F.coalesce("_before", "_last"), "_after": F.coalesce("_after", "_first")})
    near = lambda c: F.when(F.col(f"{c}.doc").eqNullSafe(F.col("_row.doc")), F.col(f"{c}.value"))
    return here.withColumns({"before": near("_before"), "after": near("_after")}).drop("_range", "_row", "_before", "_after", "_last", "_first")
