"""Apparatus entries from aligned segments: which spans get an entry, and every witness's reading of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as C
from ..functions import udfs as U
from ..session import small, spread


def aligned(lemma: DataFrame, witnesses: DataFrame) -> DataFrame:
    """``ab_id, witness, lt, wt, spans, cover, diff`` of every witness segment with a lemma.

    ``lemma`` has ab_id, text; ``witnesses`` has witness, ab_id, text. Equal
    (lemma, witness) texts are aligned once, equal token lists not at all.
    """
    pairs = lemma.select("ab_id", F.col("text").alias("l")).join(witnesses.select("ab_id", "witness", F.col("text").alias("w")), "ab_id")
    tokens = pairs.select("ab_id", "witness", C.tokens(F.col("l")).alias("lt"), C.tokens(F.col("w")).alias("wt"))
    different = F.col("lt") != F.col("wt")
    # equal pairs one after the other in one task, which remembers what it has aligned: lists are moved once, without a join
    todo = spread(tokens.where(different), "lt", "wt").sortWithinPartitions(F.xxhash64("lt", "wt"))
    changed = todo.withColumn("_a", U.alignment("lt", "wt")).select("ab_id", "witness", "lt", "wt", "_a.*")
    index = F.sequence(F.lit(0), F.size("lt") - 1)
    whole = F.transform(index, lambda i: F.struct(i.alias("a"), (i + 1).alias("b"), F.get(F.col("lt"), i).alias("surface")))
    same = tokens.where(~different).select(
        "lt", "wt", "ab_id", "witness", F.when(F.size("lt") > 0, whole).otherwise(F.array().cast(U.SPANS)).alias("spans"),
        F.when(F.size("lt") > 0, F.transform(index, lambda i: F.array(i))).otherwise(F.array().cast("array<array<int>>")).alias("cover"),
        F.array().cast("array<int>").alias("diff"),
    )
    cols = ["ab_id", "witness", "lt", "wt", "spans", "cover", "diff"]
    return changed.select(*cols).union(same.select(*cols))


def entry_spans(work: DataFrame) -> DataFrame:
    """``ab_id, a, b``: spans of several tokens that a witness fuses or splits; single tokens that differ somewhere or hold a space and lie in no such span.

    A segment without any such span gets all its tokens one by one.
    """
    # spans are sorted out inside a segment's cell: its lists aren't repeated for every span
    inside = lambda s: F.slice("cover", s["a"] + 1, s["b"] - s["a"])
    fused = lambda s: (F.size(F.array_distinct(inside(s))) == 1) & (F.size(F.get(F.col("cover"), s["a"])) == 1)
    split = lambda s: F.exists(inside(s), lambda x: F.size(x) > 1)
    spans = lambda hit: work.select("ab_id", F.explode(F.filter("spans", hit)).alias("s")).select("ab_id", "s.a", "s.b")
    many = spans(lambda s: (s["b"] - s["a"] > 1) & (fused(s) | split(s))).distinct()
    differing = work.select("ab_id", F.explode("diff").alias("a")).distinct()
    spaced = spans(lambda s: (s["b"] - s["a"] == 1) & F.contains(F.trim(s["surface"]), F.lit(" "))).select("ab_id", "a")
    ones = differing.union(spaced).distinct().withColumn("b", F.col("a") + 1)
    m = many.select(F.col("ab_id").alias("m_ab"), F.col("a").alias("ma"), F.col("b").alias("mb"))
    free = ones.join(m, (F.col("ab_id") == F.col("m_ab")) & (F.col("a") >= F.col("ma")) & (F.col("b") <= F.col("mb")), "left_anti")
    some = many.union(free)
    rest = work.select("ab_id", F.size("lt").alias("n")).distinct().join(some.select("ab_id").distinct(), "ab_id", "left_anti")
    every = rest.where("n > 0").select("ab_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("a"))
    return some.union(every.withColumn("b", F.col("a") + 1))


def readings(work: DataFrame, spans: DataFrame, witnesses: DataFrame) -> DataFrame:
    """``app_id, ab_id, a, b, lem, witness, rdg``: one row for every entry and witness; an empty text where a witness lacks the segment."""
    lemma = work.groupBy("ab_id").agg(F.first("lt").alias("lt"))
    apps = spans.join(lemma, "ab_id").select(
        F.concat_ws("-", F.lit("app"), "ab_id", "a", "b").alias("app_id"), "ab_id", "a", "b", F.expr("array_join(slice(lt, a + 1, b - a), ' ')").alias("lem")
    )
    grid = apps.crossJoin(small(witnesses.select("witness").distinct()))  # entries x witnesses is the result itself
    at = "array_sort(array_distinct(flatten(slice(cover, a + 1, b - a))))"
    rdg = F.expr(f"array_join(transform({at}, i -> get(wt, i)), ' ')")
    out = grid.join(work.select("ab_id", "witness", "cover", "wt"), ["ab_id", "witness"], "left")
    return out.select("app_id", "ab_id", "a", "b", "lem", "witness", F.coalesce(rdg, F.lit("")).alias("rdg"))


def grouped_readings(rows: DataFrame) -> DataFrame:
    """``app_id, rdg, wits``: witnesses of equal readings together, sorted."""
    return rows.groupBy("app_id", "rdg").agg(F.array_join(F.array_sort(F.collect_list("witness")), " ").alias("wits"))
