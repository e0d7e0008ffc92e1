"""The decision ladder: trivial, meaningful or missing for every reading of a lemma."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as C
from ..functions import udfs as U
from .order import neighbours


def _core(c: Column) -> Column:
    return F.regexp_replace(F.lower(C.strip(c)), r"\.$", "")


def spacing_merge(lemma: Column, reading: Column, before: Column, after: Column) -> Column:
    """Whether the reading is the lemma run together with its neighbour, without inner full stops."""
    r, this = _core(reading), _core(lemma)
    b, a = _core(F.coalesce(before, F.lit(""))), _core(F.coalesce(after, F.lit("")))
    joins = ((a != "") & (F.concat(this, a) == r)) | ((b != "") & (F.concat(b, this) == r))
    return ~F.contains(r, F.lit(".")) & joins


def _searched(ops: Column, pattern: str) -> Column:
    return F.exists(ops, lambda o: o.rlike(pattern))


def rule_label(ops: Column, rules: list[dict], groups: Column | None = None) -> Column:
    """Label of the first rule that some operation meets, whole or by search; rules for groups only where ``groups`` are known."""
    out = F.lit(None).cast("string")
    for r in rules:
        hit = F.array_contains(ops, r["pattern"]) if r["kind"] == "match" else _searched(ops, r["pattern"])
        if groups is not None:
            if r["groups"]:
                hit = hit & F.arrays_overlap(groups, F.array(*map(F.lit, r["groups"])))
            if r["exclude_groups"]:
                hit = hit & ~F.coalesce(F.arrays_overlap(groups, F.array(*map(F.lit, r["exclude_groups"]))), F.lit(False))
        out = F.coalesce(out, F.when(hit, F.lit(r["label"])))
    return out


def with_neighbours(readings: DataFrame, doc: list[str], order: list[str]) -> DataFrame:
    """Adds ``before`` and ``after``, the neighbouring lemmas in document order; ``order`` names a lemma's place inside ``doc``, across segments too."""
    lemmas = neighbours(readings.select(*doc, *order, "lem").distinct(), doc, order, "lem")
    return readings.join(lemmas.drop("lem"), [*doc, *order])


def early(families: list[dict]) -> Column:
    """Every step before the consonant test, over ``lem, rdg, before, after``; null where none decides."""
    l, r = C.ladder_form(F.col("lem")), C.ladder_form(F.col("rdg"))  # noqa: E741
    patterns = [p for f in families for p in (*f["compare_only"], *f["patterns"])]
    return (
        F.when(C.strip(F.coalesce("rdg", F.lit(""))) == "", "missing")
        .when(l == r, "trivial")
        .when(spacing_merge(F.col("lem"), F.col("rdg"), F.col("before"), F.col("after")), "trivial")
        .when(C.families_equal(l, r, patterns), "trivial")
        .when(C.too_short(l, r) | C.too_long(l, r), "meaningful")
    )


def classify(readings: DataFrame, rules: list[dict], families: list[dict], groups: str | None = None) -> DataFrame:
    """Adds ``type`` to rows with ``lem, rdg, before, after``.

    The built-in steps run on all rows; similarity of consonants, which needs
    Python, only on those that are still open after them. Rows stay where they are:
    a join with the distinct open pairs moved every word of every line.
    """
    rows = readings.withColumn("_early", early(families))
    # decided rows pass as nulls; workers remember the pairs they have compared
    bare = lambda c: F.when(F.col("_early").isNull(), F.translate(C.ladder_form(F.col(c)), ". ", ""))
    rows = rows.withColumn("_apart", U.consonants_apart(bare("lem"), bare("rdg"), F.lit(C.VOWELS), F.lit(0.8)))
    ops = C.simple_ops(C.ladder_form(F.col("lem")), C.ladder_form(F.col("rdg")))
    label = rule_label(F.col("_ops"), rules, F.col(groups) if groups else None)
    rows = rows.withColumn("_ops", ops).withColumn(
        "type", F.coalesce("_early", F.when(F.col("_apart"), "meaningful"), F.when(F.size("_ops") > 0, label), F.lit("trivial"))
    )
    return rows.drop("_early", "_apart", "_ops")


def type_summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``type, n, pct`` (of all rows, or of each ``by``)."""
    by = by or []
    counts = rows.groupBy(*by, "type").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(*by)), 6))


