"""Post-processing of apparatus entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as C
from ..functions import udfs as U
from ..session import small, spread


def split_entries(rows: DataFrame) -> DataFrame:
    """Entries of several lemma tokens whose readings all have as many (or are empty) become one entry a token.

    A meaningful reading becomes trivial where its token equals the lemma's; where a
    reading is too short, its token is missing.
    """
    r = rows.withColumns({"_l": C.tokens(F.col("lem")), "_r": C.tokens(F.col("rdg"))})
    uneven = F.bool_or((F.size("_r") > 0) & (F.size("_r") != F.size("_l")))
    keep = r.groupBy("app_id").agg((uneven | (F.max(F.size("_l")) <= 1)).alias("_keep"))
    r = r.join(keep, "app_id")
    cut = r.where("not _keep").select(*r.columns, F.posexplode("_l").alias("_i", "_lem"))
    token = F.coalesce(F.get(F.col("_r"), F.col("_i")), F.lit(""))
    gone = F.col("_i") >= F.size("_r")
    kind = F.when(gone, "missing").when((F.col("type") == "meaningful") & (token == F.col("_lem")), "trivial").otherwise(F.col("type"))
    cut = cut.withColumns({"app_id": F.concat_ws("-", "app_id", "_i"), "lem": F.col("_lem"), "rdg": token, "type": kind})
    return r.where("_keep").select(*rows.columns).unionByName(cut.select(*rows.columns))


def _by_pairs(rows: DataFrame, run, name: str) -> DataFrame:
    """``rdg`` replaced by ``run(lem, rdg)``, worked out once for each distinct pair."""
    pairs = spread(rows.select("lem", "rdg").distinct(), "lem", "rdg").withColumn("_new", run)
    return rows.join(pairs, ["lem", "rdg"]).withColumn(name, F.col("_new") != F.col("rdg")).withColumn("rdg", F.col("_new")).drop("_new")


def trim_fused(rows: DataFrame) -> DataFrame:
    return _by_pairs(rows, U.trim_fused("lem", "rdg"), "changed")


def trim_windows(rows: DataFrame) -> DataFrame:
    return _by_pairs(rows, U.best_window("lem", "rdg"), "changed")


def trim_segments(rows: DataFrame) -> DataFrame:
    return _by_pairs(rows, U.trim_by_segments(C.tokens(F.col("lem")), F.col("rdg")), "changed")


def trim_spillover(rows: DataFrame, doc: list[str], order: list[str]) -> DataFrame:
    """Words of the two lemmas before and after go from the ends of a reading that is too long."""
    lem = rows.select(*doc, *order, "lem").distinct().withColumn("_t", C.tokens(F.col("lem")))
    w = Window.partitionBy(*doc).orderBy(*order)
    lem = lem.withColumns({
        "_before": F.array(F.lag("_t", 1).over(w), F.lag("_t", 2).over(w)), "_after": F.array(F.lead("_t", 1).over(w), F.lead("_t", 2).over(w)),
    })
    out = rows.join(lem.drop("lem"), [*doc, *order])
    keys = ["rdg", "_t", "_before", "_after"]
    long = out.where(F.size(C.tokens(F.col("rdg"))) > F.size("_t")).select(*keys).distinct()
    done = long.withColumn("_new", U.drop_neighbours(*keys)).toDF(*[f"k{k}" for k in keys], "_new")
    out = out.join(done, [F.col(k).eqNullSafe(F.col(f"k{k}")) for k in keys], "left")
    out = out.select(*[c for c in rows.columns if c != "rdg"], F.col("rdg").alias("_old"), "_new")
    new = F.coalesce("_new", "_old")
    return out.withColumns({"rdg": new, "changed": new != F.col("_old")}).select(*rows.columns, "changed")


def trimmed_lines(lines: DataFrame, lemmas: str, readings: str) -> DataFrame:
    """``lines`` with the list ``readings`` trimmed, one reading for each of the list ``lemmas``.

    Does to lines that are whole in a cell what :func:`trim_spillover` and then :func:`trim_fused` do to rows of their words,
    without a shuffle; a task remembers the pairs of words that it has compared.
    """
    return lines.withColumn(readings, U.trimmed_line(lemmas, readings))


def point_fixes(rows: DataFrame, fixes: DataFrame) -> DataFrame:
    """``app_id, witness, guard_text, new_text``: readings that still hold the guarded text get the new one."""
    f = fixes.select("app_id", "witness", F.col("guard_text").alias("_g"), F.col("new_text").alias("_n"))
    out = rows.join(small(f), ["app_id", "witness"], "left")
    return out.withColumn("rdg", F.when(F.contains("rdg", F.col("_g")), F.col("_n")).otherwise(F.col("rdg"))).select(*rows.columns)
