"""Annotation of readings by the cascade, on distinct inputs; score policies and triage as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as C
from ..kernels.annotate import Annotator
from ..session import small, spread

RESULT = "struct<label:string,cert:string,n:string,rule:string,feature:string,likelihood:double>"
#: fixed values: categories that labels are written as
CATEGORY = {"meaningful": "variants", "trivial": "readings", "missing": "missing"}


def category(label: Column) -> Column:
    out = F.lit("unknown")
    for k, v in CATEGORY.items():
        out = F.when(label == k, v).otherwise(out)
    return out


def witness_group_sets(readings: DataFrame, groups: DataFrame) -> DataFrame:
    """Adds ``groups``: every group of the witnesses named in ``wit`` (blank-separated, ``#`` optional)."""
    named = readings.select("wit").distinct().withColumn("witness", F.explode(C.tokens(F.col("wit"))))
    named = named.withColumn("witness", F.regexp_replace("witness", "^#+", ""))
    sets = named.join(small(groups), "witness").groupBy("wit").agg(F.array_sort(F.collect_set("grp")).alias("groups"))
    return readings.join(sets, "wit", "left").withColumn("groups", F.coalesce("groups", F.array().cast("array<string>")))


def _remembering(annotator: Annotator):
    last: dict[tuple, dict] = {}

    def run(lemma, reading, groups, override):
        key = (lemma, reading, tuple(groups if groups is not None else ()), override)
        if key not in last:
            if len(last) >= 10_000:
                last.clear()
            last[key] = annotator.annotate(*key)
        return last[key]

    return run


def annotate(readings: DataFrame, annotator: Annotator, overrides: DataFrame | None = None) -> DataFrame:
    """Adds ``label, cert, n, rule, feature, likelihood, ana`` to ``app_id, lem, rdg, groups``.

    ``overrides`` has app_id, rdg_text (in plain form), label_override. Readings that
    recur over entries and witnesses are annotated once.
    """
    rows = readings.withColumns({"_key": C.plain(F.col("rdg")), "lem": F.coalesce("lem", F.lit("")), "rdg": F.coalesce("rdg", F.lit(""))})
    if overrides is not None:
        o = overrides.select("app_id", C.plain(F.col("rdg_text")).alias("_key"), "label_override").dropDuplicates(["app_id", "_key"])
        rows = rows.join(o, ["app_id", "_key"], "left")
    else:
        rows = rows.withColumn("label_override", F.lit(None).cast("string"))
    run = F.udf(_remembering(annotator), RESULT, useArrow=True).asNondeterministic()  # else every column of the result is another call
    # equal readings one after the other in one task, which remembers the last: a join with the distinct ones moved all rows twice
    rows = spread(rows, "lem", "rdg").sortWithinPartitions(F.xxhash64("lem", "rdg")).withColumn("_r", run("lem", "rdg", "groups", "label_override"))
    out = rows.select(*[c for c in rows.columns if c not in ("_key", "label_override", "_r")], "_r.*")
    return out.withColumn("ana", F.concat(F.lit("#"), category(F.col("label"))))


def unknowns(annotated: DataFrame) -> DataFrame:
    """Readings for review."""
    return annotated.where("label = 'unknown'").select(
        "app_id", F.col("wit").alias("wit_list"), F.col("rdg").alias("rdg_text"), F.col("lem").alias("lem_text"), "feature",
        F.col("likelihood").alias("variant_likelihood"), F.lit("borderline/unstable or unmapped").alias("reason"), F.col("rule").alias("inference_rule"),
    )


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _border(v: Column, n: Column) -> Column:
    return ((v >= 0.70) & (v < 0.75)) | _flag("unstable") | (_flag("orthography_match") & (n >= 3) & (v >= 0.72))


def score_policy(explicit: bool = False) -> Column:
    """Label by score columns: unknown, then meaningful; trivial by default, or only for listed reasons if ``explicit``."""
    v, n = F.col("variant_likelihood"), F.col("doc_freq")
    strong = (F.col("label") == "variant") & ~_flag("orthography_match") & ~_flag("punct_penalty_applied")
    out = F.when(_border(v, n), "unknown").when(strong | _flag("lexical_whitelist_applied") | ((v >= 0.75) & (n >= 3)), "meaningful")
    if not explicit:
        return out.otherwise("trivial")
    why = (F.col("label") == "reading") | _flag("orthography_match") | _flag("punct_penalty_applied") | _flag("singleton_demoted")
    return out.when(why, "trivial").otherwise("unknown")


def override_decision(kind: Column, value: Column) -> Column:
    """Label a changed feature gets from its scores; null where they don't tell."""
    v, n = F.col("variant_likelihood"), F.col("doc_freq")
    loud = (F.col("label") == "variant") & (n >= 2) & (v >= 0.75) & ~_flag("punct_penalty_applied")
    gap = kind.isin("insert", "delete") & C.has_grapheme(value) & (F.length(value) >= 2)
    calm = (F.col("label") == "reading") | _flag("orthography_match") | _flag("punct_penalty_applied") | _flag("singleton_demoted")
    return F.when(loud | gap | _flag("lexical_whitelist_applied"), "meaningful").when(calm | ((n >= 3) & (v < 0.72)), "trivial")


def suggestion(score: Column, orthographic: Column) -> Column:
    return F.when((score >= 0.73) & (score < 0.75) & ~orthographic, "meaningful?").when(orthographic, "trivial?").otherwise("")


def readings_from_snippets(snippets: DataFrame, scores: DataFrame, present: DataFrame) -> DataFrame:
    """Readings to append to entries: ``app_id, wit, rdg, type, resp, cert, ana, n`` for snippets (app_id, wit_list, rdg_text, feature).

    ``present`` holds the apparatus (app_id, wit, resp, n): snippets of unknown entries and
    those whose (entry, witnesses, n) is there already are left out, so running it
    again adds nothing. Features without scores are judged by a likelihood of 0.5.
    """
    flags = ("orthography_match", "punct_penalty_applied", "singleton_demoted", "lexical_whitelist_applied", "unstable")
    s = scores.select(F.col("feature").alias("n"), "label", "variant_likelihood", "doc_freq", *flags)
    rows = snippets.select("app_id", F.col("wit_list").alias("wit"), F.col("rdg_text").alias("rdg"), C.canonical_feature(F.col("feature")).alias("n")).distinct()
    rows = rows.join(present.select("app_id").distinct(), "app_id", "left_semi").join(s, "n", "left")
    rows = rows.withColumns({"label": F.coalesce("label", F.lit("")), "variant_likelihood": F.coalesce("variant_likelihood", F.lit(0.5)), "doc_freq": F.coalesce("doc_freq", F.lit(0))})
    done = present.where("resp = 'score-v3'").select("app_id", F.trim("wit").alias("wit"), "n")
    rows = rows.join(done, ["app_id", "wit", "n"], "left_anti")
    return rows.select(
        "app_id", "wit", "rdg", F.lit("var").alias("type"), F.lit("score-v3").alias("resp"), C.certainty(F.col("variant_likelihood")).alias("cert"),
        F.concat(F.lit("#"), score_policy(True)).alias("ana"), "n",
    )
