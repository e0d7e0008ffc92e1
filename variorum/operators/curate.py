"""Overrides, their consensus and union; learned features; resolution of snippets to entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as C
from ..functions import udfs as U
from ..session import small, spread, written
from .cascade import override_decision, suggestion


def strongest(rows: DataFrame, keys: list[str], label: str = "label_override") -> DataFrame:
    """One label a key: meaningful beats trivial; other labels keep the first by name."""
    rank = F.when(F.col(label) == "meaningful", 1).otherwise(0)
    return rows.groupBy(*keys).agg(F.max_by(label, F.struct(rank, F.col(label))).alias(label))


def union_overrides(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return strongest(old.select(*keys, "label_override").unionByName(new.select(*keys, "label_override")), keys)


def consensus(curated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Overrides by feature where all curator labels agree, and by reading where a label has no such feature or contradicts it."""
    label = F.lower(F.trim(F.coalesce("curator_label", F.lit(""))))
    rows = curated.withColumn("label_override", label).where(F.col("label_override").isin("meaningful", "trivial"))
    agreed = rows.groupBy("feature").agg(F.min("label_override").alias("a"), F.max("label_override").alias("b")).where("a = b")
    features = agreed.where("feature is not null").select("feature", F.col("a").alias("label_override"))
    known = features.select(F.col("feature").alias("f"), F.col("label_override").alias("k"))
    left = rows.join(known, (F.col("feature") == F.col("f")) & (F.col("label_override") == F.col("k")), "left_anti")
    return features, left.select("app_id", "rdg_text", "label_override")


def auto_overrides(unknown: DataFrame, scores: DataFrame) -> DataFrame:
    """``feature, app_id, rdg_text, label_override`` that scores decide for unknown readings."""
    s = scores.select("feature", F.col("variant_likelihood").alias("v"), "doc_freq", F.col("punct_penalty_applied").alias("p"))
    u = unknown.withColumn("feature", C.canonical_feature(F.col("feature"))).join(small(s), "feature", "left")
    v, punct = F.coalesce("v", "variant_likelihood", F.lit(0.0)), F.coalesce("p", F.lit(False))
    loud = ~punct & (v >= 0.78) & (F.coalesce("doc_freq", F.lit(0)) >= 2)
    label = F.when(loud, "meaningful").when(punct | F.coalesce("orthography_guess", F.lit(False)), "trivial")
    return u.withColumn("label_override", label).where("label_override is not null").select("feature", "app_id", "rdg_text", "label_override")


def triage(unknown: DataFrame) -> DataFrame:
    """The curator's workbook, with a suggestion."""
    v = F.coalesce(F.col("variant_likelihood").try_cast("double"), F.lit(0.5))
    out = unknown.withColumns({"variant_likelihood": v, "orthography_guess": C.orthographic(F.col("feature"))})
    return out.withColumns({
        "band": C.triage_band(F.col("variant_likelihood")), "suggestion": suggestion(F.col("variant_likelihood"), F.col("orthography_guess")),
        "curator_label": F.lit(""), "curator_note": F.lit(""),
    })


def learn_features(unknown: DataFrame, min_count: int = 2, min_likelihood: float = 0.75) -> DataFrame:
    """New catalogue rows from unknown features that recur with a high likelihood."""
    v = F.coalesce(F.col("variant_likelihood").try_cast("double"), F.lit(0.5))
    rows = unknown.select(F.trim("feature").alias("feature"), v.alias("v")).where((F.col("feature") != "") & (F.col("v") >= min_likelihood))
    out = rows.groupBy("feature").agg(F.count(F.lit(1)).alias("doc_freq"), F.avg("v").alias("variant_likelihood")).where(F.col("doc_freq") >= min_count)
    flags = ["orthography_match", "punct_penalty_applied", "singleton_demoted", "lexical_whitelist_applied"]
    return out.select("feature", F.lit("variant").alias("label"), "variant_likelihood", "doc_freq", *[F.lit(False).alias(f) for f in flags])


def changes_to_overrides(words: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From ``ocr_word, manual_word, app_id`` pairs: (decided ``feature, app_id, rdg_text, label_override``; unmapped ``feature, n, nearest``).

    Features without a catalogue row take the nearest key at 0.6, sought once for each distinct feature.
    """
    # once for each pair: a test in Python would be moved below what made the pairs distinct
    rows = words.withColumns({f"_{c}": U.without_marks.once(C.squeeze(F.col(c))) for c in ("ocr_word", "manual_word")})
    bare = lambda c: C.strip_final_punct(F.col(f"_{c}"))
    pairs = rows.where((F.trim("ocr_word") != "") & (F.trim("manual_word") != "") & (bare("ocr_word") != bare("manual_word")))
    # written with a list a pair, as the features are read twice
    pairs = written(pairs.select("app_id", F.col("ocr_word").alias("rdg_text"), U.equivalent_ops.once("manual_word", "ocr_word").alias("ops")))
    atoms = pairs.select("app_id", "rdg_text", F.explode("ops").alias("feature"))
    named = scores.select(F.col("feature").alias("key"), "label", "variant_likelihood", "doc_freq", "orthography_match", "punct_penalty_applied", "singleton_demoted", "lexical_whitelist_applied")
    distinct = written(atoms.select("feature").distinct())
    exact = distinct.join(named.select("key"), distinct["feature"] == F.col("key"))
    near = nearest_keys(distinct.join(exact.select("feature"), "feature", "left_anti"), named.select("key"), 0.0)
    keys = exact.select("feature", "key", F.lit(1.0).alias("s")).union(near.select("feature", "key", "s"))
    rows = atoms.join(small(written(keys)), "feature", "left")  # a feature may have a large part of all rows
    kind = F.when(F.col("feature").endswith(" inserted"), "insert").when(F.col("feature").endswith(" deleted"), "delete").otherwise("subst")
    value = F.regexp_replace("feature", " (inserted|deleted)$", "")
    good = rows.where("s >= 0.6").join(small(named), "key")
    decided = good.withColumn("label_override", override_decision(kind, value)).where("label_override is not null")
    decided = decided.select(F.col("key").alias("feature"), "app_id", "rdg_text", "label_override")
    open_ = rows.where("s is null or s < 0.6").groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.first("key").alias("nearest"))
    return decided, open_


#: similarities down to which keys are sought, one after the other, for features that nothing was found for yet
STEPS = (0.9, 0.75, 0.6, 0.45, 0.3, 0.0)


def _letters(df: DataFrame, c: str) -> DataFrame:
    """``x, n, letters`` of the distinct values of a column: its letters, of which repeated ones are told apart by a number."""
    one = F.filter(F.split("x", ""), lambda ch: ch != "")
    nth = F.transform(one, lambda ch, i: F.concat(ch, F.size(F.filter(F.slice(one, 1, i + 1), lambda o: o == ch)).cast("string")))
    return df.select(F.col(c).alias("x")).where("x is not null").distinct().select("x", F.length("x").alias("n"), nth.alias("letters"))


def likely_keys(features: DataFrame, keys: DataFrame, step: float) -> DataFrame:
    """Pairs ``feature, key`` that may have a similarity of ``step`` or more (of 0: more than 0), from tables of :func:`_letters`.

    Similarity is at most twice the letters in common by all letters. So a key has to hold one of
    a feature's rarest letters, all but as many as may be missing: an inverted list of the keys'
    letters gives the candidates, of which those stay whose bound reaches the step.
    """
    listed = keys.select(F.col("x").alias("key"), F.explode("letters").alias("letter"))
    often = listed.groupBy("letter").agg(F.count(F.lit(1)).alias("often"))
    # of n letters a key as similar as the step shares n * step / (2 - step) at least
    held = features.select("x", "n", F.explode("letters").alias("letter")).join(small(often), "letter", "left")
    rarest = F.row_number().over(Window.partitionBy("x").orderBy(F.coalesce("often", F.lit(0)), "letter"))
    least = F.greatest(F.lit(1), F.ceil(F.col("n") * step / (2 - step) - 1e-9))
    first = held.withColumn("rank", rarest).where(F.col("rank") <= F.col("n") - least + 1).where("often is not null")
    pairs = first.select(F.col("x").alias("feature"), "letter").join(listed, "letter").select("feature", "key").distinct()
    f, k = (t.select(F.col("x").alias(c), F.col("letters").alias(f"_{c}")) for t, c in ((features, "feature"), (keys, "key")))
    bound = 2 * F.size(F.array_intersect("_feature", "_key")) / (F.size("_feature") + F.size("_key"))
    return pairs.join(f, "feature").join(k, "key").where(bound + 1e-9 >= step).select("feature", "key")


def nearest_keys(features: DataFrame, keys: DataFrame, cutoff: float) -> DataFrame:
    """``feature, key, s``: the most similar catalogue key of each feature, ties to the first by name; features that no key reaches are left out.

    Keys are sought at falling similarities (``STEPS``, down to ``cutoff``): all keys that may reach a step are
    compared, so the best of them is the best of all if it does, and the feature is done. Few pairs are ever compared.
    """
    fs, ks = written(_letters(features, "feature")), written(_letters(keys, "key"))
    found = None
    for step in [s for s in STEPS if s > cutoff] + [cutoff]:
        pairs = written(likely_keys(fs, ks, step))
        got = spread(pairs, "feature", "key").withColumn("s", U.gestalt_ratio("feature", "key")).where((F.col("s") > 0) & (F.col("s") >= step))
        got = written(got.groupBy("feature").agg(F.min(F.struct((-F.col("s")).alias("least"), "key")).alias("b")))
        found = got if found is None else found.union(got)
        fs = fs.join(got, fs["x"] == got["feature"], "left_anti")
        if fs.isEmpty():
            break
    return features.join(found, "feature").select("feature", F.col("b.key").alias("key"), (-F.col("b.least")).alias("s"))


TIERS = ("rdg_exact", "lem_exact", "rdg_fuzzy", "lem_fuzzy")


def resolve_snippets(snippets: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds ``app_id, reason, candidate_app_ids`` to ``id, locus, rdg_text, stub`` from ``div_id, app_id, ord, lem, rdg`` of the apparatus.

    An id in the stub wins. Else the best tier in the locus decides: one candidate is
    taken, several are ambiguous.
    """
    s = snippets.withColumn("stub_id", C.app_id_of(F.coalesce("stub", F.lit(""))))
    s = s.withColumn("rdg_text", F.when(F.trim(F.coalesce("rdg_text", F.lit(""))) != "", F.col("rdg_text")).otherwise(C.reading_of(F.coalesce("stub", F.lit("")))))
    s = s.join(s.select("rdg_text").distinct().withColumn("_n", U.search_form("rdg_text")), "rdg_text")
    e = entries.select("div_id", F.col("app_id").alias("cand"), F.coalesce("lem", F.lit("")).alias("lem"), F.coalesce("rdg", F.lit("")).alias("rdg"))
    forms = e.select(F.explode(F.array("lem", "rdg")).alias("x")).distinct().withColumn("form", U.search_form("x"))  # once for each text
    e = e.join(forms.toDF("lem", "_l"), "lem").join(forms.toDF("rdg", "_r"), "rdg").select("div_id", "cand", "_l", "_r").distinct()
    asked = s.where("stub_id = '' and _n <> ''").select("id", F.col("locus").alias("div_id"), "_n")
    # exact tiers have a key; only snippets that they leave open are held against the other forms of their locus
    exact = [asked.join(e.select("div_id", F.col(c).alias("_n"), "cand"), ["div_id", "_n"]).select("id", "cand", F.lit(t).alias("tier")) for t, c in enumerate(("_r", "_l"))]
    exact = exact[0].union(exact[1])
    open_ = asked.join(exact.select("id").distinct(), "id", "left_anti")
    near = []
    for t, c in ((2, "_r"), (3, "_l")):
        texts = e.select("div_id", F.col(c).alias("t")).distinct()
        close = open_.select("div_id", "_n").distinct().join(texts, "div_id").select("_n", "t").distinct()
        close = close.withColumn("like", U.gestalt_ratio("_n", "t") >= 0.92).where("like").drop("like")
        hits = open_.join(close, "_n").join(e.select("div_id", F.col(c).alias("t"), "cand"), ["div_id", "t"])
        near.append(hits.select("id", "cand", F.lit(t).alias("tier")))
    best = exact.union(near[0]).union(near[1]).groupBy("id", "cand").agg(F.min("tier").alias("tier"))
    best = best.withColumn("_top", F.min("tier").over(Window.partitionBy("id"))).where("tier = _top")
    best = best.groupBy("id", "tier").agg(F.array_sort(F.collect_list("cand")).alias("cands"))
    out = s.join(best, "id", "left")
    names = F.array(*map(F.lit, TIERS))
    one, stub = F.size("cands") == 1, F.col("stub_id") != ""
    return out.select(
        *snippets.columns, F.when(stub, F.col("stub_id")).when(one, F.col("cands")[0]).otherwise("").alias("app_id"),
        F.when(stub | one, "").when(F.col("cands").isNull(), F.when(F.coalesce("locus", F.lit("")) != "", "no match in div").otherwise(""))
        .otherwise(F.concat(F.lit("ambiguous ("), F.get(names, F.col("tier")), F.lit(")"))).alias("reason"),
        F.when(~stub & (F.size("cands") > 1), F.array_join("cands", ",")).otherwise("").alias("candidate_app_ids"),
    )
