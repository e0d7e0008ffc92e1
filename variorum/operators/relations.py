"""Word relations from greedy and dynamic-programming alignments, the gate between them, and the final choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as C
from ..functions import udfs as U
from ..session import spread


def _together(stanzas: DataFrame) -> DataFrame:
    """Equal (canon, our) pairs one after the other in one task, which remembers what it has aligned: the lists are moved once, without a join."""
    return spread(stanzas, "canon", "our").sortWithinPartitions(F.xxhash64("canon", "our"))


def greedy_matches(stanzas: DataFrame) -> DataFrame:
    """Adds ``matches`` to ``xml_id, canon, our``; equal stanza pairs are aligned once."""
    return _together(stanzas).withColumn("matches", U.align_greedy.once("canon", "our"))


def dp_groups(stanzas: DataFrame) -> DataFrame:
    return _together(stanzas).withColumn("nw", U.align_nw.once("canon", "our")).select(*stanzas.columns, F.col("nw.groups").alias("groups"), F.col("nw.score").alias("score"))


def gate(matched: DataFrame, low: float = 0.75, subs: int = 6, errors: float = 0.20, short: int = 6, short_length: int = 3) -> DataFrame:
    """Adds diagnostics of a greedy alignment and ``flagged``: whether dynamic programming should look at the stanza again.

    Unmatched are manuscript words without a canon word; short tokens are manuscript
    words of at most ``short_length`` characters without full stops, matched or not.
    """
    counts = ("subs_total", "subs_low", "unmatched", "short_tokens")
    rows = diagnosed(matched, low, short_length).select("xml_id", "canon_count", "our_count", *counts)
    # a stanza's own sums: nothing but numbers is moved
    d = rows.groupBy("xml_id").agg(F.first("canon_count").alias("canon_count"), F.first("our_count").alias("our_count"), *[F.sum(c).alias(c) for c in counts])
    return _judged(d, subs, errors, short)


def diagnosed(matched: DataFrame, low: float = 0.75, short_length: int = 3) -> DataFrame:
    """Adds ``canon_count, our_count, subs_total, subs_low, unmatched, short_tokens`` to each stanza, from its own ``matches``."""
    bare = lambda c: F.replace(C.stanza_token(c), F.lit("."), F.lit(""))
    none = matched.schema["matches"].dataType.simpleString()
    single = F.filter(F.coalesce("matches", F.array().cast(none)), lambda m: m["relation"].isNull() | ~F.contains(m["relation"], F.lit("merged")))
    rows = matched.withColumn("_one", single)
    swapped = F.filter("_one", lambda m: m["relation"] == "substitution")
    rows = rows.withColumns({"_a": F.transform(swapped, lambda m: bare(m["canon_word"])), "_b": F.transform(swapped, lambda m: bare(m["our_word"]))})
    ours = lambda m: (m["our_word"] != "") & (F.length(bare(m["our_word"])) <= short_length)
    long = lambda c: F.size(c).cast("long")
    return rows.withColumns({
        "canon_count": F.size("canon"), "our_count": F.size("our"), "subs_total": long("_a"), "subs_low": U.count_below("_a", "_b", F.lit(low)),
        "unmatched": long(F.filter("_one", lambda m: m["relation"] == "insert")), "short_tokens": long(F.filter("_one", ours)),
    }).drop("_one", "_a", "_b")


def _judged(d: DataFrame, subs: int = 6, errors: float = 0.20, short: int = 6) -> DataFrame:
    d = d.withColumn("error_rate", (F.col("subs_total") + F.col("unmatched")) / F.greatest(F.lit(1), F.col("canon_count")))
    why = F.array_compact(F.array(
        F.when(F.col("subs_low") >= subs, "low_conf_subs"), F.when(F.col("error_rate") >= errors, "high_error_rate"),
        F.when(F.col("short_tokens") >= short, "short_token_cluster"),
    ))
    return d.withColumn("triggers", why).withColumn("flagged", F.size("triggers") > 0)


def realigned(matched: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Groups of both methods for flagged stanzas: ``xml_id, greedy, groups, changed``. Only these reach the quadratic aligner."""
    flagged = matched.join(diagnostics.where("flagged"), "xml_id", "left_semi")
    both = dp_groups(flagged).withColumn("greedy", U.greedy_groups("matches"))
    return both.withColumn("changed", F.col("greedy") != F.col("groups"))


def relation(indexes: Column, canon: Column, our_word: Column) -> Column:
    """``unmatched``, ``many-to-one``, ``equal`` or ``substitution`` for one manuscript word."""
    one = C.stanza_token(F.get(canon, indexes[0])) == C.stanza_token(our_word)
    return F.when(F.size(indexes) == 0, "unmatched").when(F.size(indexes) > 1, "many-to-one").when(one, "equal").otherwise("substitution")


def word_rows(stanzas: DataFrame, groups: str, prefix: str, threshold: float | None = None) -> DataFrame:
    """``xml_id, our_index, our_word, <prefix>_canon_indexes, _canon_words, _relation``, a row for every manuscript word.

    ``groups`` is a column of (canon, our) index groups; with a threshold, groups of
    several on both sides are paired by similarity first.
    """
    at = U.group_positions(groups, F.size("our")) if threshold is None else U.pair_groups(groups, "canon", "our")
    return stanzas.withColumn("_at", at).select("xml_id", F.inline(_words("_at", prefix)))


def _words(at: str, prefix: str) -> Column:
    """A stanza's manuscript words with the canon words at the places ``at``: made in the stanza's cell, so that its lists aren't repeated for every word."""
    cis = lambda i: F.get(F.col(at), i)
    return F.transform("our", lambda w, i: F.struct(
        i.alias("our_index"), w.alias("our_word"), cis(i).alias(f"{prefix}_canon_indexes"),
        F.transform(cis(i), lambda c: F.get(F.col("canon"), c)).alias(f"{prefix}_canon_words"), relation(cis(i), F.col("canon"), w).alias(f"{prefix}_relation"),
    ))


def chosen(stanzas: DataFrame, threshold: float) -> DataFrame:
    """Greedy alignment of ``xml_id, canon, our``, dynamic programming where the gate asks for it, and :func:`compared`, each stanza in its own row until the end."""
    rows = diagnosed(greedy_matches(stanzas).withColumn("_g", U.single_positions("matches", F.size("our"))))
    rows = _judged(rows).select("xml_id", "canon", "our", "_g", "flagged")
    asked = lambda c: F.when(F.col("flagged"), F.col(c))  # noqa: E731  nulls cost the aligner nothing
    rows = rows.withColumn("_d", U.dp_positions(asked("canon"), asked("our"), F.lit(threshold)))
    rows = rows.select("xml_id", "flagged", F.inline(F.arrays_zip(_words("_g", "greedy").alias("greedy"), F.when(F.col("flagged"), _words("_d", "dp")).otherwise(F.transform("our", lambda w: F.lit(None))).alias("dp"))))
    dp = [F.col(f"dp.dp_{c}") for c in ("canon_indexes", "canon_words", "relation")]
    return _final(rows.select("xml_id", "greedy.*", *dp))


def decide_final(greedy: Column, dp: Column) -> Column:
    """``dp`` where it has a relation, ``both`` where that is the greedy one too, else ``greedy``, else ``none``."""
    g, d = F.trim(F.coalesce(greedy, F.lit(""))), F.trim(F.coalesce(dp, F.lit("")))
    return F.when((d != "") & (d == g), "both").when(d != "", "dp").when(g != "", "greedy").otherwise("none")


def compared(greedy_rows: DataFrame, dp_rows: DataFrame, compat: bool = False) -> DataFrame:
    """Both results word by word, with the final choice. ``compat`` counts stanzas that dynamic programming never saw as unmatched by it."""
    rows = greedy_rows.join(dp_rows.drop("our_word"), ["xml_id", "our_index"], "left")
    if compat:
        rows = rows.withColumn("dp_relation", F.coalesce("dp_relation", F.lit("unmatched")))
    return _final(rows)


def _final(rows: DataFrame) -> DataFrame:
    choice = decide_final(F.col("greedy_relation"), F.col("dp_relation"))
    by_dp = F.col("final_choice").isin("dp", "both")
    rows = rows.withColumn("final_choice", choice)
    return rows.withColumns({
        "final_relation": F.when(by_dp, F.col("dp_relation")).otherwise(F.col("greedy_relation")),
        "final_canon_indexes": F.when(by_dp, F.col("dp_canon_indexes")).otherwise(F.col("greedy_canon_indexes")),
    })


def exported_groups(stanzas: DataFrame, groups: str = "groups") -> DataFrame:
    """Groups as export rows: pairs where both sides are equally long, else one row a group, and a row for every uncovered word."""
    words = lambda side, at: F.transform(at, lambda i: F.get(F.col(side), i))
    text = lambda at: at.cast("array<string>")

    def row(our_index, our_word, canon_indexes, canon_words, kind, matched) -> Column:
        return F.struct(our_index.alias("our_index"), our_word.alias("our_word"), canon_indexes.alias("canon_indexes"), canon_words.alias("canon_words"), kind.alias("relation"), F.lit(matched).alias("matched"))

    def pair(p) -> Column:
        cw, ow = F.get(F.col("canon"), p["c"]), F.get(F.col("our"), p["o"])
        return row(p["o"].cast("string"), ow, p["c"].cast("string"), cw, F.when(C.stanza_token(cw) == C.stanza_token(ow), "equal").otherwise("substitution"), True)

    def whole(g) -> Column:
        c, o = g["c"], g["o"]
        kind = F.when((F.size(c) > 1) & (F.size(o) == 1), "many-to-one").when((F.size(c) == 1) & (F.size(o) > 1), "one-to-many").otherwise("grouped")
        joined = F.when((F.size(c) == 1) & (F.size(o) > 1), F.get(F.col("canon"), F.get(c, F.lit(0)))).when(F.size(c) > 0, C.joined_canon(words("canon", c))).otherwise("")
        return row(F.array_join(text(o), ";"), F.array_join(words("our", o), " "), F.array_join(text(c), ";"), joined, kind, True)

    # made in the stanza's cell: its lists aren't repeated for every group, nor is what aligned it
    sides = F.transform(groups, lambda g: F.struct(F.array_sort(g["c"]).alias("c"), F.array_sort(g["o"]).alias("o")))
    even = lambda g: (F.size(g["c"]) == F.size(g["o"])) & (F.size(g["c"]) > 0)
    rows = stanzas.select("xml_id", "canon", "our", F.filter(sides, lambda g: F.size(g["c"]) + F.size(g["o"]) > 0).alias("_g"))
    pairs = F.transform(F.flatten(F.transform(F.filter("_g", even), lambda g: F.arrays_zip(g["c"].alias("c"), g["o"].alias("o")))), pair)
    lists = F.transform(F.filter("_g", lambda g: ~even(g)), whole)
    index = F.filter(F.sequence(F.lit(0), F.size("our")), lambda i: i < F.size("our"))
    bare = F.array_except(index, F.flatten(F.transform("_g", lambda g: g["o"])))
    alone = F.transform(bare, lambda i: row(i.cast("string"), F.get(F.col("our"), i), F.lit(""), F.lit(""), F.lit("unmatched"), False))
    return rows.select("xml_id", F.inline(F.concat(pairs, lists, alone)))


def runs(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of canon indices that share one manuscript index: ``keys, our_index, a, b``."""
    per = matches.where("canon_index is not null and our_index is not null").select(*keys, "canon_index", "our_index").distinct()
    place = F.col("canon_index") - F.row_number().over(Window.partitionBy(*keys, "our_index").orderBy("canon_index"))
    return per.withColumn("_r", place).groupBy(*keys, "our_index", "_r").agg(F.min("canon_index").alias("a"), F.max("canon_index").alias("b")).drop("_r")


def upsert(rows: DataFrame, keys: list[str], order: str, nullable: str) -> DataFrame:
    """The last row of each key by ``order``; rows with a null in ``nullable`` never replace one another."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    last = rows.where(F.col(nullable).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return last.unionByName(rows.where(F.col(nullable).isNull()))


def validation(rows: DataFrame) -> DataFrame:
    """``final_choice, n, covered, disagree, unmatched`` over stored alignments, and their share."""
    n = F.count(F.lit(1))
    return rows.groupBy("final_choice").agg(
        n.alias("n"), F.count_if(F.size("final_canon_indexes") > 0).alias("covered"),
        F.count_if((F.col("greedy_relation") != F.col("dp_relation"))).alias("disagree"), F.count_if(F.col("final_relation") == "unmatched").alias("unmatched"),
    )
