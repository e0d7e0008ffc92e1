"""Queries over atomic differences, the annotation cascade and what follows from it, with SQL that derives the differences again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import udfs as U
from .kernels.annotate import Annotator
from .kernels.diff import DIPHTHONGS
from .kernels.text import EQUIVALENT, GRAPHEMES
from .operators import cascade, curate, post, relations
from .plans import collate
from .queries import _rule, differing_pairs, query, table, with_
from .queries_align import _KEY as _KEYS
from .queries_align import _SQL_NW, _SQL_TEXT, _TAIL, _made_stanzas, made
from .queries_more import _c, _turns, recursive, sql_ratio
from .session import scratch_path
from .sources import config, sinks, xml

# -- differences of words ------------------------------------------------------------------------------

_KNOWN = "|".join(sorted(GRAPHEMES, key=len, reverse=True))


def sql_atoms(rows: str, name: str) -> str:
    """CTEs from ``rows`` (distinct lists x, y) to ``name`` (x, y, ops): list of structs (del, ins) of uneven runs and (was, now) of even ones, left to right.

    List elements become single characters, so that common blocks are found as in strings;
    what lies between two blocks is a run of differences.
    """
    chars = "array_to_string(list_transform({0}, lambda g: chr(20000 + list_position(voc, g)::INT)), '')"
    return f"""
{name}_v AS (SELECT x, y, list_distinct(list_concat(x, y)) AS voc FROM {rows}),
{name}_c AS (SELECT x, y, {chars.format('x')} AS a, {chars.format('y')} AS b FROM {name}_v),
{name}_p AS (SELECT DISTINCT a, b FROM {name}_c), {sql_ratio(f'{name}_p', f'{name}_r')},
{name}_b AS (SELECT x, y, c.a, c.b, ah AS i, bh AS j, k FROM {name}_c c JOIN {name}_r_cut r ON r.a = c.a AND r.b = c.b WHERE k > 0
  UNION ALL SELECT x, y, a, b, len(x), len(y), 0 FROM {name}_c WHERE a <> b),
{name}_g AS (SELECT x, y, coalesce(lag(i + k) OVER w, 0) AS i1, i AS i2, coalesce(lag(j + k) OVER w, 0) AS j1, j AS j2 FROM {name}_b WINDOW w AS (PARTITION BY x, y ORDER BY i, j)),
{name}_o AS (SELECT x, y, i1, j1, CASE WHEN i2 - i1 = j2 - j1 THEN list_transform(range(1, i2 - i1 + 1), lambda k: [x[i1 + k], y[j1 + k]])
    ELSE list_concat(list_transform(x[i1 + 1:i2], lambda g: [g, NULL]), list_transform(y[j1 + 1:j2], lambda g: [NULL, g])) END AS parts FROM {name}_g WHERE i2 > i1 OR j2 > j1),
{name} AS (SELECT x, y, flatten(list(parts ORDER BY i1, j1)) AS ops FROM {name}_o GROUP BY x, y)"""


def sql_names(rep: str = "{0}") -> str:
    """Features of the parts in ``ops``."""
    r = rep.format
    return f"list_transform(ops, lambda p: CASE WHEN p[1] IS NULL THEN {r('p[2]')} || ' inserted' WHEN p[2] IS NULL THEN {r('p[1]')} || ' deleted' ELSE {r('p[2]')} || '→' || {r('p[1]')} END)"


def sql_compare(c: str) -> str:
    """Compare-normal form of a word of Latin letters."""
    return rf"regexp_replace(regexp_replace(lower(strip_accents(translate({c}, '.,;:·⸳', ''))), 'ϑ', 't', 'g'), '(^|[^\w])y([aeiou])', '\1\2', 'g')"


_GRAPHS = f"regexp_extract_all({{0}}, '({_KNOWN}|(?s:.))')"
_BARE = "translate({0}, '.,;:·⸳', '')"
_FINAL = "regexp_replace({0}, '[.,;:·⸳]+$', '')"
_REP = "CASE {0} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in EQUIVALENT.items()) + " ELSE {0} END"
_PLAIN = r"regexp_replace({0}, '\.+$', '')"


@query("atomic_features", recursive(with_(f""", w AS (SELECT lem, rdg, {_BARE.format('lem')} AS l, {_BARE.format('rdg')} AS r FROM diffs),
  gl AS (SELECT DISTINCT {_GRAPHS.format('l')} AS x, {_GRAPHS.format('r')} AS y FROM w WHERE l <> r), {sql_atoms('gl', 'at_')}
SELECT lem, rdg, CASE WHEN l = r OR (l <> '' AND r <> '' AND {sql_compare('l')} = {sql_compare('r')}) THEN '' ELSE array_to_string({sql_names()}, ';') END AS ops,
  CASE WHEN l = '' AND r <> '' THEN rdg || ' inserted' WHEN r = '' AND l <> '' THEN lem || ' deleted' WHEN l = '' AND r = '' THEN 'no_change'
    WHEN {sql_compare('l')} <> {sql_compare('r')} THEN rdg || ' for ' || lem ELSE 'subst' END AS feature
FROM w LEFT JOIN at_ ON x = {_GRAPHS.format('l')} AND y = {_GRAPHS.format('r')}""")))  # fmt: skip
def atomic_features(spark, d):
    pairs = differing_pairs(spark, d)
    return pairs.select("lem", "rdg", F.array_join(U.atomic_ops("lem", "rdg"), ";").alias("ops"), U.token_feature("lem", "rdg").alias("feature"))


@query("equivalent_features", recursive(with_(f""", w AS (SELECT lem, rdg, {_GRAPHS.format(_FINAL.format('lem'))} AS x, {_GRAPHS.format(_FINAL.format('rdg'))} AS y FROM diffs),
  gl AS (SELECT DISTINCT x, y FROM w WHERE x <> y), {sql_atoms('gl', 'at_')}
SELECT lem, rdg, coalesce(array_to_string({sql_names('(' + _REP + ')')}, ';'), '') AS ops FROM w LEFT JOIN at_ ON at_.x = w.x AND at_.y = w.y""")))  # fmt: skip
def equivalent_features(spark, d):
    return differing_pairs(spark, d).select("lem", "rdg", F.array_join(U.equivalent_ops("lem", "rdg"), ";").alias("ops"))


_ONE = "length(l) = length(r) AND len(list_filter(range(1, length(l) + 1), lambda i: substr(l, i, 1) <> substr(r, i, 1))) = 1"


@query("inferred_features", with_(f""", w AS (SELECT lem, rdg, {_PLAIN.format('lem')} AS l, {_PLAIN.format('rdg')} AS r FROM diffs)
SELECT lem, rdg, CASE WHEN r = '' THEN 'deleted' WHEN l = '' THEN r || ' inserted' WHEN l = r THEN 'no_change' WHEN {_ONE} THEN r || ' for ' || l ELSE r || '→' || l END AS feature FROM w"""))
def inferred_features(spark, d):
    return differing_pairs(spark, d).select("lem", "rdg", U.inferred_feature("lem", "rdg").alias("feature"))


_DIPH = "CASE " + " ".join(f"WHEN contains(l, '{a}') AND contains(r, '{b}') THEN '{a}→{b}'" for a, b in DIPHTHONGS) + " ELSE '' END"


@query("diphthong_notes", f"""WITH w AS (SELECT DISTINCT p_name, replace(replace(p_name, 'a', 'aō'), 'e', 'aē') AS l, CASE p_size % 3 WHEN 0 THEN replace(p_name, 'a', 'ō') WHEN 1 THEN replace(replace(p_name, 'e', 'ē'), 'o', 'u') ELSE p_name END AS r, p_size % 3 AS k FROM part)
SELECT p_name, k, {_DIPH} AS note FROM (SELECT p_name, k, coalesce(t[1], '') AS l, coalesce(t[2], '') AS r FROM (SELECT p_name, k,
  list_filter(list_transform(range(1, len(string_split(l, ' ')) + 1), lambda i: [string_split(l, ' ')[i], string_split(r, ' ')[i]]), lambda p: {sql_compare('p[1]')} <> {sql_compare('p[2]')})[1] AS t FROM w))""")  # fmt: skip
def diphthong_notes(spark, d):
    n, k = F.col("p_name"), F.col("p_size") % 3
    swap = lambda c, *ps: swap(F.replace(c, F.lit(ps[0][0]), F.lit(ps[0][1])), *ps[1:]) if ps else c
    r = F.when(k == 0, swap(n, ("a", "ō"))).when(k == 1, swap(n, ("e", "ē"), ("o", "u"))).otherwise(n)
    return table(spark, d, "part").select("p_name", k.alias("k"), U.concise_diphthong(swap(n, ("a", "aō"), ("e", "aē")), r).alias("note")).distinct()


@query("sql_functions", recursive(with_(f""", sp AS (SELECT lem AS a, rdg AS b FROM diffs), {sql_ratio('sp')} SELECT a, b, round(s, 9) AS s, nfc_normalize(a) AS composed FROM ratio""")))
def sql_functions(spark, d):
    U.register(spark)
    return differing_pairs(spark, d).selectExpr("lem a", "rdg b", "round(gestalt_ratio(lem, rdg), 9) s", "nfc(lem) composed")


# -- cascade -------------------------------------------------------------------------------------------

_POLICY = [_rule("match", "e→i", "meaningful", groups=["EUROPE"]), _rule("match", "i→o", "trivial", direction="reverse"), _rule("match_regex", "[ae] inserted", "meaningful", barred=["ASIA"]), _rule("match_regex", "inserted", "trivial")]
_CASCADE = """
  r AS (SELECT DISTINCT p_name, p_size % 10 AS k, p_size % 3 AS g FROM part),
  t AS (SELECT *, p_name || '-' || k || '-' || g AS app_id, CASE k WHEN 0 THEN p_name WHEN 1 THEN ' ' WHEN 2 THEN replace(p_name, 'a', 'ā') WHEN 3 THEN p_name || '.,' WHEN 4 THEN replace(p_name, ' ', '') WHEN 5 THEN 'any'
    WHEN 6 THEN p_name || ' the' WHEN 7 THEN 'yy' || p_name || 'e' WHEN 8 THEN regexp_replace(p_name, 'i', 'e') ELSE regexp_replace(p_name, 'i', 'o') END AS rdg FROM r)"""


def _cascade(spark, d) -> DataFrame:
    """Readings that each take one way through the cascade, by groups of witnesses."""
    n, k, g = F.col("p_name"), F.col("k"), F.col("g")
    rows = table(spark, d, "part").select("p_name", (F.col("p_size") % 10).alias("k"), (F.col("p_size") % 3).alias("g")).distinct()
    first = lambda to: F.regexp_replace(n, "^([^i]*)i", f"$1{to}")
    rdg = (
        F.when(k == 0, n).when(k == 1, " ").when(k == 2, F.replace(n, F.lit("a"), F.lit("ā"))).when(k == 3, _c(n, ".,")).when(k == 4, F.replace(n, F.lit(" "), F.lit(""))).when(k == 5, "any")
        .when(k == 6, _c(n, " the")).when(k == 7, _c("yy", n, "e")).when(k == 8, first("e")).otherwise(first("o"))
    )
    rows = rows.select(F.concat_ws("-", "p_name", "k", "g").alias("app_id"), n.alias("lem"), rdg.alias("rdg"), F.when(g == 0, "#1").when(g == 1, "#2").otherwise("#1 #2").alias("wit"), "k")
    groups = spark.createDataFrame([("1", "EUROPE"), ("2", "ASIA")], "witness string, grp string")
    overrides = rows.where("k = 5").select("app_id", F.lit("any.").alias("rdg_text"), F.lit("meaningful").alias("label_override"))
    annotator = Annotator(_POLICY, "", [], [], frozenset(["the"]), {}, frozenset(), False)
    return collate.annotated_readings(rows.drop("k"), groups, annotator, overrides)


_HAS = "contains(p_name, 'i')"
_LABEL = f"""CASE WHEN k = 1 THEN 'missing' WHEN k IN (0, 2, 3, 4) THEN 'trivial' WHEN k IN (5, 6) THEN 'meaningful' WHEN k = 7 THEN CASE WHEN g = 0 THEN 'meaningful' ELSE 'trivial' END
  WHEN NOT {_HAS} THEN 'trivial' WHEN k = 8 THEN CASE WHEN g IN (0, 2) THEN 'meaningful' ELSE 'unknown' END ELSE 'trivial' END"""


@query("cascade_ways", f"""WITH {_CASCADE} SELECT app_id, {_LABEL} AS label,
  CASE {_LABEL} WHEN 'meaningful' THEN '#variants' WHEN 'trivial' THEN '#readings' WHEN 'missing' THEN '#missing' ELSE '#unknown' END AS ana,
  CASE WHEN k = 1 THEN 'missing' WHEN k IN (0, 2) THEN 'diacritic' WHEN k = 3 THEN 'punct' WHEN k = 4 THEN 'space-only' WHEN k = 5 THEN 'override-reading' WHEN k = 6 THEN 'whitelist-change'
    WHEN k IN (8, 9) AND NOT {_HAS} THEN 'diacritic' WHEN {_LABEL} = 'unknown' THEN 'none' ELSE 'atomic-' || {_LABEL} END AS rule, CASE WHEN k = 1 THEN '0.000' ELSE '0.500' END AS cert FROM t""")  # fmt: skip
def cascade_ways(spark, d):
    return _cascade(spark, d).select("app_id", "label", "ana", "rule", "cert")


@query("cascade_notes", f"""WITH {_CASCADE} SELECT app_id, CASE WHEN k = 1 THEN 'word missing' WHEN k = 4 THEN 'space deleted' WHEN k = 7 THEN 'y inserted; y inserted; e inserted' WHEN k = 8 THEN 'e→i' ELSE 'o→i' END AS n
FROM t WHERE k IN (1, 4, 7) OR (k IN (8, 9) AND {_HAS} AND {_LABEL} <> 'unknown')""")
def cascade_notes(spark, d):
    out = _cascade(spark, d).withColumn("k", F.regexp_extract("app_id", r"-(\d)-\d$", 1).cast("int"))
    changed = F.contains("lem", F.lit("i")) & (F.col("label") != "unknown")
    return out.where(F.col("k").isin(1, 4, 7) | (F.col("k").isin(8, 9) & changed)).select("app_id", "n")


@query("review_list", f"""WITH {_CASCADE} SELECT app_id, p_name AS lem_text, rdg AS rdg_text, 'none' AS inference_rule FROM t WHERE {_LABEL} = 'unknown'""")
def review_list(spark, d):
    return cascade.unknowns(_cascade(spark, d)).select("app_id", "lem_text", "rdg_text", "inference_rule")


@query("bare_pairs", f"""WITH {_CASCADE} SELECT app_id, CASE WHEN k IN (8, 9) AND {_HAS} THEN CASE WHEN k = 8 THEN 'meaningful' ELSE 'trivial' END WHEN k = 7 THEN 'meaningful' ELSE 'trivial' END AS label,
  CASE WHEN k = 8 AND {_HAS} THEN 'e→i' WHEN k = 9 AND {_HAS} THEN 'o→i' WHEN k = 7 THEN 'y inserted; y inserted; e inserted' ELSE 'no_change' END AS note FROM t WHERE k IN (0, 2, 3, 7, 8, 9)""")
def bare_pairs(spark, d):
    annotator = Annotator(_POLICY)
    run = F.udf(lambda a, b: dict(zip(("label", "note"), annotator.pair(a, b, ["EUROPE"]), strict=True)), "struct<label:string,note:string>", useArrow=True)
    rows = _cascade(spark, d).withColumn("k", F.regexp_extract("app_id", r"-(\d)-\d$", 1).cast("int")).where("k in (0, 2, 3, 7, 8, 9)")
    return rows.withColumn("p", run("lem", "rdg")).select("app_id", "p.*")


@query("snippet_readings", """
WITH s AS (SELECT p_partkey, 'app-' || (p_partkey % 500) AS app_id, '#ms' || (p_size % 7) AS wit, p_brand AS rdg, 'f' || (p_size % 5) AS n FROM part),
  c AS (SELECT * FROM (VALUES ('f0', 'variant', 0.9, 3), ('f1', 'reading', 0.2, 1), ('f2', '', 0.72, 4)) v(f, label, v, k))
SELECT DISTINCT app_id, wit, rdg, 'score-v3' AS resp, coalesce(printf('%.3f', v), '0.500') AS cert, CASE n WHEN 'f0' THEN '#meaningful' WHEN 'f1' THEN '#trivial' ELSE '#unknown' END AS ana, n
FROM s LEFT JOIN c ON f = n WHERE p_partkey % 500 < 300 AND NOT (n = 'f1' AND wit = '#ms1' AND p_partkey % 500 = 1)""")  # fmt: skip
def snippet_readings(spark, d):
    p = table(spark, d, "part")
    snippets = p.select(_c("app-", F.col("p_partkey") % 500).alias("app_id"), _c("#ms", F.col("p_size") % 7).alias("wit_list"), F.col("p_brand").alias("rdg_text"), _c("f", F.col("p_size") % 5).alias("feature"))
    flags = "orthography_match boolean, punct_penalty_applied boolean, singleton_demoted boolean, lexical_whitelist_applied boolean, unstable boolean"
    scores = spark.createDataFrame([("f0", "variant", 0.9, 3, *[False] * 5), ("f1", "reading", 0.2, 1, *[False] * 5), ("f2", "", 0.72, 4, *[False] * 5)], f"feature string, label string, variant_likelihood double, doc_freq int, {flags}")
    there = spark.range(300).select(_c("app-", F.col("id")).alias("app_id"), F.when(F.col("id") == 1, "#ms1").otherwise("#ms9").alias("wit"), F.lit("score-v3").alias("resp"), F.lit("f1").alias("n"))
    return cascade.readings_from_snippets(snippets, scores, there).drop("type")


# -- gate, maps, trims, texts --------------------------------------------------------------------------


@query("gate_diagnostics", recursive(f"""WITH m AS (SELECT l_orderkey, l_linenumber, lower(l_shipdate::VARCHAR) AS x, 'w' || (l_partkey % 97) AS a, 'w' || (l_suppkey % 89) AS b, CASE l_linenumber % 3 WHEN 0 THEN 'substitution' WHEN 1 THEN 'equal' ELSE 'insert' END AS rel FROM lineitem),
  sp AS (SELECT DISTINCT a, b FROM m WHERE rel = 'substitution'), {sql_ratio('sp')},
  g AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (rel = 'substitution') AS subs, count(*) FILTER (rel = 'substitution' AND s < 0.75) AS low, count(*) FILTER (rel = 'insert') AS un,
    count(*) FILTER (length(m.b) <= 3) AS short FROM m LEFT JOIN ratio r ON r.a = m.a AND r.b = m.b AND rel = 'substitution' GROUP BY l_orderkey)
SELECT l_orderkey || '' AS xml_id, n AS canon_count, n AS our_count, subs AS subs_total, low AS subs_low, un AS unmatched, short AS short_tokens, (subs + un) / greatest(1, n) AS error_rate,
  array_to_string(list_filter([CASE WHEN low >= 6 THEN 'low_conf_subs' END, CASE WHEN (subs + un) / greatest(1, n) >= 0.2 THEN 'high_error_rate' END, CASE WHEN short >= 6 THEN 'short_token_cluster' END], lambda x: x IS NOT NULL), ',') AS triggers,
  low >= 6 OR (subs + un) / greatest(1, n) >= 0.2 OR short >= 6 AS flagged FROM g"""))  # fmt: skip
def gate_diagnostics(spark, d):
    n = F.col("l_linenumber")
    one = F.struct(
        F.array(n).alias("canon_indexes"), F.array(n).alias("our_indexes"), _c("w", F.col("l_partkey") % 97).alias("canon_word"), _c("w", F.col("l_suppkey") % 89).alias("our_word"),
        F.when(n % 3 == 0, "substitution").when(n % 3 == 1, "equal").otherwise("insert").alias("relation"), F.lit(True).alias("matched"),
    )
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("xml_id")).agg(F.collect_list(one).alias("matches"))
    words = F.transform("matches", lambda m: m["our_word"])
    out = relations.gate(rows.withColumns({"canon": words, "our": words}))
    return out.withColumn("triggers", F.array_join("triggers", ","))


@query("word_maps", f"""WITH RECURSIVE {_SQL_NW},
  w AS (SELECT made.xml_id, made.canon, made.our, made.pid, unnest(range(len(our))) AS i FROM made),
  z AS (SELECT xml_id, canon, our, i, coalesce((SELECT list_sort(list_distinct(flatten(list(c)))) FROM groups g WHERE g.pid = w.pid AND list_contains(o, i)), []) AS cs FROM w)
SELECT xml_id, CAST(i AS INT) AS our_index, our[i + 1] AS our_word, array_to_string(cs, ',') AS canon_indexes, array_to_string(list_transform(cs, lambda k: canon[k + 1]), ' ') AS canon_words,
  CASE WHEN len(cs) = 0 THEN 'unmatched' WHEN len(cs) > 1 THEN 'many-to-one' WHEN canon[cs[1] + 1] = our[i + 1] THEN 'equal' ELSE 'substitution' END AS relation FROM z""")  # fmt: skip
def word_maps(spark, d):
    rows = relations.word_rows(relations.dp_groups(_made_stanzas(spark, d)), "groups", "dp")
    return rows.select("xml_id", "our_index", "our_word", F.array_join(F.col("dp_canon_indexes").cast("array<string>"), ",").alias("canon_indexes"), F.array_join("dp_canon_words", " ").alias("canon_words"), F.col("dp_relation").alias("relation"))


@query("point_fixes", """
SELECT conv_id, turn, CASE WHEN turn % 3 = 0 AND contains(role, 'us') THEN 'fixed' ELSE role END AS rdg FROM conversations""")
def point_fixes(spark, d):
    rows = _turns(spark, d).select("conv_id", "turn", _c("app-", F.col("conv_id")).alias("app_id"), F.col("turn").cast("string").alias("witness"), F.col("role").alias("rdg"))
    fixes = rows.where("turn % 3 = 0").select("app_id", "witness", F.lit("us").alias("guard_text"), F.lit("fixed").alias("new_text"))
    return post.point_fixes(rows, fixes).select("conv_id", "turn", "rdg")


@query("side_by_side", """
SELECT conv_id, turn AS ord, rpad(role, greatest(length(role), length(turn || 'abcdef'))::INT, ' ') || chr(9) || rpad(turn || 'abcdef', greatest(length(role), length(turn || 'abcdef'))::INT, ' ') AS text FROM conversations""")
def side_by_side(spark, d):
    rows = _turns(spark, d).withColumn("other", _c(F.col("turn"), "abcdef"))
    return sinks.side_by_side(rows, "conv_id", "turn", "role", "other")


_SQL_NATIONS = "FROM nation JOIN region ON n_regionkey = r_regionkey"


def _config(spark, d) -> DataFrame:
    """A configuration file for each region: groups, remapped ids, rules, families and a list of words."""
    k, n = F.col("n_nationkey"), F.col("n_name")
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = {
        "groups": _c('"', k, '"'), "witnesses": _c('  "', k, '": {"A', k, '": "B', n, '"}\n'),
        "rules": _c("- {match", F.when(k % 2 == 0, "").otherwise("_regex"), ': "', n, '→x", label: ', F.when(k % 3 == 0, " Meaningful ").otherwise('""'), ", direction: Forward, groups: [", F.col("r_name"), "]}\n"),
        "families": _c('  f', k, ':\n    patterns: ["', n, '"]\n    nested: {compare_only: [q]}\n'),
    }
    rows = rows.select("r_name", "n_nationkey", *[x.alias(c) for c, x in lines.items()])
    whole = rows.groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", *lines))).alias("r"))
    all_of = lambda c, between="": F.array_join(F.transform("r", lambda x: x[c]), between)
    text = _c("groups:\n  ", F.col("r_name"), ": [", all_of("groups", ", "), "]\nwitnesses:\n", all_of("witnesses"), "rules:\n", all_of("rules"), "families:\n", all_of("families"), "default_nontrivial_label: ", F.col("r_name"), "\n")
    return whole.select(_c("conf/", F.col("r_name"), ".yaml").alias("path"), F.encode(text, "UTF-8").alias("content"))


@query("config_files", f"SELECT n_nationkey || '' AS witness, r_name AS grp, 'A' || n_nationkey AS ab_id, 'B' || n_name AS lookup_id {_SQL_NATIONS}")
def config_files(spark, d):
    files = _config(spark, d)
    return config.groups_of(files).join(config.remap_of(files), ["path", "witness"]).drop("path")


@query("config_rules", f"""SELECT 'conf/' || r_name || '.yaml' AS path, CAST(row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1 AS INT) AS ord, CASE WHEN n_nationkey % 2 = 0 THEN 'match' ELSE 'match_regex' END AS kind, n_name || '→x' AS pattern,
  CASE WHEN n_nationkey % 3 = 0 THEN 'meaningful' ELSE 'trivial' END AS label, 'forward' AS direction, r_name AS groups, r_name AS otherwise {_SQL_NATIONS}""")
def config_rules(spark, d):
    return config.rules_of(_config(spark, d)).select("path", "ord", "kind", "pattern", "label", "direction", F.array_join("groups", ",").alias("groups"), "otherwise")


@query("config_families", f"""WITH f AS (SELECT 'conf/' || r_name || '.yaml' AS path, n_nationkey, n_name, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1 AS k {_SQL_NATIONS})
SELECT path, CAST(2 * k AS INT) AS ord, 'f' || n_nationkey AS family, n_name AS patterns, '' AS compare_only FROM f UNION ALL SELECT path, CAST(2 * k + 1 AS INT), 'nested', '', 'q' FROM f""")
def config_families(spark, d):
    out = config.families_of(_config(spark, d), strict=False)
    return out.select("path", "ord", "family", F.array_join("patterns", ",").alias("patterns"), F.array_join("compare_only", ",").alias("compare_only"))


@query("config_words", "SELECT 'conf/' || r_name AS path, n_name AS token FROM nation JOIN region ON n_regionkey = r_regionkey")
def config_words(spark, d):
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    text = rows.groupBy("r_name").agg(F.collect_list(_c(" ", F.col("n_name"), "\n# ", F.col("n_nationkey"), "\n\n")).alias("x"))
    return config.whitelists_of(text.select(_c("conf/", F.col("r_name")).alias("path"), F.encode(F.array_join("x", ""), "UTF-8").alias("content")))


#: turns in a file of ``files_once``: files grow in number, neither with a conversation nor with the table
TURNS = 10_000


@query("files_once", "SELECT DISTINCT conv_id FROM conversations")
def files_once(spark, d):
    """Conversations whose first turn stands in the files under two paths that hold the same ones; a file read twice would show as an id twice.

    A file holds turns of many conversations, one a line: a folder and a file for each took the writer's and the lister's time for each.
    """
    root = scratch_path(spark, "files")
    line = _c('<ab n="', F.coalesce(F.col("conv_id").cast("string"), F.lit("")), ".", F.col("at"), '">', F.coalesce(F.col("turn").cast("string"), F.lit("")), "</ab>")
    _turns(spark, d).select(line.alias("value")).write.option("maxRecordsPerFile", TURNS).text(root)
    lines = xml._files(spark, [root, f"{root}/*"], "*.txt").select(F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("x"))
    first = F.regexp_extract("x", r'^<ab n="(-?\d*)\.0">', 1)
    return lines.where(F.col("x").rlike(r'^<ab n="-?\d*\.0">')).select(F.nullif(first, F.lit("")).cast("long").alias("conv_id"))


# -- spans without the full programme, fused readings, catalogue ---------------------------------------

_SQL_MADE = f"""
base AS (SELECT DISTINCT p_name AS ab_id, p_size % 8 AS e, 's' || p_size AS witness, p_name || '{_TAIL}' AS t FROM part),
pairs_ AS (SELECT DISTINCT ab_id, e, string_split(t, ' ') AS lt, string_split({_SQL_TEXT}, ' ') AS wt FROM base WHERE e <> 7)"""


def _made_pairs(spark, d) -> DataFrame:
    lemma, wits = made(spark, d)
    return wits.join(lemma.select("ab_id", F.col("text").alias("l")), "ab_id").select("ab_id", F.split("l", " ").alias("lt"), F.split("text", " ").alias("wt")).distinct()


def _spans_text(c: str):
    return F.array_join(F.transform(c, lambda s: F.concat(s["a"], F.lit("-"), s["b"], F.lit(":"), s["surface"])), "|")


@query("opcode_spans", f"""WITH RECURSIVE {_SQL_MADE}, gl AS (SELECT DISTINCT lt AS x, wt AS y FROM pairs_ WHERE lt <> wt), {sql_atoms('gl', 'at_')},
  s AS (SELECT x, y, unnest(range(i, i + k)) AS a, unnest(range(j, j + k)) AS w, NULL AS e FROM at__b WHERE k > 0
    UNION ALL SELECT x, y, i1, j1, i2 FROM at__g WHERE i2 > i1 AND j2 > j1 AND (i2 - i1 = 1) <> (j2 - j1 = 1)
    UNION ALL SELECT x, y, unnest(range(i1, i2)), unnest(list_transform(range(i2 - i1), lambda k: CASE WHEN j1 + k < j2 THEN j1 + k ELSE -1 END)), NULL FROM at__g WHERE i2 > i1 AND NOT (j2 > j1 AND (i2 - i1 = 1) <> (j2 - j1 = 1))
    UNION ALL SELECT lt, wt, unnest(range(len(lt))), unnest(range(len(lt))), NULL FROM (SELECT DISTINCT lt, wt FROM pairs_ WHERE lt = wt)),
  g AS (SELECT x, y, i1, j1, j2 FROM at__g),
  o AS (SELECT s.x, s.y, a, coalesce(e, a + 1) AS b, CASE WHEN e IS NOT NULL THEN array_to_string(s.y[w + 1:j2], ' ') WHEN w < 0 THEN '' ELSE s.y[w + 1] END AS surface
    FROM s LEFT JOIN g ON e IS NOT NULL AND g.x = s.x AND g.y = s.y AND g.i1 = a AND g.j1 = w)
SELECT DISTINCT ab_id, array_to_string(wt, ' ') AS text, spans FROM pairs_ JOIN (SELECT x, y, array_to_string(list(a || '-' || b || ':' || surface ORDER BY a), '|') AS spans FROM o GROUP BY x, y) z ON x = lt AND y = wt""")
def opcode_spans(spark, d):
    return _made_pairs(spark, d).select("ab_id", F.array_join("wt", " ").alias("text"), _spans_text(U.opcode_spans("lt", "wt")).alias("spans"))


_RUN = "array_to_string({0}[{1} + 1:{1} + k], '')"


@query("greedy_spans", f"""WITH RECURSIVE {_SQL_MADE},
  todo AS (SELECT row_number() OVER (ORDER BY lt, wt) AS pid, lt, wt, {_KEYS.format('lt')} AS lk, {_KEYS.format('wt')} AS wk, len(lt) AS n, len(wt) AS m FROM (SELECT DISTINCT lt, wt FROM pairs_)),
  cells AS (SELECT *, unnest(range(m)) AS j FROM (SELECT *, unnest(range(n)) AS i FROM todo)), runs AS (SELECT *, unnest([2, 3, 4]) AS k FROM cells),
  cand AS (SELECT pid, i, j, k, 'f' AS way, wk[j + 1] AS a, {_RUN.format('lk', 'i')} AS b FROM runs WHERE i + k <= n UNION ALL SELECT pid, i, j, k, 's', lk[i + 1], {_RUN.format('wk', 'j')} FROM runs WHERE j + k <= m),
  sp AS (SELECT DISTINCT a, b FROM cand), {sql_ratio('sp')},
  fit AS (SELECT pid, i, j, coalesce(max(k) FILTER (way = 'f'), 1) AS f, coalesce(max(k) FILTER (way = 's'), 1) AS s FROM cand c JOIN ratio r ON r.a = c.a AND r.b = c.b WHERE r.s >= 0.75 GROUP BY pid, i, j),
  walk AS (SELECT pid, 0::BIGINT AS i, 0::BIGINT AS j, NULL::BIGINT AS i2, NULL::BIGINT AS j2 FROM todo
    UNION ALL SELECT w.pid, coalesce(w.i2, 0), coalesce(w.j2, 0), coalesce(w.i2, 0) + coalesce(f, 1), coalesce(w.j2, 0) + CASE WHEN coalesce(f, 1) > 1 THEN 1 ELSE coalesce(s, 1) END
    FROM walk w JOIN todo t USING (pid) LEFT JOIN fit x ON x.pid = w.pid AND x.i = coalesce(w.i2, 0) AND x.j = coalesce(w.j2, 0) WHERE coalesce(w.i2, 0) < n AND coalesce(w.j2, 0) < m),
  done AS (SELECT pid, i, i2, j, j2 FROM walk WHERE i2 IS NOT NULL),
  o AS (SELECT pid, i AS a, i2 AS b, array_to_string(wt[j + 1:j2], ' ') AS surface FROM done JOIN todo USING (pid)
    UNION ALL SELECT pid, k, k + 1, '' FROM (SELECT pid, unnest(range(e, n)) AS k FROM (SELECT pid, n, (SELECT max(i2) FROM done d WHERE d.pid = todo.pid) AS e FROM todo)))
SELECT DISTINCT ab_id, array_to_string(p.wt, ' ') AS text, spans FROM pairs_ p JOIN todo t ON t.lt = p.lt AND t.wt = p.wt
  JOIN (SELECT pid, array_to_string(list(a || '-' || b || ':' || surface ORDER BY a), '|') AS spans FROM o GROUP BY pid) z USING (pid)""")
def greedy_spans(spark, d):
    return _made_pairs(spark, d).select("ab_id", F.array_join("wt", " ").alias("text"), _spans_text(U.greedy_spans("lt", "wt")).alias("spans"))


_GRAMS = "list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)))"


@query("fused_trims", f"""WITH w AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS want, string_split(p_name, ' ')[1] || ' ' || CASE p_size % 3 WHEN 0 THEN string_split(p_name, ' ')[1] WHEN 1 THEN string_split(p_name, ' ')[2] || ' ed' ELSE 'x' END AS rdg FROM part),
  h AS (SELECT *, replace(rdg, ' ', '') AS have FROM w), long AS (SELECT * FROM h WHERE have <> want AND length(have) > floor(length(want) * 1.4)),
  n AS (SELECT *, unnest(range(greatest(1, length(want) - 2), least(length(have), length(want) + 2) + 1)) AS n FROM long), s AS (SELECT *, unnest(range(length(have) - n + 1)) AS a FROM n),
  j AS (SELECT *, substr(have, a + 1, n) AS cut FROM s), k AS (SELECT *, len(list_intersect({_GRAMS.format('want')}, {_GRAMS.format('cut')})) / len(list_distinct(list_concat({_GRAMS.format('want')}, {_GRAMS.format('cut')}))) AS f FROM j),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY want, rdg ORDER BY f DESC, n, a) AS r FROM k) WHERE r = 1),
  src AS (SELECT *, list_filter(range(1, length(rdg) + 1), lambda i: substr(rdg, i, 1) <> ' ') AS at_ FROM best)
SELECT w.want AS lem, CASE WHEN cut IS NOT NULL AND ((length(have) - length(replace(have, w.want, ''))) / length(w.want) >= 2 OR f >= 0.8) THEN substr(w.rdg, at_[a + 1], at_[a + n] - at_[a + 1] + 1) ELSE w.rdg END AS rdg
FROM w LEFT JOIN src ON src.want = w.want AND src.rdg = w.rdg""")
def fused_trims(spark, d):
    p, n = table(spark, d, "part"), F.col("p_size") % 3
    one, two = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    rows = p.select(one.alias("lem"), F.concat(one, F.lit(" "), F.when(n == 0, one).when(n == 1, F.concat(two, F.lit(" ed"))).otherwise("x")).alias("rdg")).distinct()
    return post.trim_fused(rows).select("lem", "rdg")


_CATALOGUE = ["blue for old", "anvil→rod", "s inserted", "cold→plate", "small deleted"]


@query("catalogue_lookups", recursive(f"""WITH k AS (SELECT unnest({[x.replace(' for ', '→') for x in _CATALOGUE]}) AS key, unnest(range({len(_CATALOGUE)})) AS pl),
  n AS (SELECT replace(key, '→', ' for ') AS key, pl * 2 + 1 AS pl FROM k WHERE contains(key, '→') UNION ALL SELECT key, pl * 2 FROM k),
  q AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS x, string_split(p_name, ' ')[2] AS y, p_size % 3 AS m FROM part),
  o AS (SELECT DISTINCT CASE m WHEN 0 THEN x || '→' || y WHEN 1 THEN y || '→' || x ELSE left(x, 1) || ' inserted' END AS op FROM q),
  sp AS (SELECT op AS a, key AS b FROM o CROSS JOIN n), {sql_ratio('sp')},
  near AS (SELECT a, b, s FROM (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, pl) AS r FROM ratio JOIN n ON key = b WHERE s > 0) WHERE r = 1),
  t AS (SELECT op, split_part(op, '→', 2) || '→' || split_part(op, '→', 1) AS turned, replace(op, '→', ' for ') AS spelt, contains(op, '→') AS two FROM o)
SELECT op, CASE WHEN op IN (SELECT key FROM n) THEN 1.0 WHEN two AND turned IN (SELECT key FROM n) THEN 0.95 WHEN two AND spelt IN (SELECT key FROM n) THEN 0.9 WHEN s >= 0.6 THEN round(s, 9) ELSE 0.0 END::DOUBLE AS sure,
  CASE WHEN op IN (SELECT key FROM n) THEN op WHEN two AND turned IN (SELECT key FROM n) THEN turned WHEN s >= 0.6 THEN replace(b, ' for ', '→') END AS key FROM t LEFT JOIN near ON a = op"""))
def catalogue_lookups(spark, d):
    annotator = Annotator(scores=[{"feature": f, "label": "", "variant_likelihood": 0.5, "doc_freq": 0} for f in _CATALOGUE])

    def look(op: str) -> dict:
        row, sure = annotator.lookup(op)
        return {"sure": round(sure, 9), "key": row["feature"].replace(" for ", "→") if row else None}

    run = F.udf(look, "struct<sure:double,key:string>", useArrow=True)
    x, y, m = F.split("p_name", " ")[0], F.split("p_name", " ")[1], F.col("p_size") % 3
    op = F.when(m == 0, _c(x, "→", y)).when(m == 1, _c(y, "→", x)).otherwise(F.concat(F.substring(x, 1, 1), F.lit(" inserted")))
    return table(spark, d, "part").select(op.alias("op")).distinct().withColumn("r", run("op")).select("op", "r.*")


_FINAL_BARE = "regexp_replace(strip_accents({0}), '[.,;:·⸳]+$', '')"


@query("changes_to_overrides", recursive(with_(f""", w AS (SELECT rdg, {_GRAPHS.format(_FINAL.format('lem'))} AS x, {_GRAPHS.format(_FINAL.format('rdg'))} AS y FROM diffs WHERE trim(lem) <> '' AND trim(rdg) <> '' AND {_FINAL_BARE.format('lem')} <> {_FINAL_BARE.format('rdg')}),
  gl AS (SELECT DISTINCT x, y FROM w WHERE x <> y), {sql_atoms('gl', 'at_')},
  f AS (SELECT DISTINCT unnest({sql_names('(' + _REP + ')')}) AS feature FROM w JOIN at_ ON at_.x = w.x AND at_.y = w.y),
  c AS (SELECT * FROM (VALUES ('i→e', 'variant', 0.9, 3), ('s inserted', 'reading', 0.2, 1), ('e deleted', '', 0.3, 4)) t(key, label, v, n)),
  sp AS (SELECT feature AS a, key AS b FROM f CROSS JOIN c), {sql_ratio('sp')},
  best AS (SELECT a, b, s FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM ratio WHERE s > 0) WHERE r = 1 AND s >= 0.6),
  d AS (SELECT key, CASE WHEN (label = 'variant' AND n >= 2 AND v >= 0.75) OR (regexp_matches(a, ' (inserted|deleted)$') AND regexp_matches(a, '\\p{{L}}') AND length(regexp_replace(a, ' (inserted|deleted)$', '')) >= 2) THEN 'meaningful'
    WHEN label = 'reading' OR (n >= 3 AND v < 0.72) THEN 'trivial' END AS lab FROM best JOIN c ON key = b)
SELECT key AS feature, CASE WHEN bool_or(lab = 'meaningful') THEN 'meaningful' ELSE 'trivial' END AS label_override FROM d WHERE lab IS NOT NULL GROUP BY key""")))  # fmt: skip
def changes_to_overrides(spark, d):
    pairs = differing_pairs(spark, d).select(F.col("rdg").alias("ocr_word"), F.col("lem").alias("manual_word"), F.lit("app").alias("app_id"))
    cat = spark.createDataFrame(
        [("i→e", "variant", 0.9, 3, False, False, False, False), ("s inserted", "reading", 0.2, 1, False, False, False, False), ("e deleted", "", 0.3, 4, False, False, False, False)],
        "feature string, label string, variant_likelihood double, doc_freq int, orthography_match boolean, punct_penalty_applied boolean, singleton_demoted boolean, lexical_whitelist_applied boolean",
    )
    return curate.strongest(curate.changes_to_overrides(pairs, cat)[0], ["feature"])


@query("span_readings", f"""WITH RECURSIVE {_SQL_MADE}, gl AS (SELECT DISTINCT lt AS x, wt AS y FROM pairs_), {sql_atoms('gl', 'at_')},
  runs AS (SELECT x, y, i AS i1, i + k AS i2, j AS j1, j + k AS j2, true AS eq FROM at__b WHERE k > 0 UNION ALL SELECT x, y, i1, i2, j1, j2, false FROM at__g WHERE i2 > i1 OR j2 > j1
    UNION ALL SELECT x, y, 0, len(x), 0, len(y), true FROM gl WHERE x = y),
  asked AS (SELECT x, y, unnest(range(len(x))) AS a, 1 AS w FROM gl UNION ALL SELECT x, y, 1, 3 FROM gl),
  hits AS (SELECT q.x, q.y, a, w, i1, j1, CASE
      WHEN w = 3 THEN CASE WHEN eq THEN q.y[j1 + greatest(i1, a) - i1 + 1:j1 + least(i2, a + w) - i1] ELSE q.y[j1 + 1:j2] END
      WHEN j2 = j1 THEN [] ELSE [q.y[j1 + 1 + CASE WHEN j2 - j1 = i2 - i1 THEN a - i1 ELSE least(j2 - j1 - 1, CAST(floor((a - i1) / (i2 - i1) * (j2 - j1)) AS BIGINT)) END]] END AS ws
    FROM asked q JOIN runs r ON r.x = q.x AND r.y = q.y AND i2 > a AND i1 < a + w)
SELECT ab_id, array_to_string(wt, ' ') AS text, CAST(a AS INT) AS a, w AS width, array_to_string(flatten(list(ws ORDER BY i1, j1)), ' ') AS reading
FROM pairs_ JOIN hits ON x = lt AND y = wt GROUP BY ab_id, e, wt, a, w""")
def span_readings(spark, d):
    rows = _made_pairs(spark, d)
    one = rows.select("ab_id", "lt", "wt", F.posexplode("lt").alias("a", "_")).select("ab_id", "lt", "wt", "a", F.lit(1).alias("width"))
    every = one.union(rows.select("ab_id", "lt", "wt", F.lit(1), F.lit(3)))
    return every.select("ab_id", F.array_join("wt", " ").alias("text"), "a", "width", U.reading_of("lt", "wt", "a", F.col("a") + F.col("width")).alias("reading"))


@query("realigned_stanzas", f"""WITH RECURSIVE {_SQL_NW},
  g AS (SELECT pid, array_to_string(list(array_to_string(c, ',') || '/' || array_to_string(o, ',') ORDER BY run), ' ') AS groups FROM groups GROUP BY pid),
  m AS (SELECT xml_id, groups, array_to_string(list_transform(range(least(len(canon), len(our))), lambda i: i || '/' || i), ' ') AS greedy FROM made JOIN g USING (pid) WHERE CAST(regexp_extract(xml_id, 's(\\d+)$', 1) AS INT) % 2 = 0)
SELECT xml_id, greedy, groups, greedy <> groups AS changed FROM m""")
def realigned_stanzas(spark, d):
    rows = _made_stanzas(spark, d)
    one = lambda i: F.struct(
        F.array(i).alias("canon_indexes"), F.array(i).alias("our_indexes"), F.get(F.col("canon"), i).alias("canon_word"), F.get(F.col("our"), i).alias("our_word"), F.lit("equal").alias("relation"), F.lit(True).alias("matched")
    )
    matched = rows.withColumn("matches", F.transform(F.sequence(F.lit(0), F.least(F.size("canon"), F.size("our")) - 1), one))
    flags = rows.select("xml_id", (F.regexp_extract("xml_id", r"s(\d+)$", 1).cast("int") % 2 == 0).alias("flagged"))
    join = lambda c: F.array_join(c.cast("array<string>"), ",")
    text = lambda c: F.array_join(F.transform(c, lambda g: F.concat(join(g["c"]), F.lit("/"), join(g["o"]))), " ").alias(c)
    return relations.realigned(matched, flags).select("xml_id", text("greedy"), text("groups"), "changed")
