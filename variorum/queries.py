"""Queries over the driver's tables, and their DuckDB equivalents.

The tables hold no manuscripts, so near copies in ``documents`` stand in for them:
documents that share their first twelve words are witnesses of one text, the least
id is the lemma, lines are segments and blank-separated words tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as C
from .kernels.annotate import Annotator
from .operators import apparatus, cascade, curate, ladder, post, relations, reports, segments
from .plans import collate
from .session import scratch_path, small, spread, written
from .sources import sinks, tables
from .streaming import curation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

FAMILIES = [
    {"family": "sibilant", "patterns": ["[sz]"], "compare_only": []},
    {"family": "diphthong", "patterns": [], "compare_only": ["ea|ae", "ou|uo"]},
    {"family": "fricative", "patterns": ["[td]"], "compare_only": []},
]
PATTERNS = [p for f in FAMILIES for p in (*f["compare_only"], *f["patterns"])]


def _rule(kind: str, pattern: str, label: str, groups=(), barred=(), direction="either") -> dict:
    return {"ord": 0, "kind": kind, "pattern": pattern, "label": label, "direction": direction, "groups": list(groups), "exclude_groups": list(barred), "notes": None}


RULES = [
    _rule("match", "h inserted", "meaningful"),
    _rule("match_regex", "[ae] (inserted|deleted)", "trivial", groups=["EUROPE"]),
    _rule("match_regex", "i→e|e→i", "trivial", barred=["ASIA"]),
    _rule("match_regex", "→", "meaningful"),
    _rule("match_regex", "deleted", "trivial"),
]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- stand-ins -----------------------------------------------------------------------------------------


#: rows of a cluster that may stand in one task before its lemma's lines are copied for another
TOGETHER = 256


def _cluster_lines(spark: SparkSession, d: str) -> DataFrame:
    """``lemma, doc_id, n, line, text``: :func:`witnesses` with the number of documents in the cluster."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    key = F.array_join(F.slice(F.split(F.lower("text"), r"\s+", 13), 1, 12), " ")  # no more of a text is cut than is asked for
    # a cluster that grows with the table is dealt to many tasks, by its documents' ids
    docs = docs.withColumns({"k": key, "deal": F.pmod(F.xxhash64("doc_id"), F.lit(TOGETHER)).cast("int")})
    dealt = docs.groupBy("k", "deal").agg(F.min("doc_id").alias("lemma"), F.count(F.lit(1)).alias("n"))
    clusters = dealt.groupBy("k").agg(F.min("lemma").alias("lemma"), F.sum("n").alias("n"), F.collect_list("deal").alias("deals")).where("n > 1")
    members = docs.join(clusters.select("k", "lemma", "n", F.explode("deals").alias("deal")), ["k", "deal"])
    return members.select("lemma", "doc_id", "n", F.posexplode(F.split("text", "\n")).alias("line", "text"))


def witnesses(spark: SparkSession, d: str) -> DataFrame:
    """``lemma, doc_id, line, text`` of documents in clusters of two or more; the lemma itself included."""
    return _cluster_lines(spark, d).drop("n")


def collation(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Lemma segments (ab_id, text) and witness segments (witness, ab_id, text); blank lines left out."""
    rows = witnesses(spark, d).withColumn("ab_id", F.concat_ws("_", "lemma", "line")).where("trim(text) <> ''")
    lemma = rows.where("doc_id = lemma").select("ab_id", "text")
    return lemma, rows.where("doc_id <> lemma").select(F.col("doc_id").cast("string").alias("witness"), "ab_id", "text")


def line_pairs(spark: SparkSession, d: str, equal: bool = True) -> DataFrame:
    """``ab_id, witness, l, text``: the witness segments of :func:`collation` with their lemma's text, or those alone whose text is another.

    The lines of a large cluster's lemma are copied, one for each ``TOGETHER`` of its documents, so that no task gathers all witnesses of a line.
    """
    rows = _cluster_lines(spark, d).where("trim(text) <> ''").withColumns({"ab_id": F.concat_ws("_", "lemma", "line"), "parts": F.ceil(F.col("n") / TOGETHER)})
    lemma = rows.where("doc_id = lemma").select("ab_id", F.col("text").alias("l"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    wits = rows.where("doc_id <> lemma").select(F.col("doc_id").cast("string").alias("witness"), "ab_id", "text", F.pmod(F.xxhash64("doc_id"), "parts").alias("part"))
    pairs = wits.join(lemma, ["ab_id", "part"])
    return (pairs if equal else pairs.where("l <> text")).select("ab_id", "witness", "l", "text")


def token_lines(spark: SparkSession, d: str, equal: bool = True) -> DataFrame:
    """``ab_id, witness, lt, wt`` (word lists of one length) of all lines that the lemma has too, or of those alone whose text differs.

    Lines of unequal length are aligned by the words that they begin and end with alike: blanks stand in
    the shorter one before the common end, so that a word that is missing or added is paired with nothing.
    """
    # words are cut once a pair has met: texts are less to move than lists
    lines = line_pairs(spark, d, equal).select("ab_id", "witness", C.tokens(F.col("l")).alias("lt"), C.tokens(F.col("text")).alias("wt"))

    def alike(a: Column, b: Column, most: Column) -> Column:
        """How many words both begin with, ``most`` at most."""
        other = F.transform(F.slice(a, F.lit(1), most), lambda x, i: x != F.get(b, i))
        return F.when(F.array_contains(other, True), F.array_position(other, True) - 1).otherwise(most).cast("int")

    n, m = F.size("lt"), F.size("wt")
    same = n == m  # nothing is to be filled in
    lines = lines.withColumn("p", F.when(same, n).otherwise(alike(F.col("lt"), F.col("wt"), F.least(n, m))))
    lines = lines.withColumn("s", F.when(same, 0).otherwise(alike(F.reverse("lt"), F.reverse("wt"), F.least(n, m) - F.col("p"))))

    def filled(c: str, size: Column, other: Column) -> Column:
        blanks = F.array_repeat(F.lit(""), F.greatest(F.lit(0), other - size))
        uneven = F.concat(F.slice(c, F.lit(1), size - F.col("s")), blanks, F.slice(c, size - F.col("s") + 1, F.col("s")))
        return F.when(n == m, F.col(c)).otherwise(uneven)

    # as one generated row, else the lists are filled in again for each of their words
    both = F.inline(F.array(F.struct(filled("lt", n, m).alias("lt"), filled("wt", m, n).alias("wt"))))
    return lines.select("ab_id", "witness", both)


def token_pairs(spark: SparkSession, d: str, equal: bool = True) -> DataFrame:
    """``ab_id, witness, n, pos, lem, rdg, before, after``: the words of :func:`token_lines` side by side."""
    pairs = token_lines(spark, d, equal).select("ab_id", "witness", "lt", F.posexplode("wt").alias("pos", "rdg"))
    at = lambda i: F.get(F.col("lt"), i)
    p = F.col("pos")
    return pairs.select("ab_id", "witness", F.size("lt").alias("n"), "pos", at(p).alias("lem"), "rdg", at(p - 1).alias("before"), at(p + 1).alias("after"))


def differing_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Distinct differing (lem, rdg) in lower case."""
    return token_pairs(spark, d, False).select(F.lower("lem").alias("lem"), F.lower("rdg").alias("rdg")).where("lem <> rdg").distinct()


SQL_WITNESSES = r"""
docs AS (SELECT doc_id, text, array_to_string(string_split(regexp_replace(lower(text), '\s+', ' ', 'g'), ' ')[1:12], ' ') AS k FROM documents),
clusters AS (SELECT k, min(doc_id) AS lemma, count(*) AS n FROM docs GROUP BY k HAVING count(*) > 1),
cut AS (SELECT lemma, doc_id, string_split(text, chr(10)) AS ls FROM docs JOIN clusters USING (k)),
lines AS (SELECT lemma, doc_id, unnest(range(len(ls))) AS line, unnest(ls) AS text FROM cut),
segs AS (SELECT lemma || '_' || line AS ab_id, lemma, doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS toks FROM lines WHERE trim(text) <> ''),
lem AS (SELECT * FROM segs WHERE doc_id = lemma),
wit AS (SELECT * FROM segs WHERE doc_id <> lemma),
both_ AS (SELECT w.ab_id, CAST(w.doc_id AS VARCHAR) AS witness, l.toks AS l, w.toks AS w, least(len(l.toks), len(w.toks)) AS k FROM wit w JOIN lem l USING (ab_id)),
begun AS (SELECT *, coalesce(nullif(list_position(list_transform(range(1, k + 1), lambda i: l[i] <> w[i]), true), 0), k + 1) - 1 AS p FROM both_),
ended AS (SELECT *, coalesce(nullif(list_position(list_transform(range(1, k - p + 1), lambda i: l[len(l) + 1 - i] <> w[len(w) + 1 - i]), true), 0), k - p + 1) - 1 AS s FROM begun),
same AS (SELECT ab_id, witness, list_concat(list_concat(l[1:len(l) - s], list_transform(range(greatest(0, len(w) - len(l))), lambda x: '')), l[len(l) - s + 1:]) AS lt,
  list_concat(list_concat(w[1:len(w) - s], list_transform(range(greatest(0, len(l) - len(w))), lambda x: '')), w[len(w) - s + 1:]) AS wt FROM ended),
pairs AS (
  SELECT ab_id, witness, len(lt) AS n, p AS pos, lt[p + 1] AS lem, wt[p + 1] AS rdg, CASE WHEN p > 0 THEN lt[p] END AS before, CASE WHEN p + 1 < len(lt) THEN lt[p + 2] END AS after
  FROM (SELECT *, unnest(range(len(lt))) AS p FROM same)),
diffs AS (SELECT DISTINCT lower(lem) AS lem, lower(rdg) AS rdg FROM pairs WHERE lower(lem) <> lower(rdg))
"""


def with_(select: str) -> str:
    return f"WITH {SQL_WITNESSES} {select}"


def sql_form(c: str) -> str:
    return f"translate(lower(trim({c}, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))), '※⁛', '')"


def sql_core(c: str) -> str:
    return rf"regexp_replace(lower(trim({c})), '\.$', '')"


def sql_families(a: str, b: str) -> str:
    return "(" + " OR ".join(f"regexp_replace({a}, '{p}', '#', 'g') = regexp_replace({b}, '{p}', '#', 'g')" for p in PATTERNS) + ")"


def sql_solid(c: str) -> str:
    return f"length(replace(replace({c}, '.', ''), ' ', ''))"


_L, _R = sql_form("lem"), sql_form("rdg")
SQL_EARLY = f"""CASE WHEN trim(rdg) = '' THEN 'missing' WHEN {_L} = {_R} THEN 'trivial'
  WHEN strpos({sql_core('rdg')}, '.') = 0 AND ((coalesce({sql_core('after')}, '') <> '' AND {sql_core('lem')} || {sql_core('after')} = {sql_core('rdg')})
    OR (coalesce({sql_core('before')}, '') <> '' AND {sql_core('before')} || {sql_core('lem')} = {sql_core('rdg')})) THEN 'trivial'
  WHEN {sql_families(_L, _R)} THEN 'trivial'
  WHEN ({sql_solid(_L)} > 0 AND {sql_solid(_R)} / {sql_solid(_L)} < 0.6) OR {sql_solid(_R)} > {sql_solid(_L)} * 1.5 THEN 'meaningful' END"""


# -- ladder --------------------------------------------------------------------------------------------


@query("type_summary", with_(f"""
SELECT type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct
FROM (SELECT coalesce({SQL_EARLY}, 'trivial') AS type FROM pairs) GROUP BY type"""))  # fmt: skip
def type_summary(spark, d):
    return ladder.type_summary(token_pairs(spark, d).select(F.coalesce(ladder.early(FAMILIES), F.lit("trivial")).alias("type")))


@query("ladder_early", with_(f"SELECT ab_id, witness, pos, {SQL_EARLY} AS type FROM pairs WHERE lem <> rdg"))
def ladder_early(spark, d):
    return token_pairs(spark, d, False).where("lem <> rdg").select("ab_id", "witness", "pos", ladder.early(FAMILIES).alias("type"))


@query("spacing_merge", r"""
WITH t AS (SELECT conv_id, turn, role, lag(role) OVER w AS before, lead(role) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, coalesce(before, '') || role || '.' AS rdg,
  coalesce(after, '') <> '' AND role || after = coalesce(before, '') || role OR coalesce(before, '') <> '' AS fused FROM t""")  # fmt: skip
def spacing_merge(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, d, "conversations").withColumns({"before": F.lag("role").over(w), "after": F.lead("role").over(w)})
    rdg = F.concat(F.coalesce("before", F.lit("")), F.col("role"), F.lit("."))
    return t.select("conv_id", "turn", rdg.alias("rdg"), ladder.spacing_merge(F.col("role"), rdg, F.col("before"), F.col("after")).alias("fused"))


_OPS_SQL = []
for _long, _short, _verb, _less in (("lem", "rdg", "deleted", "length(rdg) < length(lem)"), ("rdg", "lem", "inserted", "length(rdg) > length(lem)")):
    for _c in "həa":
        _OPS_SQL.append(f"CASE WHEN {_less} AND replace({_long}, '{_c}', '') = {_short} THEN '{_c} {_verb}' END")
_SWAP_SQL = [f"CASE WHEN contains(lem, '{a}') AND contains(rdg, '{b}') AND replace(lem, '{a}', '{b}') = rdg THEN '{a}→{b}' END" for a, b in C.SWAPS]
SQL_OPS = f"list_filter([coalesce({', '.join(_OPS_SQL)}), coalesce({', '.join(_SWAP_SQL)})], lambda x: x IS NOT NULL)"
#: pairs that show every kind of simple operation, made from words of the part table
SQL_MADE = """made AS (
  SELECT DISTINCT p_size, p_type AS lem, CASE p_size % 7 WHEN 0 THEN replace(p_type, 'a', '') WHEN 1 THEN replace(p_type, 'i', 'e') WHEN 2 THEN 'h' || p_type
    WHEN 3 THEN p_type || 'a' WHEN 4 THEN replace(p_type, 'e', 'i') WHEN 5 THEN replace(p_type, 's', 'z') ELSE p_type END AS rdg
  FROM (SELECT p_size, lower(p_type) AS p_type FROM part))"""


def made_pairs(spark: SparkSession, d: str) -> DataFrame:
    t, n = F.lower("p_type"), F.col("p_size") % 7
    rdg = (
        F.when(n == 0, F.replace(t, F.lit("a"), F.lit(""))).when(n == 1, F.replace(t, F.lit("i"), F.lit("e"))).when(n == 2, F.concat(F.lit("h"), t))
        .when(n == 3, F.concat(t, F.lit("a"))).when(n == 4, F.replace(t, F.lit("e"), F.lit("i"))).when(n == 5, F.replace(t, F.lit("s"), F.lit("z"))).otherwise(t)
    )
    return table(spark, d, "part").select("p_size", t.alias("lem"), rdg.alias("rdg")).distinct()


@query("atomic_ops_simple", f"WITH {SQL_MADE} SELECT p_size, lem, rdg, CASE WHEN lem = rdg THEN '' ELSE array_to_string({SQL_OPS}, ';') END AS ops FROM made")
def atomic_ops_simple(spark, d):
    return made_pairs(spark, d).withColumn("ops", F.array_join(C.simple_ops(F.col("lem"), F.col("rdg")), ";"))


_GROUPS = {0: ["EUROPE"], 1: ["ASIA"], 2: ["EUROPE", "ASIA"], 3: []}
_SQL_GROUPS = "CASE p_size % 4 WHEN 0 THEN ['EUROPE'] WHEN 1 THEN ['ASIA'] WHEN 2 THEN ['EUROPE', 'ASIA'] ELSE [] END"


def _sql_rules(grouped: bool) -> str:
    out = []
    for r in RULES:
        hit = f"list_contains(ops, '{r['pattern']}')" if r["kind"] == "match" else f"len(list_filter(ops, lambda x: regexp_matches(x, '{r['pattern']}'))) > 0"
        if grouped and r["groups"]:
            hit += f" AND list_has_any(grps, {r['groups']})"
        if grouped and r["exclude_groups"]:
            hit += f" AND NOT list_has_any(grps, {r['exclude_groups']})"
        out.append(f"WHEN {hit} THEN '{r['label']}'")
    return "CASE " + " ".join(out) + " END"


_SQL_RULED = f"WITH {SQL_MADE}, o AS (SELECT p_size, lem, rdg, CASE WHEN lem = rdg THEN CAST([] AS VARCHAR[]) ELSE {SQL_OPS} END AS ops, {_SQL_GROUPS} AS grps FROM made) "


@query("rule_first_match", _SQL_RULED + f"SELECT p_size, lem, rdg, {_sql_rules(False)} AS label FROM o")
def rule_first_match(spark, d):
    ops = C.simple_ops(F.col("lem"), F.col("rdg"))
    return made_pairs(spark, d).withColumn("ops", ops).withColumn("label", ladder.rule_label(F.col("ops"), RULES)).drop("ops")


@query("rule_group_match", _SQL_RULED + f"SELECT p_size, lem, rdg, {_sql_rules(True)} AS label FROM o")
def rule_group_match(spark, d):
    groups = F.lit(None).cast("array<string>")
    for k, v in _GROUPS.items():
        groups = F.when(F.col("p_size") % 4 == k, F.array(*map(F.lit, v)).cast("array<string>")).otherwise(groups)
    rows = made_pairs(spark, d).withColumns({"ops": C.simple_ops(F.col("lem"), F.col("rdg")), "grps": groups})
    return rows.withColumn("label", ladder.rule_label(F.col("ops"), RULES, F.col("grps"))).drop("ops", "grps")


@query("family_equal_pairs", f"WITH {SQL_MADE} SELECT p_size, lem, rdg, {sql_families('lem', 'rdg')} AS equal FROM made")
def family_equal_pairs(spark, d):
    return made_pairs(spark, d).withColumn("equal", C.families_equal(F.col("lem"), F.col("rdg"), PATTERNS))


def _sql_neutral() -> str:
    c, first = "x", []
    for f in FAMILIES:
        hits = []
        for p in (*f["patterns"], *f["compare_only"]):
            hits.append(f"regexp_matches({c}, '(?i){p}')")
            c = f"regexp_replace({c}, '(?i){p}', '§', 'g')"
        first.append(f"WHEN {' OR '.join(hits)} THEN '{f['family']}'")
    return f"CASE {' '.join(first)} ELSE '' END AS family, md5({c}) AS neutral"


@query("family_normalize", f"SELECT doc_id, {_sql_neutral()} FROM (SELECT doc_id, text AS x FROM documents)")
def family_normalize(spark, d):
    _, family, neutral = C.families_normal(F.col("text"), FAMILIES)
    return table(spark, d, "documents").select("doc_id", family.alias("family"), F.md5(neutral).alias("neutral"))


# -- normal forms and tokens ---------------------------------------------------------------------------

_SQL_LETTERS = C.DOT_LETTERS
_BARE = r"trim(regexp_replace(translate(text, '.,;:·⸳', ''), '\s+', ' ', 'g'))"


@query("normal_forms", rf"""
SELECT doc_id, md5({sql_form('text')}) AS ladder_form, md5({_BARE}) AS bare, md5(replace({_BARE}, ' ', '')) AS solid,
  md5(lower(translate(text, '.,;:·⸳ ', ''))) AS token_key, md5(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '\.+$', '')) AS plain,
  md5(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '[.,;:·⸳]+$', '')) AS no_final,
  md5(regexp_replace(regexp_replace(text, '([{_SQL_LETTERS}]{{1,2}})\.([{_SQL_LETTERS}])', '\1. \2', 'g'), '(^|\s)([{_SQL_LETTERS}]{{1,2}})\.\s+([{_SQL_LETTERS}])', '\1\2.\3', 'g')) AS dots
FROM documents""")  # fmt: skip
def normal_forms(spark, d):
    t = F.col("text")
    forms = {
        "ladder_form": C.ladder_form(t), "bare": C.bare(t), "solid": C.compare_no_space(t), "token_key": C.token_key(t), "plain": C.plain(t),
        "no_final": C.strip_final_punct(t), "dots": C.canonical_dots(t),
    }
    return table(spark, d, "documents").select("doc_id", *[F.md5(c).alias(n) for n, c in forms.items()])


def _sql_skeleton(c: str) -> str:
    c = rf"regexp_replace({c}, '[ą̇aeoāąēōūīəə̄ēyẏ\d]', '', 'g')"
    c = f"regexp_replace(regexp_replace({c}, '([^u])u([^u])', '\\1\\2', 'g'), '([^i])i([^i])', '\\1\\2', 'g')"
    for to, those in C.MERGED:
        for one in those:
            c = f"replace({c}, '{one}', '{to}')"
    return c


@query("skeletons", f"SELECT DISTINCT p_name, {_sql_skeleton('lower(p_name)')} AS skeleton, translate(lower(p_name), '{C.VOWELS}', '') AS by_vowels FROM part")
def skeletons(spark, d):
    n = F.lower("p_name")
    return table(spark, d, "part").select("p_name", C.skeleton(n).alias("skeleton"), C.skeleton_by_vowels(n).alias("by_vowels")).distinct()


@query("token_counts", r"""
SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n_tokens,
  len(list_filter(list_transform(regexp_extract_all(text, '[^\s<>]+'), lambda t: trim(t, ',;:"()[]{}«»—–')), lambda x: x <> '')) AS n_edge,
  len(list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda t: translate(t, '.,;:·⸳', '')), lambda x: x <> '')) AS n_compared,
  len(list_filter(regexp_split_to_array(text, '\s+'), lambda t: regexp_matches(t, '[A-Z0-9]|[-'']') AND len(regexp_extract_all(lower(t), '[a-zāąēīōūẏŋšṣḥδθṯṙṝ]')) <= 1)) AS n_foreign
FROM documents""")  # fmt: skip
def token_counts(spark, d):
    t = F.col("text")
    size = lambda c: F.size(c).cast("long")
    return table(spark, d, "documents").select(
        "doc_id", size(C.tokens(t)).alias("n_tokens"), size(C.edge_stripped(t)).alias("n_edge"), size(C.compared_tokens(t)).alias("n_compared"),
        size(F.filter(C.tokens(t), C.is_foreign)).alias("n_foreign"),
    )


_GRAPHEME_SQL = "|".join(sorted(C.GRAPHEMES, key=len, reverse=True))


@query("grapheme_counts", rf"SELECT doc_id, len(regexp_extract_all(trim(regexp_replace(text, '\s+', ' ', 'g')), '({_GRAPHEME_SQL}|(?s:.))')) AS n FROM documents")
def grapheme_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(C.graphemes(F.col("text"))).cast("long").alias("n"))


@query("dot_segments", r"""
SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(t, '[^.]*\.+|[^.]+$')) AS s FROM (
  SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS t FROM documents)) WHERE s <> '' GROUP BY doc_id""")  # fmt: skip
def dot_segments(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(C.dot_segments(F.col("text"))).cast("long").alias("n")).where("n > 0")


@query("canonical_features", r"""
SELECT DISTINCT p_brand || ' for ' || p_type AS feature, p_brand || '→' || p_type AS canon, '#ms' || lpad(CAST(p_size AS VARCHAR), 4, '0') || ' #ms0007 #msXY' AS wits,
  '#ms' || lpad(CAST(p_size AS VARCHAR), 4, '0') AS ms FROM part""")  # fmt: skip
def canonical_features(spark, d):
    f = F.concat("p_brand", F.lit(" for "), "p_type")
    size = F.col("p_size").cast("string")
    return table(spark, d, "part").select(
        f.alias("feature"), C.canonical_feature(f).alias("canon"), C.witness_list(F.concat(size, F.lit(", #ms7,XY"))).alias("wits"),
        C.manuscript_id(F.concat(F.lit("dir/"), size, F.lit(".xml"))).alias("ms"),
    ).distinct()


@query("index_lists", r"""
SELECT l_orderkey, l_linenumber, array_to_string(CASE WHEN l_partkey = l_suppkey THEN [l_partkey] ELSE [l_partkey, l_suppkey] END, '|') AS ids FROM lineitem""")
def index_lists(spark, d):
    text = F.concat(F.lit("["), "l_partkey", F.lit(";"), "l_suppkey", F.lit(", x,"), "l_partkey", F.lit("]"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(C.index_list(text).cast("array<string>"), "|").alias("ids"))


# -- measures ------------------------------------------------------------------------------------------

def _ascii(c: str) -> str:
    """Letters beyond ASCII as capitals: DuckDB counts edits in bytes."""
    return f"translate({c}, 'äöüßéèêçñíóáúàâîôûëïùœæ', 'ABCDEFGHIJKLMNOPQRSTUVW')"


_SQL_GRAMS = "list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)))"
_GA, _GB = _SQL_GRAMS.format("lem"), _SQL_GRAMS.format("rdg")
_BOTH = f"len(list_intersect({_GA}, {_GB}))"
_EITHER = f"len(list_distinct(list_concat({_GA}, {_GB})))"


@query("pair_measures", with_(f"""
SELECT lem, rdg, levenshtein({_ascii('lem')}, {_ascii('rdg')}) AS edits, lem <> '' AND rdg <> '' AND levenshtein({_ascii(_sql_skeleton('lem'))}, {_ascii(_sql_skeleton('rdg'))}) <= 1 AS same_word,
  round(CASE WHEN lem = '' OR rdg = '' OR {_EITHER} = 0 THEN CASE WHEN lem = rdg THEN 1.0 ELSE 0.0 END ELSE {_BOTH} / {_EITHER} END, 6) AS jaccard,
  {sql_solid('lem')} > 0 AND {sql_solid('rdg')} / {sql_solid('lem')} < 0.6 AS short, {sql_solid('rdg')} > {sql_solid('lem')} * 1.5 AS long,
  (contains(lem, rdg) OR contains(rdg, lem)) AND abs(length(lem) - length(rdg)) <= 2 AS inside
FROM diffs"""))  # fmt: skip
def pair_measures(spark, d):
    a, b = F.col("lem"), F.col("rdg")
    return differing_pairs(spark, d).select(
        "lem", "rdg", F.levenshtein("lem", "rdg").cast("long").alias("edits"), C.skeletons_match(a, b).alias("same_word"),
        F.round(C.bigram_jaccard(a, b), 6).alias("jaccard"), C.too_short(a, b).alias("short"), C.too_long(a, b).alias("long"),
        C.contains_closely(a, b).alias("inside"),
    )


# -- segments, spans, relations ------------------------------------------------------------------------


@query("segment_join", with_("SELECT l.ab_id, count(*) AS witnesses, sum(len(w.toks)) AS tokens FROM lem l JOIN wit w USING (ab_id) GROUP BY l.ab_id"))
def segment_join(spark, d):
    lemma, wits = collation(spark, d)
    rows = lemma.select("ab_id").join(wits, "ab_id").withColumn("n", F.size(C.tokens(F.col("text"))))
    return rows.groupBy("ab_id").agg(F.count(F.lit(1)).alias("witnesses"), F.sum("n").alias("tokens"))


@query("witness_priority_lookup", r"""
WITH e AS (SELECT p_brand AS witness, CASE p_size % 5 WHEN 0 THEN 'xml:id' WHEN 1 THEN 'id' WHEN 2 THEN 'n' WHEN 3 THEN 'corresp' ELSE 'ab' END AS kind, p_type AS key,
    p_partkey AS place, p_name || p_partkey AS text FROM part),
  ids AS (SELECT DISTINCT split_part(p_type, ' ', 1) AS ab_id FROM part UNION SELECT DISTINCT p_type FROM part),
  asked AS (SELECT witness, ab_id, CASE WHEN ab_id = 'x' THEN 'y' ELSE ab_id END AS lookup_id FROM (SELECT DISTINCT witness FROM e), ids),
  found AS (SELECT a.witness, a.ab_id, CASE kind WHEN 'xml:id' THEN 0 WHEN 'id' THEN 1 WHEN 'ab' THEN 3 ELSE 2 END AS rank, place, text FROM asked a JOIN e
    ON a.witness = e.witness AND ((kind <> 'ab' AND key = lookup_id) OR (kind = 'ab' AND contains(key, lookup_id))))
SELECT witness, ab_id, arg_min(text, rank * 1000000000::BIGINT + place) AS text FROM found GROUP BY witness, ab_id""")  # fmt: skip
def witness_priority_lookup(spark, d):
    p = table(spark, d, "part")
    n = F.col("p_size") % 5
    kind = F.when(n == 0, "xml:id").when(n == 1, "id").when(n == 2, "n").when(n == 3, "corresp").otherwise("ab")
    e = p.select(F.col("p_brand").alias("witness"), kind.alias("kind"), F.col("p_type").alias("key"), F.col("p_partkey").alias("place"), F.concat("p_name", "p_partkey").alias("text"))
    ids = p.select(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("ab_id")).union(p.select("p_type"))
    return segments.witness_segments(e, ids)


@query("variant_ranges", with_(r"""
SELECT ab_id, min(pos) AS a, max(pos) + 1 AS b FROM (SELECT ab_id, pos, pos - row_number() OVER (PARTITION BY ab_id ORDER BY pos) AS run
  FROM (SELECT DISTINCT ab_id, pos FROM pairs WHERE lem <> rdg)) GROUP BY ab_id, run"""))  # fmt: skip
def variant_ranges(spark, d):
    return segments.islands(token_pairs(spark, d, False).where("lem <> rdg").select("ab_id", F.col("pos").cast("long").alias("pos")), ["ab_id"])


def _work(spark, d) -> tuple[DataFrame, DataFrame]:
    lemma, wits = collation(spark, d)
    return written(apparatus.aligned(lemma, wits)), wits


@query("align_dp_spans")
def align_dp_spans(spark, d):
    work, _ = _work(spark, d)
    return apparatus.entry_spans(work).withColumn("width", F.col("b") - F.col("a"))


def _readings(spark, d) -> DataFrame:
    """Readings of the witnesses that have the segment; a grid over all witnesses of all texts would be empty nearly everywhere."""
    work, _ = _work(spark, d)
    spans = apparatus.entry_spans(work)
    # a segment's spans are no more than a few for each of its tokens; readings are cut out in its cell, so its lists aren't repeated for every span
    spans = spans.groupBy("ab_id").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    cells = work.select("ab_id", "witness", "lt", "wt", "cover").join(spans, "ab_id")
    part = lambda c, s: F.slice(c, s["a"] + 1, s["b"] - s["a"])
    at = lambda s: F.array_sort(F.array_distinct(F.flatten(part("cover", s))))
    rdg = lambda s: F.array_join(F.transform(at(s), lambda i: F.get(F.col("wt"), i)), " ")
    cut = F.transform("spans", lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), F.array_join(part("lt", s), " ").alias("lem"), rdg(s).alias("rdg")))
    rows = cells.select("ab_id", "witness", F.inline(cut))
    return rows.select(F.concat_ws("-", F.lit("app"), "ab_id", "a", "b").alias("app_id"), "ab_id", "a", "b", "lem", "witness", "rdg")


@query("readings_grouped")
def readings_grouped(spark, d):
    return apparatus.grouped_readings(_readings(spark, d))


@query("apparatus_types")
def apparatus_types(spark, d):
    # lines are segments of their lemma: neighbours may stand in the line before or behind
    line = F.split("ab_id", "_")
    rows = _readings(spark, d).withColumns({"lemma": line[0].cast("long"), "line": line[1].cast("int")})
    rows = ladder.with_neighbours(written(rows), ["lemma"], ["line", "a", "b"])
    return ladder.classify(rows, RULES, FAMILIES).select("app_id", "witness", "lem", "rdg", "before", "after", "type")


def _stanzas(spark, d) -> DataFrame:
    words = lambda c: F.transform(C.edge_stripped(F.col(c)), C.stanza_token)
    # as one generated row, else the words are cut a second time to see whether they differ
    both = F.inline(F.array(F.struct(words("l").alias("canon"), words("text").alias("our"))))
    return line_pairs(spark, d, False).select(F.concat_ws("@", "ab_id", "witness").alias("xml_id"), both).where("canon <> our")


@query("align_greedy")
def align_greedy(spark, d):
    m = relations.greedy_matches(_stanzas(spark, d)).select("xml_id", F.posexplode("matches").alias("k", "m"))
    return m.select("xml_id", "k", "m.*")


@query("align_nw_groups")
def align_nw_groups(spark, d):
    return relations.exported_groups(relations.dp_groups(_stanzas(spark, d)))


@query("dp_gate")
def dp_gate(spark, d):
    return relations.gate(relations.greedy_matches(_stanzas(spark, d))).drop("triggers")


@query("chosen_alignment")
def chosen_alignment(spark, d):
    return collate.chosen_alignment(_stanzas(spark, d)).select("xml_id", "our_index", "greedy_relation", "dp_relation", "final_choice", "final_relation", "final_canon_indexes")


_SQL_G = "CASE l_returnflag WHEN 'A' THEN 'equal' WHEN 'R' THEN 'substitution' ELSE '' END"
_SQL_D = "CASE WHEN l_linestatus = 'O' THEN 'equal' WHEN l_returnflag = 'N' THEN '' ELSE 'many-to-one' END"


def _lines(spark, d) -> DataFrame:
    flag = F.col("l_returnflag")
    return table(spark, d, "lineitem").withColumns({
        "g": F.when(flag == "A", "equal").when(flag == "R", "substitution").otherwise(""),
        "dp": F.when(F.col("l_linestatus") == "O", "equal").when(flag == "N", "").otherwise("many-to-one"),
    })


@query("decide_final", f"""
SELECT l_orderkey, l_linenumber, CASE WHEN {_SQL_D} <> '' AND {_SQL_D} = {_SQL_G} THEN 'both' WHEN {_SQL_D} <> '' THEN 'dp' WHEN {_SQL_G} <> '' THEN 'greedy' ELSE 'none' END AS choice
FROM lineitem""")  # fmt: skip
def decide_final(spark, d):
    return _lines(spark, d).select("l_orderkey", "l_linenumber", relations.decide_final(F.col("g"), F.col("dp")).alias("choice"))


@query("alignment_validation", f"""
WITH r AS (SELECT l_quantity, {_SQL_G} AS g, {_SQL_D} AS dp FROM lineitem),
  c AS (SELECT *, CASE WHEN dp <> '' AND dp = g THEN 'both' WHEN dp <> '' THEN 'dp' WHEN g <> '' THEN 'greedy' ELSE 'none' END AS final_choice FROM r)
SELECT final_choice, count(*) AS n, count(*) FILTER (l_quantity > 25) AS covered, count(*) FILTER (g <> dp) AS disagree,
  count(*) FILTER (CASE WHEN final_choice IN ('dp', 'both') THEN dp ELSE g END = 'unmatched') AS unmatched FROM c GROUP BY final_choice""")  # fmt: skip
def alignment_validation(spark, d):
    rows = _lines(spark, d).withColumn("final_choice", relations.decide_final(F.col("g"), F.col("dp")))
    by_dp = F.col("final_choice").isin("dp", "both")
    return relations.validation(rows.select(
        "final_choice", F.col("g").alias("greedy_relation"), F.col("dp").alias("dp_relation"), F.when(by_dp, F.col("dp")).otherwise(F.col("g")).alias("final_relation"),
        F.when(F.col("l_quantity") > 25, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("final_canon_indexes"),
    ))


@query("relation_label", with_(r"""
SELECT ab_id, witness, pos, CASE WHEN pos % 5 = 0 THEN 'unmatched' WHEN pos % 7 = 0 AND pos + 1 < n THEN 'many-to-one' WHEN lower(trim(lem)) = lower(trim(rdg)) THEN 'equal' ELSE 'substitution' END AS relation
FROM pairs"""))  # fmt: skip
def relation_label(spark, d):
    rows = token_pairs(spark, d)
    at = F.when(F.col("pos") % 5 == 0, F.array().cast("array<int>")).when((F.col("pos") % 7 == 0) & (F.col("pos") + 1 < F.col("n")), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("at", at).select("ab_id", "witness", "pos", relations.relation(F.col("at"), F.array("lem"), F.col("rdg")).alias("relation"))


@query("greedy_runs", r"""
SELECT l_orderkey, our_index, min(canon_index) AS a, max(canon_index) AS b FROM (
  SELECT l_orderkey, canon_index, our_index, canon_index - row_number() OVER (PARTITION BY l_orderkey, our_index ORDER BY canon_index) AS run FROM (
    SELECT DISTINCT l_orderkey, l_linenumber AS canon_index, CASE WHEN l_quantity > 10 THEN CAST(floor(l_linenumber / 2) AS INT) END AS our_index FROM lineitem) WHERE our_index IS NOT NULL)
GROUP BY l_orderkey, our_index, run""")  # fmt: skip
def greedy_runs(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("canon_index"), F.when(F.col("l_quantity") > 10, F.floor(F.col("l_linenumber") / 2).cast("int")).alias("our_index")
    )
    return relations.runs(rows, ["l_orderkey"])


@query("upsert_last_wins", r"""
WITH r AS (SELECT event_id, user_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS stanza, value FROM events)
SELECT event_id, user_id, stanza, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, stanza ORDER BY event_id DESC) AS n FROM r WHERE stanza IS NOT NULL) WHERE n = 1
UNION ALL SELECT event_id, user_id, stanza, value FROM r WHERE stanza IS NULL""")  # fmt: skip
def upsert_last_wins(spark, d):
    stanza = F.when(F.col("event_id") % 11 != 0, F.col("event_type"))
    rows = table(spark, d, "events").select("event_id", "user_id", stanza.alias("stanza"), "value")
    return relations.upsert(rows, ["user_id", "stanza"], "event_id", "stanza")


# -- joins, windows, counts ----------------------------------------------------------------------------


@query("first_wins_dedupe", """
SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1""")
def first_wins_dedupe(spark, d):
    return tables.first_wins(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("semi_and_anti", """
SELECT l.doc_id, l.toxic, EXISTS (SELECT 1 FROM benchmark b JOIN documents x ON contains(x.text, b.text) WHERE x.doc_id = l.doc_id) AS reused FROM labels l
WHERE l.quality = 1 AND NOT EXISTS (SELECT 1 FROM documents t WHERE t.doc_id = l.doc_id AND t.lang = 'de')""")
def semi_and_anti(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").where("quality = 1")
    kept = labels.join(docs.where("lang = 'de'").select("doc_id"), "doc_id", "left_anti")
    # passages are found by eight words from the second on, so that the join has a key, and then compared whole; the first
    # and the last word may be parts of longer ones in a document, so passages of fewer than ten are looked for without a key
    words = lambda text: F.split(text, r"\s")
    key = lambda w, i: F.array_join(F.slice(w, i, 8), " ")
    b = table(spark, d, "benchmark").select(F.col("text").alias("passage")).withColumn("w", words("passage"))
    long = b.where("size(w) >= 10").select("passage", key("w", 2).alias("key"))
    short = b.where("size(w) < 10").select("passage")
    places = F.when(F.size("w") >= 8, F.sequence(F.lit(1), F.size("w") - 7))
    # ids and keys meet first; only texts that hold a key are looked at whole
    starts = docs.select("doc_id", words("text").alias("w")).select("doc_id", F.explode(F.array_distinct(F.transform(places, lambda i: key(F.col("w"), i)))).alias("key"))
    maybe = starts.join(small(long), "key").select("doc_id", "passage").distinct()
    whole = F.contains("text", F.col("passage"))
    hits = docs.select("doc_id", "text").join(maybe, "doc_id").where(whole).select("doc_id")
    hits = hits.union(docs.join(small(short), whole, "left_semi").select("doc_id")).distinct()
    return kept.join(hits.withColumn("reused", F.lit(True)), "doc_id", "left").select("doc_id", "toxic", F.coalesce("reused", F.lit(False)).alias("reused"))


@query("prev_next_lemma", """
SELECT conv_id, turn, lag(role) OVER w AS before, lead(role) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def prev_next_lemma(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("lem"))
    return ladder.with_neighbours(rows, ["conv_id"], ["turn"]).select("conv_id", "turn", "before", "after")


@query("page_line_breaks", """
WITH t AS (SELECT conv_id, turn, role, lag(role) OVER w AS p FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CASE WHEN p IS DISTINCT FROM role THEN '<pb n="' || role || '"/>' ELSE '' END || '<lb n="' || turn || '"/>' AS marks FROM t""")
def page_line_breaks(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("page"), F.col("turn").alias("line"))
    return sinks.milestones(rows, "conv_id", ["turn"]).select("conv_id", "turn", "marks")


@query("top_unmapped", r"""
SELECT tok, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS tok FROM documents) GROUP BY tok ORDER BY n DESC, tok LIMIT 10""")
def top_unmapped(spark, d):
    return reports.most_common(table(spark, d, "documents").select(F.explode(C.tokens(F.col("text"))).alias("tok")), "tok")


@query("per_file_summary", """
SELECT source, count(*) FILTER (toxic = 1) AS meaningful, count(*) FILTER (toxic = 0 AND quality = 1) AS trivial, count(*) FILTER (toxic = 0 AND quality = 0) AS missing,
  0 AS unknown, count(*) AS readings FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def per_file_summary(spark, d):
    ana = F.when(F.col("toxic") == 1, "#variants").when(F.col("quality") == 1, "#trivial").otherwise("#missing")
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    return reports.label_counts(rows.withColumn("ana", ana), "source").withColumn("unknown", F.col("unknown").cast("int"))


def _features(spark, d) -> DataFrame:
    nation = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return table(spark, d, "lineitem").join(nation, "l_suppkey").select(F.col("s_nationkey").alias("witness"), (F.col("l_partkey") % 500).alias("feature"))


@query("feature_doc_freq", """
SELECT l_partkey % 500 AS feature, count(DISTINCT s_nationkey) AS doc_freq, count(*) AS total_count FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""")
def feature_doc_freq(spark, d):
    return reports.feature_frequencies(_features(spark, d).withColumn("n", F.lit(1)))


@query("witness_distance", """
WITH f AS (SELECT DISTINCT s_nationkey AS w, l_partkey % 500 AS x FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), n AS (SELECT w, count(*) AS n FROM f GROUP BY w),
  k AS (SELECT a.w AS wa, b.w AS wb, count(*) AS k FROM f a JOIN f b USING (x) GROUP BY 1, 2)
SELECT a.w AS wit_a, b.w AS wit_b, round(1 - coalesce(k, 0) / (a.n + b.n - coalesce(k, 0)), 9) AS distance FROM n a CROSS JOIN n b LEFT JOIN k ON wa = a.w AND wb = b.w""")
def witness_distance(spark, d):
    return reports.witness_distances(_features(spark, d)).withColumn("distance", F.round("distance", 9))


# -- scores and curation -------------------------------------------------------------------------------

_SQL_SCORES = """scores AS (SELECT p_partkey, p_type AS feature, CASE WHEN p_size % 3 = 0 THEN 'variant' WHEN p_size % 3 = 1 THEN 'reading' ELSE '' END AS label,
  (p_partkey % 100) / 100.0 AS v, p_size % 6 AS n, p_size % 7 = 0 AS ortho, p_size % 5 = 0 AS punct, p_size % 11 = 0 AS single, p_size % 13 = 0 AS white, p_size % 17 = 0 AS unstable FROM part)"""
_BORDER = "(v >= 0.70 AND v < 0.75) OR unstable OR (ortho AND n >= 3 AND v >= 0.72)"
_STRONG = "(label = 'variant' AND NOT ortho AND NOT punct) OR white OR (v >= 0.75 AND n >= 3)"


def _scores(spark, d) -> DataFrame:
    s = F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey", F.col("p_type").alias("feature"), F.when(s % 3 == 0, "variant").when(s % 3 == 1, "reading").otherwise("").alias("label"),
        (F.col("p_partkey") % 100 / 100.0).alias("variant_likelihood"), (s % 6).alias("doc_freq"), (s % 7 == 0).alias("orthography_match"),
        (s % 5 == 0).alias("punct_penalty_applied"), (s % 11 == 0).alias("singleton_demoted"), (s % 13 == 0).alias("lexical_whitelist_applied"), (s % 17 == 0).alias("unstable"),
    )


@query("score_policies", f"""
WITH {_SQL_SCORES} SELECT p_partkey, CASE WHEN {_BORDER} THEN 'unknown' WHEN {_STRONG} THEN 'meaningful' ELSE 'trivial' END AS a,
  CASE WHEN {_BORDER} THEN 'unknown' WHEN {_STRONG} THEN 'meaningful' WHEN label = 'reading' OR ortho OR punct OR single THEN 'trivial' ELSE 'unknown' END AS b FROM scores""")  # fmt: skip
def score_policies(spark, d):
    return _scores(spark, d).select("p_partkey", cascade.score_policy().alias("a"), cascade.score_policy(True).alias("b"))


@query("override_decide", f"""
WITH {_SQL_SCORES}, k AS (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 'insert' WHEN 1 THEN 'delete' ELSE 'subst' END AS kind, CASE WHEN p_partkey % 2 = 0 THEN 'aō' ELSE 'a' END AS val FROM scores)
SELECT p_partkey, CASE WHEN (label = 'variant' AND n >= 2 AND v >= 0.75 AND NOT punct) OR (kind <> 'subst' AND length(val) >= 2) OR white THEN 'meaningful'
  WHEN label = 'reading' OR ortho OR punct OR single OR (n >= 3 AND v < 0.72) THEN 'trivial' END AS label FROM k""")  # fmt: skip
def override_decide(spark, d):
    k = F.col("p_partkey")
    kind = F.when(k % 3 == 0, "insert").when(k % 3 == 1, "delete").otherwise("subst")
    return _scores(spark, d).select("p_partkey", cascade.override_decision(kind, F.when(k % 2 == 0, "aō").otherwise("a")).alias("label"))


_SQL_CURATED = """cur AS (SELECT doc_id, source AS feature, CAST(doc_id AS VARCHAR) AS app_id, lang AS rdg_text,
  CASE WHEN source IN ('src1', 'src2', 'src3') THEN 'trivial' WHEN toxic = 1 THEN 'meaningful' WHEN quality = 1 THEN 'trivial' ELSE '' END AS lab FROM documents JOIN labels USING (doc_id))"""


def _curated(spark, d) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source", "lang").join(table(spark, d, "labels"), "doc_id")
    lab = F.when(F.col("source").isin("src1", "src2", "src3"), " Trivial").when(F.col("toxic") == 1, "meaningful").when(F.col("quality") == 1, "trivial")
    return rows.select(F.col("source").alias("feature"), F.col("doc_id").cast("string").alias("app_id"), F.col("lang").alias("rdg_text"), lab.alias("curator_label"), "doc_id")


_SQL_AGREED = "agreed AS (SELECT feature, min(lab) AS lab FROM cur WHERE lab <> '' GROUP BY feature HAVING min(lab) = max(lab))"


@query("override_consensus", f"WITH {_SQL_CURATED}, {_SQL_AGREED} SELECT feature, lab AS label_override FROM agreed")
def override_consensus(spark, d):
    return curate.consensus(_curated(spark, d))[0]


@query("override_conflicts", f"""
WITH {_SQL_CURATED}, {_SQL_AGREED} SELECT app_id, rdg_text, lab AS label_override FROM cur WHERE lab <> '' AND NOT EXISTS (SELECT 1 FROM agreed a WHERE a.feature = cur.feature AND a.lab = cur.lab)""")
def override_conflicts(spark, d):
    return curate.consensus(_curated(spark, d))[1]


@query("override_priority_union", f"""
WITH {_SQL_CURATED}, u AS (SELECT feature, lab FROM cur WHERE lab <> '' UNION ALL SELECT DISTINCT source, 'trivial' FROM documents)
SELECT feature, CASE WHEN bool_or(lab = 'meaningful') THEN 'meaningful' ELSE 'trivial' END AS label_override FROM u GROUP BY feature""")  # fmt: skip
def override_priority_union(spark, d):
    new = _curated(spark, d).where("curator_label is not null").select("feature", F.lower(F.trim("curator_label")).alias("label_override"))
    old = table(spark, d, "documents").select(F.col("source").alias("feature"), F.lit("trivial").alias("label_override")).distinct()
    return curate.union_overrides(old, new, ["feature"])


_SQL_UNKNOWN = "unk AS (SELECT o_orderkey, 'app-' || o_orderkey AS app_id, o_orderpriority AS rdg_text, CASE o_orderkey % 5 WHEN 0 THEN 'a→ā' WHEN 1 THEN 'ō for aō' WHEN 2 THEN 's→š' WHEN 3 THEN 'b inserted' ELSE 'aē→ē' END AS feature, (o_orderkey % 100) / 100.0 AS v FROM orders)"
_SQL_ORTHO = "feature IN ('a→ā', 'aē→ē')"


def _unknowns(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    f = F.when(k % 5 == 0, "a→ā").when(k % 5 == 1, "ō for aō").when(k % 5 == 2, "s→š").when(k % 5 == 3, "b inserted").otherwise("aē→ē")
    return table(spark, d, "orders").select(
        "o_orderkey", F.concat(F.lit("app-"), k).alias("app_id"), F.col("o_orderpriority").alias("rdg_text"), f.alias("feature"), (k % 100 / 100.0).alias("variant_likelihood")
    )


@query("triage_bands", f"""
WITH {_SQL_UNKNOWN} SELECT o_orderkey, CASE WHEN v >= 0.73 AND v < 0.75 THEN 'hi' WHEN v >= 0.70 AND v < 0.73 THEN 'mid' ELSE '' END AS band, {_SQL_ORTHO} AS orthography_guess,
  CASE WHEN v >= 0.73 AND v < 0.75 AND NOT {_SQL_ORTHO} THEN 'meaningful?' WHEN {_SQL_ORTHO} THEN 'trivial?' ELSE '' END AS suggestion FROM unk""")  # fmt: skip
def triage_bands(spark, d):
    return curate.triage(_unknowns(spark, d)).select("o_orderkey", "band", "orthography_guess", "suggestion")


_SQL_CAT = "cat AS (SELECT * FROM (VALUES ('a→ā', 0.9, 3, false), ('s→š', 0.8, 1, false), ('b inserted', 0.8, 2, false), ('aē→ē', 0.9, 5, true)) t(f, cv, cn, cp))"


@query("auto_override", f"""
WITH {_SQL_UNKNOWN}, {_SQL_CAT}, j AS (SELECT CASE WHEN feature = 'ō for aō' THEN 'ō→aō' ELSE feature END AS feature, app_id, rdg_text, coalesce(cv, v) AS v, coalesce(cn, 0) AS n, coalesce(cp, false) AS p, {_SQL_ORTHO} AS o
  FROM unk LEFT JOIN cat ON f = CASE WHEN feature = 'ō for aō' THEN 'ō→aō' ELSE feature END)
SELECT feature, app_id, rdg_text, CASE WHEN NOT p AND v >= 0.78 AND n >= 2 THEN 'meaningful' ELSE 'trivial' END AS label_override FROM j WHERE (NOT p AND v >= 0.78 AND n >= 2) OR p OR o""")  # fmt: skip
def auto_override(spark, d):
    cat = spark.createDataFrame(
        [("a→ā", 0.9, 3, False), ("s→š", 0.8, 1, False), ("b inserted", 0.8, 2, False), ("aē→ē", 0.9, 5, True)],
        "feature string, variant_likelihood double, doc_freq int, punct_penalty_applied boolean",
    )
    return curate.auto_overrides(curate.triage(_unknowns(spark, d)), cat)


@query("learn_features", f"WITH {_SQL_UNKNOWN} SELECT feature, count(*) AS doc_freq, round(avg(v), 9) AS variant_likelihood FROM unk WHERE v >= 0.75 GROUP BY feature HAVING count(*) >= 2")
def learn_features(spark, d):
    out = curate.learn_features(_unknowns(spark, d))
    return out.select("feature", "doc_freq", F.round("variant_likelihood", 9).alias("variant_likelihood"))


@query("cascade")
def cascade_query(spark, d):
    rows = token_pairs(spark, d, False).where("lem <> rdg").select(F.concat_ws("-", F.lit("app"), "ab_id", "pos").alias("app_id"), "lem", "rdg", F.concat(F.lit("#"), "witness").alias("wit"))
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    groups = nations.select(F.col("n_nationkey").cast("string").alias("witness"), F.col("r_name").alias("grp"))
    annotator = Annotator(RULES, "", FAMILIES, [], frozenset(["the"]), {}, frozenset(), True)
    return collate.annotated_readings(rows, groups, annotator).select("app_id", "wit", "lem", "rdg", "label", "rule")


@query("snippet_resolution", r"""
WITH e AS (SELECT source AS div_id, 'app-' || doc_id AS app_id, lang AS lem, CAST(doc_id % 40 AS VARCHAR) AS rdg FROM documents),
  s AS (SELECT item_id AS id, 'src' || (item_id % 25) AS locus, CAST(item_id % 50 AS VARCHAR) AS rdg_text, CASE WHEN item_id % 9 = 0 THEN '<app xml:id="app-x' || item_id || '">' ELSE '' END AS stub FROM benchmark),
  c AS (SELECT s.id, list_sort(list(app_id)) AS cs FROM s JOIN e ON s.locus = e.div_id AND e.rdg = s.rdg_text WHERE stub = '' GROUP BY s.id)
SELECT s.id, CASE WHEN stub <> '' THEN 'app-x' || s.id WHEN len(cs) = 1 THEN cs[1] ELSE '' END AS app_id,
  CASE WHEN stub <> '' OR len(cs) = 1 THEN '' WHEN cs IS NULL THEN 'no match in div' ELSE 'ambiguous (rdg_exact)' END AS reason,
  CASE WHEN stub = '' AND len(cs) > 1 THEN array_to_string(cs, ',') ELSE '' END AS candidate_app_ids FROM s LEFT JOIN c ON s.id = c.id""")  # fmt: skip
def snippet_resolution(spark, d):
    doc = table(spark, d, "documents")
    e = doc.select(F.col("source").alias("div_id"), F.concat(F.lit("app-"), "doc_id").alias("app_id"), F.col("lang").alias("lem"), (F.col("doc_id") % 40).cast("string").alias("rdg"))
    i = F.col("item_id")
    stub = F.when(i % 9 == 0, F.concat(F.lit('<app xml:id="app-x'), i, F.lit('">'))).otherwise("")
    s = table(spark, d, "benchmark").select(i.alias("id"), F.concat(F.lit("src"), i % 25).alias("locus"), (i % 50).cast("string").alias("rdg_text"), stub.alias("stub"))
    return curate.resolve_snippets(s, e).select("id", "app_id", "reason", "candidate_app_ids")


# -- sinks and streams ---------------------------------------------------------------------------------


@query("tei_xml", r"""
WITH r AS (SELECT conv_id, turn, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS t, role FROM conversations)
SELECT conv_id AS doc, md5('<app xml:id="app-' || conv_id || '"><lem>' || conv_id || '</lem>' || string_agg('<rdg wit="' || role || turn || '">' || t || '</rdg>', '' ORDER BY role || turn COLLATE C) || '</app>') AS xml
FROM r GROUP BY conv_id""".replace(" COLLATE C", ""))  # fmt: skip
def tei_xml(spark, d):
    rows = table(spark, d, "conversations").select(
        F.col("conv_id").alias("doc"), F.lit(0).alias("ord"), F.concat(F.lit("app-"), "conv_id").alias("app_id"), F.col("conv_id").cast("string").alias("lem"),
        F.concat("role", "turn").alias("wit"), F.col("text").alias("rdg"),
    )
    return sinks.app_xml(rows).select("doc", F.md5("xml").alias("xml"))


@query("taxonomy_and_union", r"""
SELECT source, source || '__app-' || doc_id AS app_id, array_to_string(list_filter(['meaningful', 'trivial', 'missing', 'unknown'], lambda x: NOT list_contains([lang, 'trivial'], x)), ',') AS missing FROM documents""")
def taxonomy_and_union(spark, d):
    rows = table(spark, d, "documents").select("source", F.concat(F.lit("app-"), "doc_id").alias("app_id"), "lang")
    out = sinks.multi_view(rows, "source")
    return out.select("source", "app_id", F.array_join(sinks.taxonomy_additions(F.array("lang", F.lit("trivial"))), ",").alias("missing"))


@query("split_entries", r"""
WITH b AS (SELECT conv_id, turn, 'app-' || conv_id AS app_id, CASE WHEN conv_id % 2 = 0 THEN 'user bot' ELSE 'user' END AS lem,
    CASE turn % 4 WHEN 0 THEN 'user x' WHEN 1 THEN '' WHEN 2 THEN 'y bot' ELSE CASE WHEN conv_id % 3 = 0 THEN 'one two three' ELSE 'user bot' END END AS rdg, 'meaningful' AS type FROM conversations),
  k AS (SELECT app_id, bool_or(rdg <> '' AND len(string_split(rdg, ' ')) <> len(string_split(lem, ' '))) OR max(len(string_split(lem, ' '))) <= 1 AS keep FROM b GROUP BY app_id),
  s AS (SELECT *, unnest(range(len(string_split(lem, ' ')))) AS i FROM b JOIN k USING (app_id) WHERE NOT keep)
SELECT conv_id, turn, app_id, lem, rdg, type FROM b JOIN k USING (app_id) WHERE keep
UNION ALL SELECT conv_id, turn, app_id || '-' || i, string_split(lem, ' ')[i + 1], CASE WHEN rdg = '' THEN '' ELSE string_split(rdg, ' ')[i + 1] END,
  CASE WHEN rdg = '' THEN 'missing' WHEN string_split(rdg, ' ')[i + 1] = string_split(lem, ' ')[i + 1] THEN 'trivial' ELSE type END FROM s""")  # fmt: skip
def split_entries(spark, d):
    c, t = F.col("conv_id"), F.col("turn") % 4
    rdg = F.when(t == 0, "user x").when(t == 1, "").when(t == 2, "y bot").otherwise(F.when(c % 3 == 0, "one two three").otherwise("user bot"))
    rows = table(spark, d, "conversations").select(
        "conv_id", "turn", F.concat(F.lit("app-"), c).alias("app_id"), F.when(c % 2 == 0, "user bot").otherwise("user").alias("lem"), rdg.alias("rdg"), F.lit("meaningful").alias("type")
    )
    return post.split_entries(rows)


@query("trimmed_readings")
def trimmed_readings(spark, d):
    """Each word with its neighbours as the reading, trimmed line by line: a line is one cell, so its words need no shuffle."""
    lt, wt = F.col("lt"), F.col("wt")
    rdgs = F.transform(wt, lambda w, i: F.concat_ws(" ", F.get(lt, i - 1), w, F.get(lt, i + 1)))
    lines = spread(token_lines(spark, d).select("ab_id", "witness", "lt", rdgs.alias("rdgs")), "ab_id", "witness")
    lines = post.trimmed_lines(lines, "lt", "rdgs")
    words = lines.select("ab_id", "witness", F.posexplode(F.arrays_zip("lt", "rdgs")).alias("pos", "x"))
    return words.select("ab_id", "pos", "witness", F.col("x.lt").alias("lem"), F.col("x.rdgs").alias("rdg"))


@query("curation_stream", """
SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 GROUP BY user_id, event_type""")
def curation_stream(spark, d):
    schema = table(spark, d, "events").schema
    edits = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    root = scratch_path(spark, "curation")
    run = curation.follow(edits, f"{root}/state", f"{root}/log", ["user_id", "event_type"], "ts", ["event_id", "value"], interval=None)
    run.awaitTermination()
    schema = "user_id long, event_type string, ts timestamp_ntz, event_id long, value double"
    return curation.latest(spark, f"{root}/state", max(0, run.lastProgress["batchId"]), schema).select("user_id", "event_type", "value", "event_id")


from . import queries_align, queries_documents, queries_features, queries_more  # noqa: E402, F401  they add their queries to those above
