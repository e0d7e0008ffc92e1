"""More queries over the driver's tables: sources on documents made from them, forms, similarity, spans and readings.

XML and text files are made as columns of (path, content) from the tables and go through the
same table functions as files do; CSV and JSON files are written to the shared folder and read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import text as C
from .functions import udfs as U
from .operators import curate, post, segments
from .queries import differing_pairs, query, table, with_
from .session import scratch_path
from .sources import sinks, tables, xml

# -- similarity in SQL ---------------------------------------------------------------------------------


def sql_ratio(pairs: str, name: str = "ratio") -> str:
    """CTEs that end in ``name`` (a, b, s): twice the characters in common blocks, found longest and then leftmost first, by all characters.

    ``pairs`` is a CTE with distinct a, b. The CTEs are recursive.
    """
    code = "list_max(flatten(list_transform(range(al, ah), lambda i: list_transform(list_filter(range(bl, bh), lambda j: substr(a, i + 1, 1) = substr(b, j + 1, 1)), lambda j: "
    code += "list_max(list_filter(range(1, least(ah - i, bh - j) + 1), lambda k: substr(a, i + 1, k) = substr(b, j + 1, k))) * 1000000 + (999 - i) * 1000 + 999 - j))))"
    return f"""
{name}_cut AS (
  SELECT a, b, 0::BIGINT AS al, length(a)::BIGINT AS ah, 0::BIGINT AS bl, length(b)::BIGINT AS bh, 0::BIGINT AS k FROM {pairs} WHERE a <> b AND a <> '' AND b <> ''
  UNION ALL
  SELECT a, b, unnest([al, i + k]), unnest([i, ah]), unnest([bl, j + k]), unnest([j, bh]), unnest([k, 0]) FROM (
    SELECT *, c // 1000000 AS k, 999 - (c // 1000) % 1000 AS i, 999 - c % 1000 AS j FROM (
      SELECT a, b, al, ah, bl, bh, {code} AS c FROM {name}_cut WHERE ah > al AND bh > bl) WHERE c IS NOT NULL)),
{name} AS (
  SELECT p.a, p.b, CASE WHEN p.a = p.b THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * coalesce(m, 0) / (length(p.a) + length(p.b)) END AS s
  FROM {pairs} p LEFT JOIN (SELECT a, b, sum(k) AS m FROM {name}_cut GROUP BY a, b) x ON x.a = p.a AND x.b = p.b)"""


def recursive(sql: str) -> str:
    return "WITH RECURSIVE" + sql.strip().removeprefix("WITH")


def sql_search(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(strip_accents({c})), '[\[\].,;:·⸳]', '', 'g'), '\s+', ' ', 'g'))"


_SPELL = "replace(replace({0}, 'ii', 'ai'), 'ə̄', 'ē')"
_SPELLED = " UNION ".join(f"SELECT {a} AS a, {b} AS b FROM diffs" for a in ("lem", _SPELL.format("lem")) for b in ("rdg", _SPELL.format("rdg")))


@query("gestalt_ratios", recursive(with_(f""", sp AS ({_SPELLED}), {sql_ratio('sp')},
  best AS (SELECT lem, rdg, max(s) AS spelled FROM diffs JOIN ratio ON a IN (lem, {_SPELL.format('lem')}) AND b IN (rdg, {_SPELL.format('rdg')}) GROUP BY lem, rdg)
SELECT lem, rdg, round(r.s, 9) AS s, round(spelled, 9) AS spelled FROM best JOIN ratio r ON r.a = lem AND r.b = rdg""")))  # fmt: skip
def gestalt_ratios(spark, d):
    return differing_pairs(spark, d).select("lem", "rdg", F.round(U.gestalt_ratio("lem", "rdg"), 9).alias("s"), F.round(U.spelling_ratio("lem", "rdg"), 9).alias("spelled"))


@query("fuzzy_equal", recursive(f"""WITH w AS (SELECT DISTINCT lower(p_name) || ' É.' AS x, replace(lower(p_name), 'a', 'ā') AS y FROM part),
  sp AS (SELECT DISTINCT {sql_search('x')} AS a, {sql_search('y')} AS b FROM w), {sql_ratio('sp')}
SELECT x, y, s >= 0.92 AS same FROM w JOIN ratio ON a = {sql_search('x')} AND b = {sql_search('y')}"""))  # fmt: skip
def fuzzy_equal(spark, d):
    n = F.lower("p_name")
    w = table(spark, d, "part").select(F.concat(n, F.lit(" É.")).alias("x"), F.replace(n, F.lit("a"), F.lit("ā")).alias("y")).distinct()
    return w.select("x", "y", U.fuzzy_equal("x", "y").alias("same"))


@query("fuzzy_catalogue", recursive(f"""WITH sp AS (SELECT DISTINCT lower(f.p_brand) AS a, lower(k.p_type) AS b FROM (SELECT DISTINCT p_brand FROM part) f CROSS JOIN (SELECT DISTINCT p_type FROM part) k), {sql_ratio('sp')}
SELECT a AS feature, b AS key, round(s, 9) AS s FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS n FROM ratio WHERE s > 0) WHERE n = 1"""))  # fmt: skip
def fuzzy_catalogue(spark, d):
    p = table(spark, d, "part")
    keys = p.select(F.lower("p_type").alias("key")).distinct()
    return curate.nearest_keys(p.select(F.lower("p_brand").alias("feature")).distinct(), keys, 0.0).withColumn("s", F.round("s", 9))


_KEY = "lower(translate({0}, '.,;:·⸳ ', ''))"


@query("window_trims", recursive(f"""WITH w AS (SELECT DISTINCT p_type AS lem, p_name || ' ' || p_type || ' ' || p_brand AS rdg FROM part),
  t AS (SELECT lem, rdg, string_split(lem, ' ') AS l, string_split(rdg, ' ') AS r FROM w),
  p AS (SELECT lem, rdg, l, r, unnest(range(len(r) - len(l) + 1)) AS pl FROM t WHERE len(l) > 1 AND len(r) > len(l)),
  q AS (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM p), z AS (SELECT lem, rdg, pl, i, l[i] AS x, r[pl + i] AS y, {_KEY.format('l[i]')} AS kx, {_KEY.format('r[pl + i]')} AS ky FROM q),
  sp AS (SELECT DISTINCT kx AS a, ky AS b FROM z), {sql_ratio('sp')},
  fit AS (SELECT lem, rdg, pl, round(sum(CASE WHEN s > 0 THEN greatest(s, 0.05) ELSE 0 END + 0.05), 9) AS f FROM z JOIN ratio ON a = kx AND b = ky GROUP BY lem, rdg, pl),
  best AS (SELECT lem, rdg, pl FROM (SELECT *, row_number() OVER (PARTITION BY lem, rdg ORDER BY f DESC, pl) AS n FROM fit) WHERE n = 1)
SELECT t.lem, array_to_string(CASE WHEN pl IS NULL THEN r ELSE r[pl + 1:pl + len(l)] END, ' ') AS rdg, pl IS NOT NULL AS changed FROM t LEFT JOIN best b ON b.lem = t.lem AND b.rdg = t.rdg"""))  # fmt: skip
def window_trims(spark, d):
    p = table(spark, d, "part")
    return post.trim_windows(p.select(F.col("p_type").alias("lem"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("rdg")).distinct())


# -- forms ---------------------------------------------------------------------------------------------

#: fixed values: signs that compose, in their decomposed spelling
_MARKED = "e\u0301 a\u0304 O\u0308 n\u0303"


@query("unicode_forms", f"""
SELECT DISTINCT p_name, nfc_normalize(t) AS composed, lower(strip_accents(t)) AS base, strip_accents(t) AS unmarked, {sql_search("'[' || t || '].'")} AS searched FROM (SELECT p_name, p_name || ' {_MARKED}' AS t FROM part)""")
def unicode_forms(spark, d):
    t = F.concat("p_name", F.lit(f" {_MARKED}"))
    return table(spark, d, "part").select(
        "p_name", U.nfc(t).alias("composed"), U.base_form(t).alias("base"), U.without_marks(t).alias("unmarked"), U.search_form(F.concat(F.lit("["), t, F.lit("]."))).alias("searched")
    ).distinct()


_SQL_CLASSES = "x"
for _a, _b in C.CLASSES:
    _SQL_CLASSES = f"replace({_SQL_CLASSES}, '{_a}', '{_b}')"
_SQL_CLASSES = rf"regexp_replace({_SQL_CLASSES}, '(^|[^\w])[yY]([aeiou])', '\1\2', 'g')"


@query("compare_forms", f"""
WITH w AS (SELECT DISTINCT p_name, 'yā ' || replace(p_name, 'i', 'ī') || ' yṣ̌aē, you.' AS t FROM part)
SELECT p_name, {_SQL_CLASSES.replace('(x,', '(t,')} AS classes, {_SQL_CLASSES.replace('(x,', "(lower(strip_accents(trim(translate(t, '.,;:·⸳', '')))),")} AS compared FROM w""")
def compare_forms(spark, d):
    t = F.concat(F.lit("yā "), F.replace("p_name", F.lit("i"), F.lit("ī")), F.lit(" yṣ̌aē, you."))
    return table(spark, d, "part").select("p_name", C.phonological(t).alias("classes"), U.compare_form(t).alias("compared")).distinct()


@query("small_forms", r"""
SELECT p_partkey, regexp_replace('..' || p_brand || '.', '^\.+', '') AS builder, printf('%.3f', p_retailprice / 1000) AS cert, CASE WHEN p_size % 2 = 0 THEN '0.500' ELSE printf('%.3f', p_size::DOUBLE) END AS guess,
  replace(p_type, ' ', '.') || '.' AS joined, regexp_replace(regexp_replace(p_name, ' ', '.', 'g') || '.5.', '\.([a-zA-Z])', '. \1', 'g') AS spaced,
  CASE p_size % 4 WHEN 0 THEN 'aē' WHEN 1 THEN 'ī' WHEN 2 THEN 't' ELSE p_brand END AS grapheme, string_split(p_name, ' ')[1:2] = list_slice(string_split(p_name, ' '), 1, 2) AS even,
  len(string_split(p_type, ' ')) - 1 AS windows FROM part""")  # fmt: skip
def small_forms(spark, d):
    n = F.col("p_size")
    words = F.split("p_type", " ")
    rep = F.when(n % 4 == 0, "ae").when(n % 4 == 1, "ii").when(n % 4 == 2, "ϑ").otherwise(F.col("p_brand"))
    runs = C.windows(words, F.lit(2))
    return table(spark, d, "part").select(
        "p_partkey", C.builder_token(F.concat(F.lit(".."), "p_brand", F.lit("."))).alias("builder"), C.certainty((F.col("p_retailprice") / 1000).cast("string")).alias("cert"),
        C.certainty(F.when(n % 2 == 0, "none").otherwise(n.cast("string"))).alias("guess"), C.joined_canon(F.transform(words, lambda w: F.concat(w, F.lit(".")))).alias("joined"),
        C.sentence_space(F.concat(F.replace("p_name", F.lit(" "), F.lit(".")), F.lit(".5."))).alias("spaced"), C.representative(rep).alias("grapheme"),
        F.forall(runs, lambda r: F.size(r) == 2).alias("even"), F.size(runs).cast("long").alias("windows"),
    )


# -- sources -------------------------------------------------------------------------------------------


def _turns(spark, d) -> DataFrame:
    """``conv_id, turn, role`` with the place of a turn in its conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", "role", (F.row_number().over(w) - 1).alias("at"))


def _files(rows: DataFrame, part, head: str, tail: str, name=None) -> DataFrame:
    """One file a conversation of the parts of its turns in order."""
    parts = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", part.alias("x")))).alias("p"))
    body = F.concat(F.lit(head), F.array_join(F.transform("p", lambda x: x["x"]), ""), F.lit(tail))
    return parts.select((name if name is not None else F.concat(F.lit("in/"), "conv_id", F.lit(".xml"))).alias("path"), F.encode(body, "UTF-8").alias("content"))


def _c(*parts) -> F.Column:
    return F.concat(*[p if isinstance(p, F.Column) else F.lit(p) for p in parts])


def _tei(spark, d) -> DataFrame:
    ab = _c('<ab xml:id="A', F.col("conv_id"), ".", F.col("turn"), '" n="n', F.col("turn"), '">', F.col("role"), ' one<lb break="no"/> more<lb/>', F.col("turn"),
            "<note>gone</note><app><rdg type=\"mod\">new</rdg><rdg type=\"orig\">old</rdg></app> <seg>end</seg></ab>")
    return _files(_turns(spark, d), ab, '<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div xml:id="A"><!-- c -->', "</div></body></text></TEI>")


_SQL_AT = "t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pl FROM conversations)"
_SQL_TEXT = "role || ' onemore ' || turn || 'old end'"


@query("lemma_scan", f"WITH {_SQL_AT} SELECT 'in/' || conv_id || '.xml' AS path, 'A' || conv_id || '.' || turn AS ab_id, CAST(4 + 8 * pl AS INT) AS ord, {_SQL_TEXT} AS text FROM t")
def lemma_scan(spark, d):
    return segments.lemma_segments(xml.segments_of(_tei(spark, d)), ["A"])


@query("remapped_witnesses", f"""WITH {_SQL_AT}, w AS (SELECT DISTINCT '#ms' || lpad(CAST(conv_id AS VARCHAR), CAST(greatest(4, length(CAST(conv_id AS VARCHAR))) AS INT), '0') AS witness, conv_id FROM t)
SELECT witness, ab_id, text FROM (
  SELECT witness, 'A' || conv_id || '.' || turn AS ab_id, {_SQL_TEXT} AS text FROM t JOIN w USING (conv_id) WHERE pl = 1
  UNION ALL SELECT witness, 'moved', {_SQL_TEXT} FROM t JOIN w USING (conv_id) WHERE pl = 0
  UNION ALL SELECT witness, 'n' || turn, {_SQL_TEXT} FROM t JOIN w USING (conv_id) WHERE turn = 2)""")  # fmt: skip
def remapped_witnesses(spark, d):
    t = _turns(spark, d)
    ident = _c("A", F.col("conv_id"), ".", F.col("turn"))
    wanted = t.where("at = 1").select(ident.alias("ab_id")).union(spark.createDataFrame([("moved",), ("n2",), ("none here",)], "ab_id string"))
    witness = C.manuscript_id(_c("in/", F.col("conv_id"), ".xml"))
    remap = t.where("at = 0").select(witness.alias("witness"), F.lit("moved").alias("ab_id"), ident.alias("lookup_id"))
    return segments.witness_segments(xml.segments_of(_tei(spark, d)), wanted, remap)


@query("unparsed_files", f"""WITH {_SQL_AT} SELECT DISTINCT 'in/' || conv_id || '.xml' AS path, 'mismatched tag' AS error, 1 AS line FROM t WHERE conv_id % 3 = 0""")
def unparsed_files(spark, d):
    files = _files(_turns(spark, d), _c("<ab>", F.col("turn"), F.when(F.col("conv_id") % 3 == 0, "</a>").otherwise("</ab>")), "<r>", "</r>")
    return xml.unparsed(files).drop("repairs")


@query("stanza_scan", f"""WITH {_SQL_AT}, m AS (SELECT conv_id, max(pl) AS last FROM t GROUP BY conv_id)
SELECT 'in/' || conv_id || '.xml' AS path, 's' || (pl % 3) AS xml_id, 'bbc' || turn || '. ' || role || ' new x. y' AS words
FROM t JOIN m USING (conv_id) WHERE pl + 3 > last""")  # fmt: skip
def stanza_scan(spark, d):
    div = _c('<div xml:id="s', F.col("at") % 3, '"><ab>bbc<lb break="no"/> ', F.col("turn"), '., <app><rdg type="orig">old</rdg><rdg type="mod">', F.col("role"), " new</rdg></app> x.y<supplied>gone</supplied> end ",
             '1-2 </ab><ab xml:lang="pahl">skip</ab><ab n="Nerang 2">skip</ab></div>')
    out = xml.stanzas_of(_files(_turns(spark, d), div, "<r>", "</r>"), True)
    return out.select("path", "xml_id", F.array_join("words", " ").alias("words"))


@query("stanza_join", f"""WITH {_SQL_AT} SELECT a.conv_id || '.' || a.turn AS xml_id, a.role || ' x' AS canon, a.role || ' x y' AS our FROM t a WHERE a.turn % 2 = 0""")
def stanza_join(spark, d):
    t = _turns(spark, d)
    div = lambda words: _c('<div xml:id="', F.col("conv_id"), ".", F.col("turn"), '"><ab>', F.col("role"), f" {words}</ab></div>")
    canon = xml.stanzas_of(_files(t, div("x"), "<r>", "</r>"))
    our = xml.stanzas_of(_files(t.where("turn % 2 = 0"), div("x y"), "<r>", "</r>"))
    return segments.stanza_pairs(canon, our).select("xml_id", F.array_join("canon", " ").alias("canon"), F.array_join("our", " ").alias("our"))


@query("alto_scan", f"""WITH {_SQL_AT}, w AS (SELECT conv_id, pl, unnest([role, 't' || turn, 'x', 'y']) AS word, unnest(range(4)) AS index FROM t)
SELECT conv_id || '.xml' AS page, CAST(pl AS INT) AS line, CAST(index AS INT) AS index, word, CAST(4 * pl + index AS INT) AS seq FROM w""")
def alto_scan(spark, d):
    line = _c('<TextLine><String CONTENT=""/><String CONTENT="', F.col("role"), '"/><SP/><String CONTENT="t', F.col("turn"), '"/><String CONTENT="x.y"/></TextLine>')
    return xml.alto_of(_files(_turns(spark, d), line, "<alto><Layout><Page>", "</Page></Layout></alto>"))


@query("cab_scan", f"""WITH {_SQL_AT}, w AS (SELECT conv_id, pl, turn, unnest(['b' || turn || 'c', role, 'x', 'y']) AS word, unnest(range(4)) AS index FROM t)
SELECT 'in/' || conv_id || '.xml' AS path, 'c' || turn AS id, CAST(index AS INT) AS index, word, CAST(4 * pl + index AS INT) AS seq FROM w""")
def cab_scan(spark, d):
    ab = _c('<ab xml:id="c', F.col("turn"), '">b', F.col("turn"), '<lb break="no"/> c<lb/>', F.col("role"), " x.y</ab><ab>no id</ab>")
    return xml.cab_of(_files(_turns(spark, d), ab, "<r>", "</r>"))


@query("replaced_segments", f"""WITH {_SQL_AT}, w AS (SELECT conv_id, turn, pl, CASE WHEN pl % 2 = 0 THEN ['new', role] ELSE ['b' || turn || 'c', role, 'x', 'y'] END AS ws FROM t)
SELECT 'in/' || conv_id || '.xml' AS path, 'c' || turn AS id, array_to_string(ws, ' ') AS words FROM w""")  # fmt: skip
def replaced_segments(spark, d):
    t = _turns(spark, d)
    ab = _c('<ab xml:id="c', F.col("turn"), '">b', F.col("turn"), '<lb break="no"/> c<lb/>', F.col("role"), " x.y</ab>")
    new = t.where("at % 2 = 0").select(_c("in/", F.col("conv_id"), ".xml").alias("path"), _c("c", F.col("turn")).alias("ab_id"), _c("new ", F.col("role")).alias("text"))
    out = xml.cab_of(sinks.replaced_segments(_files(t, ab, "<r>", "</r>"), new))
    words = F.array_sort(F.collect_list(F.struct("index", "word")))
    return out.groupBy("path", "id").agg(F.array_join(F.transform(words, lambda x: x["word"]), " ").alias("words"))


@query("ocr_round_trip", """
WITH l AS (SELECT conv_id || '/' || turn AS path, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS line FROM conversations),
  w AS (SELECT path, line, list_filter(regexp_split_to_array(replace(text, '.', ' '), '\\s+'), lambda x: x <> '') AS ws FROM l)
SELECT path, CAST(line AS INT) AS line, CAST(unnest(range(len(ws))) AS INT) AS index, unnest(ws) AS word FROM w""")
def ocr_round_trip(spark, d):
    texts = table(spark, d, "conversations").select(_c(F.col("conv_id"), "/", F.col("turn")).alias("path"), F.col("text").alias("value"))
    return xml.ocr_words(sinks.ocr_text(xml.ocr_words(texts)))


def _apparatus_files(spark, d) -> DataFrame:
    t = _turns(spark, d)
    rows = t.select(F.col("conv_id").alias("doc"), F.col("at").alias("ord"), _c("app-", F.col("turn")).alias("app_id"), _c("lem <", F.col("role")).alias("lem"),
                    F.explode(F.array(F.lit("#ms0001"), F.lit("#ms0002"))).alias("wit"))
    rows = rows.withColumn("rdg", F.when(F.col("wit") == "#ms0001", F.col("lem")).otherwise("")).withColumn("type", F.when(F.col("rdg") == "", "missing").otherwise("trivial"))
    apps = sinks.app_xml(rows).select(F.col("doc").alias("conv_id"), F.col("ord").alias("at"), "xml")
    return _files(apps, F.col("xml"), '<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div xml:id="Y9">', "</div></body></text></TEI>")


@query("apparatus_scan", f"""WITH {_SQL_AT}, r AS (SELECT *, unnest(['#ms0001', '#ms0002']) AS wit, unnest([0, 1]) AS k FROM t)
SELECT 'in/' || conv_id || '.xml' AS path, 'Y9' AS div_id, 'app-' || turn AS app_id, CAST(pl AS INT) AS ord, 'lem <' || role AS lem, k AS rdg_ord, wit, CASE WHEN k = 0 THEN 'lem <' || role ELSE '' END AS rdg,
  CASE WHEN k = 0 THEN 'trivial' ELSE 'missing' END AS type FROM r""")  # fmt: skip
def apparatus_scan(spark, d):
    return xml.apparatus_of(_apparatus_files(spark, d)).drop("ana", "cert", "n")


@query("annotated_tei", f"""WITH {_SQL_AT}, r AS (SELECT *, unnest(['#ms0001', '#ms0002']) AS wit FROM t WHERE conv_id % 4 <> 0)
SELECT 'in/' || conv_id || '.xml' AS path, 'app-' || turn AS app_id, wit, CASE WHEN wit = '#ms0002' THEN '#missing' END AS ana, CASE WHEN wit = '#ms0002' THEN '0.000' END AS cert, CASE WHEN wit = '#ms0002' THEN role END AS n FROM r""")
def annotated_tei(spark, d):
    t = _turns(spark, d)
    files = _apparatus_files(spark, d)
    number = F.regexp_extract("path", r"(\d+)\.xml$", 1).cast("long")
    files = files.withColumn("path", F.when(number % 4 == 0, F.replace("path", F.lit(".xml"), F.lit(".v3.xml"))).otherwise(F.col("path")))
    marks = t.select(_c("in/", F.col("conv_id"), ".xml").alias("path"), _c("app-", F.col("turn")).alias("app_id"), F.lit("#ms0002").alias("wit"), F.lit("auto").alias("resp"),
                     F.lit("0.000").alias("cert"), F.lit("#missing").alias("ana"), F.col("role").alias("n"))
    once = sinks.annotated_files(files, marks)
    return xml.apparatus_of(sinks.annotated_files(once, marks)).select("path", "app_id", "wit", "ana", "cert", "n")


@query("multi_view_files", f"""WITH {_SQL_AT} SELECT 'v' || conv_id AS div_id, 'v' || conv_id || '__app-' || turn AS app_id, 'lem <' || role AS lem, pl AS ord FROM t""")
def multi_view_files(spark, d):
    t = _turns(spark, d)
    rows = t.select(F.col("conv_id").alias("doc"), F.col("at").alias("ord"), _c("app-", F.col("turn")).alias("app_id"), _c("lem <", F.col("role")).alias("lem"), F.lit("#ms1").alias("wit"), F.lit("x").alias("rdg"))
    divs = sinks.multi_view_xml(sinks.app_xml(rows).withColumn("stem", _c("v", F.col("doc"))))
    out = xml.apparatus_of(sinks.view_files(divs, 20))
    return out.select("div_id", "app_id", "lem", (F.col("ord") - F.min("ord").over(Window.partitionBy("path", "div_id"))).cast("long").alias("ord"))


_scratch = scratch_path


@query("csv_scores", """
WITH f AS (SELECT 0 AS k, p_brand || ' for x' AS feature, 'variant' AS label, max(p_size) / 100.0 AS v, count(*) AS n, true AS o FROM part WHERE p_size % 2 = 0 GROUP BY 2
  UNION ALL SELECT 1, p_brand || '→x', 'reading', min(p_size) / 100.0, count(*), false FROM part WHERE p_size % 3 = 0 GROUP BY 2
  UNION ALL SELECT 1, 'new ' || p_brand, '', 0.5, 0, false FROM part GROUP BY 2)
SELECT replace(feature, ' for ', '→') AS feature, label, CAST(v AS DOUBLE) AS variant_likelihood, CAST(n AS INT) AS doc_freq, o AS orthography_match, false AS punct_penalty_applied
FROM (SELECT *, row_number() OVER (PARTITION BY replace(feature, ' for ', '→') ORDER BY k) AS r FROM f) WHERE r = 1""")  # fmt: skip
def csv_scores(spark, d):
    p, root = table(spark, d, "part"), _scratch(spark, "scores")
    s = F.col("p_size")
    a = p.where(s % 2 == 0).groupBy(_c(F.col("p_brand"), " for x").alias("feature")).agg(F.lit("variant").alias("label"), (F.max(s) / 100.0).alias("variant_likelihood"), F.count(s).alias("doc_freq"), F.lit("yes").alias("orthography_match?"))
    b = p.where(s % 3 == 0).groupBy(_c(F.col("p_brand"), "→x").alias("feature")).agg(F.lit("reading").alias("label"), (F.min(s) / 100.0).alias("variant_likelihood"), F.count(s).alias("doc_freq"))
    b = b.unionByName(p.select(_c("new ", F.col("p_brand")).alias("feature")).distinct(), allowMissingColumns=True)
    for name, rows in (("a", a), ("b", b)):
        rows.write.option("header", True).option("escape", '"').csv(f"{root}/{name}")
    return tables.read_scores(spark, [f"{root}/a", f"{root}/b"]).select("feature", "label", "variant_likelihood", "doc_freq", "orthography_match", "punct_penalty_applied")


@query("json_matches", """
SELECT l_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber || '' ELSE l_linenumber || '|' || (l_linenumber + 1) END AS canon_indexes, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_suppkey || '' END AS our_indexes, l_returnflag AS relation, l_linenumber % 3 <> 0 AS matched FROM lineitem""")
def json_matches(spark, d):
    root, n = _scratch(spark, "matches"), F.col("l_linenumber")
    one = F.struct(
        F.when(n % 2 == 0, n).alias("canon_index"), F.when(n % 2 == 1, F.array(n, n + 1)).alias("canon_indexes"), F.when(n % 3 != 0, F.col("l_suppkey").cast("int")).alias("our_index"),
        F.col("l_orderkey").cast("string").alias("canon_word"), F.col("l_returnflag").alias("relation"), (n % 3 != 0).alias("matched"),
    )
    items = table(spark, d, "lineitem")
    # an array of some thousand records a line, however many rows there are
    lines = items.groupBy(F.pmod(F.xxhash64("l_orderkey"), F.lit(-(-items.count() // 2000) or 1))).agg(F.to_json(F.collect_list(one)).alias("value"))
    lines.select("value").write.text(root)
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), "|").alias(c)
    return tables.read_matches(spark, root, lines=True).select(F.col("canon_word").cast("long").alias("l_orderkey"), join("canon_indexes"), join("our_indexes"), "relation", "matched")


@query("saved_corpus_pages", """
SELECT 'p/' || conv_id || '/0' AS first, CAST(turn AS INT) AS page, 'Y' || (turn + 1) || CASE WHEN turn % 2 = 0 THEN '.7' ELSE '' END AS ab_id, 0 AS ord, role AS text FROM conversations""")
def saved_corpus_pages(spark, d):
    root, c = _scratch(spark, "pages"), table(spark, d, "conversations")
    number = _c("00", F.col("turn") + 1, F.when(F.col("turn") % 2 == 0, ".07").otherwise(""))
    one = F.array(F.struct(F.lit("Y").alias("prefix"), number.alias("number"), F.col("role").alias("text")))
    url = lambda t: _c("p/", F.col("conv_id"), "/", t)
    c.select(url(F.col("turn")).alias("url"), url(F.col("turn") + 1).alias("next"), one.alias("results")).write.json(root)
    return tables.read_chains(spark, root)


@query("stored_reports", """
SELECT user_id || '' AS xml_id, CAST(count(*) AS INT) AS canon_count, CAST(count(*) FILTER (event_type = 'click') AS INT) AS subs_total, count(*) FILTER (event_type = 'click') / count(*) AS error_rate,
  CASE WHEN count(*) FILTER (event_type = 'click') >= 2 THEN 'low_conf_subs;high_error_rate' ELSE '' END AS triggers, count(*) FILTER (event_type = 'click') >= 2 AS flagged FROM events GROUP BY user_id""")
def stored_reports(spark, d):
    root, subs = _scratch(spark, "report"), F.count_if(F.col("event_type") == "click")
    rows = table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("xml_id")).agg(F.count(F.lit(1)).alias("canon_count"), subs.alias("subs_total"))
    some = F.array(F.lit("low_conf_subs"), F.lit("high_error_rate"))
    rows = rows.withColumn("error_rate", F.col("subs_total") / F.col("canon_count")).withColumn("triggers", F.when(F.col("subs_total") >= 2, some).otherwise(F.array().cast("array<string>")))
    sinks.write_report(rows.withColumn("flagged", F.size("triggers") > 0), root)
    back = tables.read_dry_run(spark, f"{root}/json").select("xml_id", "canon_count", "subs_total", "error_rate", "flagged")
    cells = tables.read_csv(spark, f"{root}/csv").select(F.col("xml_id").alias("x"), F.coalesce("triggers", F.lit("")).alias("triggers"))
    return back.join(cells, F.col("xml_id") == F.col("x")).drop("x")


@query("alignment_store", """SELECT p_brand AS witness_id, p_partkey AS our_index, p_type AS stanza_id, p_partkey AS lines FROM part""")
def alignment_store(spark, d):
    root = _scratch(spark, "store")
    rows = table(spark, d, "part").select(F.col("p_brand").alias("witness_id"), F.col("p_partkey").alias("our_index"), F.col("p_type").alias("stanza_id"))
    sinks.write_alignments(rows, f"{root}/store", f"{root}/lines")
    lines = spark.read.schema("witness_id string, our_index long, stanza_id string").json(f"{root}/lines").select(F.col("our_index").alias("lines"))
    return spark.read.parquet(f"{root}/store").join(lines, F.col("our_index") == F.col("lines")).select(F.col("witness_id").cast("string").alias("witness_id"), "our_index", "stanza_id", "lines")


@query("lineage_rows", "SELECT count(*) AS row_count, 0.9::DOUBLE AS pair_threshold, 'script' AS script, 64 AS digits, true AS stamped FROM part")
def lineage_rows(spark, d):
    root = _scratch(spark, "lineage")
    spark.range(3).coalesce(1).selectExpr("cast(id as string) value").write.text(root)
    out = sinks.lineage(table(spark, d, "part"), root, "script", 0.9)
    return out.select("row_count", "pair_threshold", "script", F.length("source_sha256").alias("digits"), F.col("created_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$").alias("stamped"))
