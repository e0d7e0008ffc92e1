"""Queries over whole documents and stores: damaged files, neighbours in document order, merged alignments, milestones."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import books, order, segments
from .operators import rules as rule_tables
from .queries import query, table, witnesses
from .queries_more import _SQL_AT, _c, _files, _turns
from .session import scratch_path
from .sources import sinks, store, xml

# -- damaged files -------------------------------------------------------------------------------------
# conversations are files, turns segments; the id's remainder by 6 tells what is wrong with a file


def _damaged(spark, d):
    t, kind = _turns(spark, d), F.col("conv_id") % 6
    last = t.groupBy("conv_id").agg(F.max("at").alias("last"))
    t = t.join(last, "conv_id")
    ident = _c("A", F.col("conv_id"), ".", F.col("turn"))
    bare = F.when(kind == 4, _c("<ab xml:id=", ident, " n=n", F.col("turn"), " n='again'>")).otherwise(_c('<ab xml:id="', ident, '" n="n', F.col("turn"), '">'))
    said = F.when(kind == 3, _c(F.col("role"), " & < ")).when(kind == 2, _c(F.col("role"), "</hi> ")).otherwise(_c(F.col("role"), " "))
    rest = F.when((kind == 5) & (F.col("at") == F.col("last")), "one").otherwise(
        _c('one<lb break="no"/> more<lb/>', F.col("turn"), "<note>gone</note> <seg>end", F.when(kind == 1, "").otherwise("</seg>"), "</ab>", F.when(kind == 2, "</p>").otherwise(""))
    )
    files = _files(t.withColumn("x", _c(bare, said, rest)), F.col("x"), '<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div xml:id="A">', "</div></body></text></TEI>")
    number = F.regexp_extract("path", r"(\d+)\.xml$", 1).cast("long")
    cut = F.substring_index(F.decode("content", "UTF-8"), "</div>", 1)
    return files.withColumn("content", F.when(number % 6 == 5, F.encode(cut, "UTF-8")).otherwise(F.col("content")))


_SQL_DAMAGED = f"{_SQL_AT}, l AS (SELECT conv_id, max(pl) AS last FROM t GROUP BY conv_id), k AS (SELECT *, conv_id % 6 AS kind FROM t JOIN l USING (conv_id))"


@query("recovered_scan", f"""WITH {_SQL_DAMAGED} SELECT 'in/' || conv_id || '.xml' AS path, 'A' || conv_id || '.' || turn AS ab_id, CAST(4 + 5 * pl AS INT) AS ord,
  role || CASE WHEN kind = 3 THEN ' & <' ELSE '' END || CASE WHEN kind = 5 AND pl = last THEN ' one' ELSE ' onemore ' || turn || ' end' END AS text FROM k""")
def recovered_scan(spark, d):
    return segments.lemma_segments(xml.segments_of(_damaged(spark, d)), ["A"])


@query("repaired_files", f"""WITH {_SQL_DAMAGED}, r AS (
  SELECT conv_id, unnest(CASE kind WHEN 1 THEN ['unclosed element'] WHEN 2 THEN ['stray end tag', 'stray end tag'] WHEN 3 THEN ['bare &', 'bare <']
    WHEN 4 THEN ['value without quotes', 'value without quotes', 'repeated attribute'] WHEN 5 THEN CASE WHEN pl = last THEN ['unclosed element', 'unclosed element', 'unclosed element', 'unclosed element', 'unclosed element'] ELSE [] END ELSE [] END) AS kind FROM k)
SELECT 'in/' || conv_id || '.xml' AS path, kind, count(*) AS n FROM r GROUP BY conv_id, kind""")
def repaired_files(spark, d):
    return xml.unparsed(_damaged(spark, d)).select("path", F.explode("repairs").alias("r")).groupBy("path", F.col("r.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# -- order ---------------------------------------------------------------------------------------------


@query("document_neighbours", """
SELECT l_returnflag, l_orderkey, l_linenumber, l_suppkey, l_partkey, lag(l_partkey) OVER w AS before, lead(l_partkey) OVER w AS after FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey)""")
def document_neighbours(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return order.neighbours(rows, ["l_returnflag"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "l_partkey")


# -- the alignment store -------------------------------------------------------------------------------

_CHANGED = "p_brand IN (SELECT p_brand FROM part GROUP BY p_brand HAVING min(p_partkey) % 3 = 0)"


@query("merged_store", f"""
WITH b AS (SELECT p_brand AS witness_id, CASE WHEN p_size % 7 > 0 THEN p_type END AS stanza_id, p_partkey % 5 AS our_index, p_name AS word, NULL AS note, 0 AS batch, p_partkey AS row FROM part
  UNION ALL SELECT p_brand, CASE WHEN p_size % 7 > 0 THEN p_type END, p_partkey % 4, upper(p_name), 'again', 1, p_partkey FROM part WHERE {_CHANGED}
  UNION ALL SELECT 'new', p_type, p_partkey % 3, p_name, 'third', 2, p_partkey FROM part)
SELECT witness_id, stanza_id, our_index, word, note FROM (SELECT *, row_number() OVER (PARTITION BY witness_id, stanza_id, our_index ORDER BY batch DESC, row DESC) AS n FROM b)
WHERE n = 1 OR stanza_id IS NULL""")
def merged_store(spark, d):
    p, root = table(spark, d, "part"), scratch_path(spark, "store")
    stanza = F.when(F.col("p_size") % 7 > 0, F.col("p_type")).alias("stanza_id")
    changed = p.groupBy("p_brand").agg(F.min("p_partkey").alias("m")).where("m % 3 = 0").select("p_brand")
    key = F.col("p_partkey")
    store.merge_alignments(p.select(F.col("p_brand").alias("witness_id"), stanza, (key % 5).alias("our_index"), F.col("p_name").alias("word"), key.alias("row")), root, ["row"])
    again = p.join(changed, "p_brand", "left_semi")
    again = again.select(F.col("p_brand").alias("witness_id"), stanza, (key % 4).alias("our_index"), F.upper("p_name").alias("word"), F.lit("again").alias("note"), key.alias("row"))
    store.merge_alignments(again, root, ["row"])
    new = p.select(F.lit("new").alias("witness_id"), F.col("p_type").alias("stanza_id"), (key % 3).alias("our_index"), F.col("p_name").alias("word"), F.lit("third").alias("note"), key.alias("row"))
    store.merge_alignments(new, root, ["row"])
    return store.read_alignments(spark, root).select("witness_id", "stanza_id", "our_index", "word", "note")


# -- milestones ----------------------------------------------------------------------------------------
# a conversation is a file, a turn a segment; three words are a line, eight a page


@query("milestone_files", """
WITH w AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS word, generate_subscripts(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), 1) AS i FROM conversations),
  s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS seq FROM w)
SELECT 'in/' || conv_id || '.xml' AS path, 'c' || turn AS id, 'p' || seq // 8 AS page, (seq % 8) // 3 + 1 || '' AS line, CAST(seq AS INT) AS seq, nfc_normalize(word) AS word FROM s""")
def milestone_files(spark, d):
    ab = _c('<ab xml:id="c', F.col("turn"), '">old <hi>words</hi></ab>')
    files = _files(_turns(spark, d), ab, '<TEI xmlns="http://www.tei-c.org/ns/1.0"><text>', "</text></TEI>")
    c = table(spark, d, "conversations")
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    words = c.select(_c("in/", F.col("conv_id"), ".xml").alias("path"), "turn", F.posexplode(words).alias("i", "word"))
    before = words.groupBy("path", "turn").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    upto = F.sum("n").over(Window.partitionBy("path").orderBy("turn")) - F.col("n")
    words = words.join(before.select("path", "turn", upto.alias("first")), ["path", "turn"]).withColumn("seq", F.col("first") + F.col("i"))
    seq = F.col("seq")
    words = words.select("path", _c("c", F.col("turn")).alias("ab_id"), "seq", _c("p", F.floor(seq / 8)).alias("page"), F.floor(seq % 8 / 3).cast("int").alias("line"), "word")
    return xml.paged_of(sinks.paged_segments(files, words))


# -- books ---------------------------------------------------------------------------------------------


@query("book_matches")
def book_matches(spark, d):
    """Every document with the one that it is a witness of, word by word over their whole texts."""
    lines = witnesses(spark, d).where("trim(text) <> ''")
    words = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: F.filter(F.split(F.lower(x["text"]), r"\s+"), lambda w: w != "")))
    texts = lines.groupBy("lemma", "doc_id").agg(words.alias("words"))
    pairs = texts.where("lemma <> doc_id").select("lemma", F.col("doc_id").alias("book"), F.col("words").alias("our"))
    lemmas = texts.where("lemma = doc_id").select("lemma", F.col("words").alias("canon"))
    return books.match_books(pairs.join(lemmas, "lemma").select("book", "canon", "our")).select(F.col("book").alias("doc_id"), "c", "o")


# -- rules ---------------------------------------------------------------------------------------------
# suppliers are rules, parts operations

_SQL_RULES = """
rules AS (SELECT CAST(s_suppkey AS INT) AS ord, CASE WHEN s_suppkey % 4 IN (1, 2) THEN 'match_regex' ELSE 'match' END AS kind, CASE s_suppkey % 4 WHEN 0 THEN x || '→' || y WHEN 1 THEN x || '.*' || y || 'r' WHEN 2 THEN '^[' || x || y || '].*→' ELSE x || ' inserted' END AS pattern,
  CASE s_suppkey % 5 WHEN 0 THEN 'meaningful' ELSE 'trivial' END AS label, CASE s_suppkey % 3 WHEN 0 THEN 'forward' WHEN 1 THEN 'reverse' ELSE 'either' END AS direction, CASE WHEN s_suppkey % 7 < 3 THEN 'SMALL' END AS wanted, CASE WHEN s_suppkey % 5 = 3 THEN 'BIG' END AS barred
  FROM (SELECT *, chr(CAST(97 + s_suppkey % 26 AS INT)) AS x, chr(CAST(97 + (s_suppkey // 3) % 26 AS INT)) AS y FROM supplier)),
ops AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN substr(a, 1, 1) || '→' || substr(b, 1, 1) WHEN 1 THEN substr(a, 1, 1) || ' inserted' ELSE a || '→' || b END AS op, CASE WHEN p_size < 25 THEN 'SMALL' ELSE 'BIG' END AS grp
  FROM (SELECT *, lower(string_split(p_name, ' ')[1]) AS a, lower(string_split(p_type, ' ')[1]) AS b FROM part)),
hits AS (SELECT p_partkey, op, ord, label FROM ops JOIN rules ON (wanted IS NULL OR wanted = grp) AND (barred IS NULL OR barred <> grp) AND CASE WHEN kind = 'match_regex' THEN regexp_matches(op, pattern)
  WHEN strpos(pattern, '→') = 0 OR direction = 'forward' THEN op = pattern WHEN direction = 'reverse' THEN op = split_part(pattern, '→', 2) || '→' || split_part(pattern, '→', 1)
  ELSE op IN (pattern, split_part(pattern, '→', 2) || '→' || split_part(pattern, '→', 1)) END)"""


@query("rule_table", f"WITH {_SQL_RULES} SELECT o.p_partkey, o.op, min(ord) AS ord, arg_min(label, ord) AS label FROM ops o LEFT JOIN hits h USING (p_partkey) GROUP BY o.p_partkey, o.op")
def rule_table(spark, d):
    s, p = table(spark, d, "supplier"), table(spark, d, "part")
    k, none = F.col("s_suppkey"), F.array().cast("array<string>")
    letter = lambda n: F.chr(97 + n % 26)
    x, y = letter(k), letter(F.floor(k / 3))
    rules = s.select(
        k.cast("int").alias("ord"), F.when((k % 4).isin(1, 2), "match_regex").otherwise("match").alias("kind"),
        F.when(k % 4 == 0, _c(x, "→", y)).when(k % 4 == 1, _c(x, ".*", y, "r")).when(k % 4 == 2, _c("^[", x, y, "].*→")).otherwise(_c(x, " inserted")).alias("pattern"),
        F.when(k % 5 == 0, "meaningful").otherwise("trivial").alias("label"), F.when(k % 3 == 0, "forward").when(k % 3 == 1, "reverse").otherwise("either").alias("direction"),
        F.when(k % 7 < 3, F.array(F.lit("SMALL"))).otherwise(none).alias("groups"), F.when(k % 5 == 3, F.array(F.lit("BIG"))).otherwise(none).alias("exclude_groups"),
    )
    a, b, n = F.lower(F.split("p_name", " ")[0]), F.lower(F.split("p_type", " ")[0]), F.col("p_partkey")
    first = lambda w: F.substring(w, 1, 1)
    op = F.when(n % 3 == 0, _c(first(a), "→", first(b))).when(n % 3 == 1, _c(first(a), " inserted")).otherwise(_c(a, "→", b))
    ops = p.select("p_partkey", op.alias("op"), F.array(F.when(F.col("p_size") < 25, "SMALL").otherwise("BIG")).alias("groups"))
    return rule_tables.first_rule(ops, rules).select("p_partkey", "op", "ord", "label")
