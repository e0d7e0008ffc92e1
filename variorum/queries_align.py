"""Queries over alignments, with the dynamic programmes written again in SQL.

Segments are made from ``part``: the name and four words more are the lemma, sizes are
witnesses, and the size's remainder tells how a witness departs from it: fused, split,
dropped, added or respelt words, or no text at all.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import apparatus, ladder, relations
from .queries import _L, _R, FAMILIES, RULES, SQL_EARLY, SQL_OPS, _sql_rules, query, table, token_pairs, with_
from .queries_more import recursive, sql_ratio
from .functions import text as C
from .session import written

_TAIL = " goes over the hills."
_EDITS = [(" over the ", " overthe "), ("hills", "hi lls"), (" over", ""), (" goes", " goes x"), ("o", "a"), (" goes over the ", " goesoverthe ")]


def made(spark, d) -> tuple[DataFrame, DataFrame]:
    """Lemma segments (ab_id, text) and witness segments (witness, ab_id, text)."""
    p = table(spark, d, "part").select("p_name", "p_size").distinct()
    t, e = F.concat("p_name", F.lit(_TAIL)), F.col("p_size") % 8
    text = t
    for k, (a, b) in enumerate(_EDITS, 1):
        text = F.when(e == k, F.replace(t, F.lit(a), F.lit(b))).otherwise(text)
    wits = p.where(e != 7).select(F.concat(F.lit("s"), "p_size").alias("witness"), F.col("p_name").alias("ab_id"), text.alias("text"))
    return p.select(F.col("p_name").alias("ab_id"), t.alias("text")).distinct(), wits


_SQL_TEXT = "CASE e " + " ".join(f"WHEN {k} THEN replace(t, '{a}', '{b}')" for k, (a, b) in enumerate(_EDITS, 1)) + " ELSE t END"
_KEY = "list_transform({0}, lambda x: lower(translate(x, '.,;:·⸳ ', '')))"
_NONE = "'-infinity'::DOUBLE"
_GAP = "0.6::DOUBLE"


@cache
def sql_work() -> str:
    """CTEs up to ``work`` (ab_id, witness, lt, wt, cover, diff) and ``spans`` (lt, wt, a, b, surface): every cell of the aligner's table by its recurrence."""
    runs = "[4, 3, 2, 4, 3, 2, 1]"
    left = "CASE WHEN c <= 3 THEN CASE WHEN i >= kk THEN array_to_string(lk[i - kk + 1:i], '') END ELSE lk[i] END"
    right = "CASE WHEN c BETWEEN 4 AND 6 THEN CASE WHEN j >= kk THEN array_to_string(wk[j - kk + 1:j], '') END ELSE wk[j] END"
    came = ", ".join(f"coalesce(b{k}[j], {_NONE}) + g[j][{5 - k}]" for k in (4, 3, 2))
    came += ", " + ", ".join(f"CASE WHEN j >= {k} THEN b1[j - {k - 1}] ELSE {_NONE} END + g[j][{8 - k}]" for k in (4, 3, 2))
    came += f", b1[j] + g[j][7], b1[j + 1] - {_GAP}"
    step = f"lambda acc, y: list_append(acc, greatest(y[1], acc[-1] - {_GAP}))"
    letters = "array_to_string(list_transform({0}, lambda x: chr(20000 + list_position(voc, ltrim(x, '.'))::INT)), '')"
    return f"""
base AS (SELECT DISTINCT p_name AS ab_id, p_size % 8 AS e, 's' || p_size AS witness, p_name || '{_TAIL}' AS t FROM part),
lem AS (SELECT DISTINCT ab_id, string_split(t, ' ') AS lt FROM base),
wit AS (SELECT ab_id, witness, string_split({_SQL_TEXT}, ' ') AS wt FROM base WHERE e <> 7),
joint AS (SELECT ab_id, witness, lt, wt FROM wit JOIN lem USING (ab_id)),
todo AS (SELECT row_number() OVER (ORDER BY lt, wt) AS pid, lt, wt, {_KEY.format('lt')} AS lk, {_KEY.format('wt')} AS wk, len(lt) AS n, len(wt) AS m,
  list_distinct(list_transform(list_concat(lt, wt), lambda x: ltrim(x, '.'))) AS voc FROM (SELECT DISTINCT lt, wt FROM joint WHERE lt <> wt)),
cells AS (SELECT *, unnest(range(1, m + 1)) AS j FROM (SELECT pid, lk, wk, m, unnest(range(1, n + 1)) AS i FROM todo)),
cand AS (SELECT pid, i, j, c, kk, {left} AS a, {right} AS b FROM (SELECT *, unnest(range(1, 8)) AS c, unnest({runs}) AS kk FROM cells)),
sp AS (SELECT DISTINCT a, b FROM cand WHERE a IS NOT NULL AND b IS NOT NULL), {sql_ratio('sp')},
gain AS (SELECT pid, i, j, c, CASE WHEN c = 7 THEN CASE WHEN s > 0 THEN greatest(s, 0.1::DOUBLE) ELSE 0::DOUBLE END WHEN s >= 0.5 THEN s + 0.05::DOUBLE * (kk - 1) ELSE {_NONE} END AS g
  FROM cand x LEFT JOIN ratio r ON x.a = r.a AND x.b = r.b),
gains AS (SELECT pid, i, list(gs ORDER BY j) AS g FROM (SELECT pid, i, j, list(g ORDER BY c) AS gs FROM gain GROUP BY pid, i, j) GROUP BY pid, i),
dp AS (
  SELECT pid, 0::BIGINT AS i, m, list_reduce(list_prepend([0::DOUBLE], list_transform(range(m), lambda x: [{_NONE}])), {step}) AS b1, NULL::DOUBLE[] AS b2, NULL::DOUBLE[] AS b3, NULL::DOUBLE[] AS b4,
    list_transform(range(m + 1), lambda x: 9::BIGINT) AS mv FROM todo
  UNION ALL
  SELECT pid, i, m, nb, b1, b2, b3, list_prepend(8::BIGINT, list_transform(range(1, m + 1), lambda j: CASE WHEN nb[j] - {_GAP} > list_max(x[j]) THEN 9 ELSE list_position(x[j], list_max(x[j])) END::BIGINT)) FROM (
    SELECT *, list_reduce(list_prepend([b1[1] - {_GAP}], list_transform(x, lambda c: [list_max(c)])), {step}) AS nb FROM (
      SELECT dp.pid, dp.i + 1 AS i, m, b1, b2, b3, b4, list_transform(range(1, m + 1), lambda j: [{came}]) AS x FROM dp JOIN gains ON gains.pid = dp.pid AND gains.i = dp.i + 1))),
path AS (
  SELECT pid, n AS i, m AS j, 0::BIGINT AS code, 0::BIGINT AS b, 0::BIGINT AS d FROM todo
  UNION ALL
  SELECT pid, i - CASE WHEN c <= 3 THEN 5 - c WHEN c = 9 THEN 0 ELSE 1 END, j - CASE WHEN c <= 3 THEN 1 WHEN c <= 6 THEN 8 - c WHEN c = 8 THEN 0 ELSE 1 END, c, i, j
  FROM (SELECT path.pid, path.i, path.j, mv[path.j + 1] AS c FROM path JOIN dp ON dp.pid = path.pid AND dp.i = path.i WHERE path.i > 0 OR path.j > 0)),
ops AS (SELECT lt, wt, code, i AS a, b, j AS c, d FROM path JOIN todo USING (pid) WHERE code > 0),
placed AS (SELECT lt, wt, range(c, d) AS ws, unnest(range(a, b)) AS li FROM ops WHERE code < 9),
words AS (SELECT lt, wt, {letters.format('lt')} AS a, {letters.format('wt')} AS b FROM todo),
tokens AS (SELECT DISTINCT a, b FROM words), {sql_ratio('tokens', 'tk')},
alike AS (SELECT DISTINCT a, b, unnest(range(ah, ah + k)) AS li FROM tk_cut WHERE k > 0),
differ AS (SELECT placed.lt, placed.wt, list(placed.li ORDER BY placed.li) AS diff FROM placed JOIN words w ON w.lt = placed.lt AND w.wt = placed.wt LEFT JOIN alike s ON s.a = w.a AND s.b = w.b AND s.li = placed.li
  WHERE s.li IS NULL AND w.a <> w.b GROUP BY placed.lt, placed.wt),
covers AS (SELECT lt, wt, list(ws ORDER BY li) AS cover FROM placed GROUP BY lt, wt UNION ALL SELECT DISTINCT lt, wt, list_transform(range(len(lt)), lambda i: [i]) FROM joint WHERE lt = wt),
work AS (SELECT ab_id, witness, b.lt, b.wt, cover, coalesce(diff, []) AS diff FROM joint b JOIN covers c ON c.lt = b.lt AND c.wt = b.wt LEFT JOIN differ f ON f.lt = b.lt AND f.wt = b.wt),
spans AS (SELECT lt, wt, a, b, array_to_string(wt[c + 1:d], ' ') AS surface FROM ops WHERE code < 9 UNION SELECT lt, wt, li, li + 1, array_to_string(list_transform(ws, lambda w: wt[w + 1]), ' ') FROM placed
  UNION SELECT lt, wt, i, i + 1, lt[i + 1] FROM (SELECT DISTINCT lt, wt, unnest(range(len(lt))) AS i FROM joint WHERE lt = wt))"""


@cache
def sql_entries() -> str:
    """The same up to ``entries`` (ab_id, a, b)."""
    inside = "cover[a + 1:b]"
    return sql_work() + f""",
spread_ AS (SELECT ab_id, witness, cover, diff, a, b, surface FROM work w JOIN spans s ON s.lt = w.lt AND s.wt = w.wt),
many AS (SELECT DISTINCT ab_id, a, b FROM spread_ WHERE b - a > 1 AND ((len(list_distinct({inside})) = 1 AND len(cover[a + 1]) = 1) OR len(list_filter({inside}, lambda x: len(x) > 1)) > 0)),
ones AS (SELECT DISTINCT ab_id, unnest(diff) AS a FROM work UNION SELECT ab_id, a FROM spread_ WHERE b - a = 1 AND contains(trim(surface), ' ')),
chosen AS (SELECT ab_id, a, b FROM many UNION SELECT ab_id, a, a + 1 FROM ones o WHERE NOT EXISTS (SELECT 1 FROM many m WHERE m.ab_id = o.ab_id AND m.a <= o.a AND o.a + 1 <= m.b)),
entries AS (SELECT ab_id, a, b FROM chosen UNION SELECT ab_id, i, i + 1 FROM (SELECT ab_id, unnest(range(len(lt))) AS i FROM lem WHERE ab_id IN (SELECT ab_id FROM work) AND ab_id NOT IN (SELECT ab_id FROM chosen)))"""


@cache
def sql_grid() -> str:
    """The same up to ``grid`` (app_id, ab_id, a, b, lem, witness, rdg): every entry with every witness."""
    return sql_entries() + """,
apps AS (SELECT 'app-' || ab_id || '-' || a || '-' || b AS app_id, ab_id, a, b, array_to_string(lt[a + 1:b], ' ') AS lem FROM entries JOIN lem USING (ab_id)),
grid AS (SELECT app_id, ab_id, a, b, lem, witness, coalesce(array_to_string(list_transform(list_sort(list_distinct(flatten(cover[a + 1:b]))), lambda i: wt[i + 1]), ' '), '') AS rdg
  FROM apps CROSS JOIN (SELECT DISTINCT witness FROM wit) LEFT JOIN (SELECT ab_id, witness, cover, wt FROM work) USING (ab_id, witness))"""


def _grid(spark, d) -> DataFrame:
    lemma, wits = made(spark, d)
    work = written(apparatus.aligned(lemma, wits))
    return apparatus.readings(work, apparatus.entry_spans(work), wits)


@query("aligned_segments", f"""WITH RECURSIVE {sql_work()},
  s AS (SELECT lt, wt, array_to_string(list(a || '-' || b || ':' || surface ORDER BY a, b), '|') AS spans FROM spans GROUP BY lt, wt)
SELECT ab_id, witness, spans, array_to_string(list_transform(cover, lambda x: array_to_string(x, ',')), ';') AS cover, array_to_string(diff, ',') AS diff FROM work w JOIN s ON s.lt = w.lt AND s.wt = w.wt""")
def aligned_segments(spark, d):
    join = lambda c: F.array_join(c.cast("array<string>"), ",")
    spans = F.transform("spans", lambda s: F.concat(s["a"], F.lit("-"), s["b"], F.lit(":"), s["surface"]))
    return apparatus.aligned(*made(spark, d)).select("ab_id", "witness", F.array_join(spans, "|").alias("spans"), F.array_join(F.transform("cover", join), ";").alias("cover"), join(F.col("diff")).alias("diff"))


@query("entry_span_set", f"WITH RECURSIVE {sql_entries()} SELECT ab_id, CAST(a AS INT) AS a, CAST(b AS INT) AS b FROM entries")
def entry_span_set(spark, d):
    return apparatus.entry_spans(written(apparatus.aligned(*made(spark, d))))


@query("reading_grid", f"WITH RECURSIVE {sql_grid()} SELECT app_id, ab_id, CAST(a AS INT) AS a, CAST(b AS INT) AS b, lem, witness, rdg FROM grid")
def reading_grid(spark, d):
    return _grid(spark, d)


@query("grid_groups", f"WITH RECURSIVE {sql_grid()} SELECT app_id, rdg, array_to_string(list(witness ORDER BY witness), ' ') AS wits FROM grid GROUP BY app_id, rdg")
def grid_groups(spark, d):
    return apparatus.grouped_readings(_grid(spark, d))


_BARE = f"translate(strip_accents(translate({{0}}, '. ', '')), '{C.VOWELS}', '')"


def sql_ladder(rows: str) -> str:
    """CTEs from ``rows`` (with lem, rdg, before, after) to ``typed`` (the same with type): every step of the ladder."""
    return f"""ld AS (SELECT *, {SQL_EARLY} AS early, {_BARE.format(_L)} AS sa, {_BARE.format(_R)} AS sb, {_L} AS fl, {_R} AS fr FROM {rows}),
  lp AS (SELECT DISTINCT sa AS a, sb AS b FROM ld WHERE early IS NULL), {sql_ratio('lp', 'lr')},
  lo AS (SELECT x.*, s, CASE WHEN fl = fr THEN CAST([] AS VARCHAR[]) ELSE o END AS ops FROM (SELECT ld.*, {SQL_OPS.replace('lem', 'fl').replace('rdg', 'fr')} AS o FROM ld) x LEFT JOIN lr ON lr.a = sa AND lr.b = sb),
  typed AS (SELECT *, coalesce(early, CASE WHEN sa <> sb AND s < 0.8 THEN 'meaningful' END, CASE WHEN len(ops) > 0 THEN {_sql_rules(False)} END, 'trivial') AS type FROM lo)"""


@query("ladder_grid", f"""WITH RECURSIVE {sql_grid()}, ordered AS (SELECT app_id, lag(lem) OVER w AS before, lead(lem) OVER w AS after FROM apps WINDOW w AS (ORDER BY ab_id, a, b)),
  near AS (SELECT * FROM grid JOIN ordered USING (app_id)), {sql_ladder('near')}
SELECT app_id, witness, lem, rdg, type FROM typed""")
def ladder_grid(spark, d):
    # all segments are one document, in order of their ids
    rows = ladder.with_neighbours(written(_grid(spark, d)), [], ["ab_id", "a", "b"])
    return ladder.classify(rows, RULES, FAMILIES).select("app_id", "witness", "lem", "rdg", "type")


@query("ladder_full", recursive(with_(f", {sql_ladder('pairs')} SELECT ab_id, witness, pos, type FROM typed")))
def ladder_full(spark, d):
    return ladder.classify(token_pairs(spark, d), RULES, FAMILIES).select("ab_id", "witness", "pos", "type")


# -- stanzas: the global aligner -----------------------------------------------------------------------

_SQL_NW = f"""
base AS (SELECT DISTINCT p_name AS ab_id, p_size % 8 AS e, 's' || p_size AS witness, p_name || '{_TAIL}' AS t FROM part),
st AS (SELECT ab_id || '@' || witness AS xml_id, string_split(lower(t), ' ') AS canon, string_split(lower({_SQL_TEXT}), ' ') AS our FROM base WHERE e <> 7),
todo AS (SELECT row_number() OVER (ORDER BY canon, our) AS pid, canon, our, list_transform(canon, lambda x: replace(x, '.', '')) AS ck, list_transform(our, lambda x: replace(x, '.', '')) AS ok,
  len(canon) AS n, len(our) AS m FROM (SELECT DISTINCT canon, our FROM st)),
cells AS (SELECT pid, i, ck[i] AS a, ok[j] AS b, j FROM (SELECT *, unnest(range(1, m + 1)) AS j FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM todo))),
sp AS (SELECT DISTINCT a, b FROM cells), {sql_ratio('sp')},
sims AS (SELECT pid, i, list(CASE WHEN c.a <> '' AND c.b <> '' THEN s ELSE 0::DOUBLE END ORDER BY j) AS g FROM cells c JOIN ratio r ON r.a = c.a AND r.b = c.b GROUP BY pid, i),
dp AS (
  SELECT pid, 0::BIGINT AS i, m, list_transform(range(m + 1), lambda j: -0.25::DOUBLE * j) AS b1, list_transform(range(m + 1), lambda j: 3::BIGINT) AS mv FROM todo
  UNION ALL
  SELECT pid, i, m, nb, list_prepend(2::BIGINT, list_transform(range(1, m + 1), lambda j: CASE WHEN b1[j] + g[j] >= b1[j + 1] - 0.25::DOUBLE AND b1[j] + g[j] >= nb[j] - 0.25::DOUBLE THEN 1
      WHEN b1[j + 1] >= nb[j] THEN 2 ELSE 3 END::BIGINT)) FROM (
    SELECT dp.pid, dp.i + 1 AS i, m, b1, g, list_reduce(list_prepend([b1[1] - 0.25::DOUBLE], list_transform(range(1, m + 1), lambda j: [greatest(b1[j] + g[j], b1[j + 1] - 0.25::DOUBLE)])),
      lambda acc, y: list_append(acc, greatest(y[1], acc[-1] - 0.25::DOUBLE))) AS nb FROM dp JOIN sims ON sims.pid = dp.pid AND sims.i = dp.i + 1)),
path AS (
  SELECT pid, n AS i, m AS j, 0::BIGINT AS code, 0::BIGINT AS step FROM todo
  UNION ALL
  SELECT pid, i - CASE WHEN c = 3 THEN 0 ELSE 1 END, j - CASE WHEN c = 2 THEN 0 ELSE 1 END, c, step + 1
  FROM (SELECT path.pid, path.i, path.j, step, mv[path.j + 1] AS c FROM path JOIN dp ON dp.pid = path.pid AND dp.i = path.i WHERE path.i > 0 OR path.j > 0)),
runs AS (SELECT *, sum(CASE WHEN code = 1 AND last = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY pid ORDER BY step DESC) AS run FROM (
  SELECT *, lag(code) OVER (PARTITION BY pid ORDER BY step DESC) AS last FROM path WHERE code > 0)),
groups AS (SELECT pid, run, coalesce(list(i ORDER BY i) FILTER (code <> 3), []) AS c, coalesce(list(j ORDER BY j) FILTER (code <> 2), []) AS o FROM runs GROUP BY pid, run),
made AS (SELECT xml_id, st.canon, st.our, pid FROM st JOIN todo ON todo.canon = st.canon AND todo.our = st.our)"""


def _made_stanzas(spark, d) -> DataFrame:
    lemma, wits = made(spark, d)
    words = lambda c: F.split(F.lower(c), " ")
    rows = wits.join(lemma.select("ab_id", F.col("text").alias("l")), "ab_id")
    return rows.select(F.concat_ws("@", "ab_id", "witness").alias("xml_id"), words("l").alias("canon"), words("text").alias("our"))


@query("global_groups", f"""WITH RECURSIVE {_SQL_NW},
  score AS (SELECT pid, round(b1[-1], 9) AS score FROM dp JOIN todo USING (pid) WHERE i = n),
  g AS (SELECT pid, array_to_string(list(array_to_string(c, ',') || '/' || array_to_string(o, ',') ORDER BY run), ' ') AS groups FROM groups GROUP BY pid)
SELECT xml_id, groups, score FROM made JOIN g USING (pid) JOIN score USING (pid)""")
def global_groups(spark, d):
    join = lambda c: F.array_join(c.cast("array<string>"), ",")
    out = relations.dp_groups(_made_stanzas(spark, d))
    return out.select("xml_id", F.array_join(F.transform("groups", lambda g: F.concat(join(g["c"]), F.lit("/"), join(g["o"]))), " ").alias("groups"), F.round("score", 9).alias("score"))


_SQL_EXPORT = """
  g AS (SELECT xml_id, canon, our, c, o FROM made JOIN groups USING (pid) WHERE len(c) + len(o) > 0),
  even AS (SELECT xml_id, canon, our, unnest(c) AS ci, unnest(o) AS oi FROM g WHERE len(c) = len(o)),
  out AS (
    SELECT xml_id, oi || '' AS our_index, our[oi + 1] AS our_word, ci || '' AS canon_indexes, canon[ci + 1] AS canon_words, CASE WHEN canon[ci + 1] = our[oi + 1] THEN 'equal' ELSE 'substitution' END AS relation, true AS matched FROM even
    UNION ALL SELECT xml_id, array_to_string(o, ';'), array_to_string(list_transform(o, lambda i: our[i + 1]), ' '), array_to_string(c, ';'),
      CASE WHEN len(c) > 0 THEN array_to_string(list_transform(c, lambda i: regexp_replace(canon[i + 1], '\\.$', '')), '.') || '.' ELSE '' END, 'grouped', true FROM g WHERE len(c) <> len(o))"""


@query("exported_alignment", f"WITH RECURSIVE {_SQL_NW}, {_SQL_EXPORT} SELECT * FROM out")
def exported_alignment(spark, d):
    return relations.exported_groups(relations.dp_groups(_made_stanzas(spark, d)))
