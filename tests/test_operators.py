from pyspark.sql import functions as F

from variorum.functions import udfs
from variorum.kernels.annotate import Annotator
from variorum.operators import apparatus, cascade, curate, ladder, post, relations, reports
from variorum.plans import collate

RULES = [{"kind": "match", "pattern": "ī→ū", "label": "meaningful", "groups": ["Indian"], "exclude_groups": []}, {"kind": "match_regex", "pattern": "→", "label": "trivial", "groups": [], "exclude_groups": []}]
FAMILIES = [{"family": "thorn", "patterns": ["[tϑ]"], "compare_only": []}]


def test_apparatus_spans_and_readings(spark):
    lemma = spark.createDataFrame([("s1", "aaa bbb ccc ddd"), ("s2", "x y"), ("s3", "")], "ab_id string, text string")
    wits = spark.createDataFrame([("w1", "s1", "aaabbb ccc dd d"), ("w2", "s1", "aaa bbb ccc ddd"), ("w1", "s2", "x y"), ("w1", "s3", "q")], "witness string, ab_id string, text string")
    work = apparatus.aligned(lemma, wits)
    spans = sorted(tuple(r) for r in apparatus.entry_spans(work).collect())
    assert spans == [("s1", 0, 2), ("s1", 3, 4), ("s2", 0, 1), ("s2", 1, 2)]
    rows = apparatus.readings(work, apparatus.entry_spans(work), wits)
    got = {(r.app_id, r.witness): (r.lem, r.rdg) for r in rows.collect()}
    assert got["app-s1-0-2", "w1"] == ("aaa bbb", "aaabbb") and got["app-s1-3-4", "w1"] == ("ddd", "dd d") and got["app-s2-0-1", "w2"] == ("x", "")
    grouped = {(r.app_id, r.rdg): r.wits for r in apparatus.grouped_readings(rows.where("ab_id = 's1'")).collect()}
    assert grouped["app-s1-0-2", "aaa bbb"] == "w2"
    again = apparatus.aligned(lemma, wits.repartition(3))
    assert sorted(tuple(r) for r in apparatus.entry_spans(again).collect()) == spans


def test_ladder(spark):
    rows = [
        ("abc", "", None, None, "missing"), ("abc", " ABC※", None, None, "trivial"), ("frā.", "frāmąm.", None, "mąm.", "trivial"), ("tap", "ϑap", None, None, "trivial"),
        ("abcdefghij", "abcde", None, None, "meaningful"), ("abcdef", "abcdefghij", None, None, "meaningful"), ("bcdfg", "klmnp", None, None, "meaningful"),
        ("bīr", "būr", None, None, "meaningful"), ("bir", "ber", None, None, "trivial"), ("bkr", "bgr", None, None, "meaningful"), ("abcd", "abcda", None, None, "trivial"),
    ]
    df = spark.createDataFrame(rows, "lem string, rdg string, before string, after string, want string")
    got = ladder.classify(df, RULES, FAMILIES).collect()
    assert len(got) == len(rows) and all(r.type == r.want for r in got), [r for r in got if r.type != r.want]
    named = df.withColumn("g", F.array(F.lit("Iranian")))
    assert {r.type for r in ladder.classify(named, RULES, FAMILIES, "g").where("lem = 'bīr'").collect()} == {"trivial"}
    assert ladder.type_summary(ladder.classify(df, RULES, FAMILIES)).agg(F.round(F.sum("pct"), 3)).first()[0] == 100


def test_alignment_choice(spark):
    rows = [("s1", ["ab", "cd", "ef"], ["ab", "cd", "ef"]), ("s2", ["abab", "cdcd"], ["zz", "yy", "xx", "ww"])]
    stanzas = spark.createDataFrame(rows, "xml_id string, canon array<string>, our array<string>")
    diag = {r.xml_id: r for r in relations.gate(relations.greedy_matches(stanzas)).collect()}
    assert not diag["s1"].flagged and diag["s2"].flagged and diag["s2"].unmatched == 4
    out = {(r.xml_id, r.our_index): r for r in collate.chosen_alignment(stanzas).collect()}
    assert out["s1", 0].final_choice == "greedy" and out["s1", 0].final_canon_indexes == [0] and out["s2", 0].final_choice in ("dp", "both")
    export = {(r.xml_id, r.our_index): r for r in relations.exported_groups(relations.dp_groups(stanzas)).collect()}
    assert export["s1", "1"].relation == "equal" and export["s1", "1"].canon_indexes == "1"
    changed = relations.realigned(relations.greedy_matches(stanzas), relations.gate(relations.greedy_matches(stanzas))).collect()
    assert [r.xml_id for r in changed] == ["s2"]
    compat = relations.compared(*[relations.word_rows(relations.dp_groups(stanzas), "groups", p) for p in ("greedy", "dp")], compat=True)
    assert {r.final_choice for r in compat.collect()} == {"both"}


def test_post_processing(spark):
    rows = spark.createDataFrame([("a1", "ab cd", "w1", "ab cd", "meaningful", 0), ("a1", "ab cd", "w2", "", "missing", 0), ("a2", "ab cd", "w1", "abcd", "trivial", 1), ("a3", "x", "w1", "y", "trivial", 2)],
                                 "app_id string, lem string, witness string, rdg string, type string, ord int")
    got = {(r.app_id, r.witness): (r.lem, r.rdg, r.type) for r in post.split_entries(rows).collect()}
    assert got == {("a1-0", "w1"): ("ab", "ab", "trivial"), ("a1-1", "w1"): ("cd", "cd", "trivial"), ("a1-0", "w2"): ("ab", "", "missing"), ("a1-1", "w2"): ("cd", "", "missing"),
                   ("a2", "w1"): ("ab cd", "abcd", "trivial"), ("a3", "w1"): ("x", "y", "trivial")}
    spill = spark.createDataFrame([("d", 0, "aaa", "w", "aaa"), ("d", 1, "bbb", "w", "aaa bbb ccc"), ("d", 2, "ccc", "w", "ccc")], "doc string, ord int, lem string, witness string, rdg string")
    assert {r.ord: r.rdg for r in post.trim_spillover(spill, ["doc"], ["ord"]).collect()} == {0: "aaa", 1: "bbb", 2: "ccc"}
    fixes = spark.createDataFrame([("a3", "w1", "y", "z"), ("a2", "w1", "nope", "z")], "app_id string, witness string, guard_text string, new_text string")
    assert {r.app_id: r.rdg for r in post.point_fixes(rows, fixes).where("witness = 'w1'").collect()} == {"a1": "ab cd", "a2": "abcd", "a3": "z"}
    assert post.trim_windows(rows).where("changed").count() == 0 and post.trim_segments(rows).count() == 4


def test_cascade_rows_and_unknowns(spark):
    rows = spark.createDataFrame([("a1", "bg", "bk", "#w1 #w2"), ("a2", "bg", "bk", "#w3"), ("a3", "bg", "", "#w1"), ("a4", "x", "y", "#w1")], "app_id string, lem string, rdg string, wit string")
    groups = spark.createDataFrame([("w1", "A"), ("w2", "B")], "witness string, grp string")
    over = spark.createDataFrame([("a4", " y ", "trivial")], "app_id string, rdg_text string, label_override string")
    a = Annotator(rules=[{"kind": "match", "pattern": "k→g", "label": "meaningful", "direction": "either", "groups": ["B"], "exclude_groups": []}])
    out = collate.annotated_readings(rows, groups, a, over)
    assert {r.app_id: r.ana for r in out.collect()} == {"a1": "#variants", "a2": "#unknown", "a3": "#missing", "a4": "#readings"}
    assert [r.app_id for r in cascade.unknowns(out).collect()] == ["a2"]
    assert reports.label_counts(out.withColumn("path", F.lit("f"))).first().asDict() == {"path": "f", "meaningful": 1, "trivial": 1, "missing": 1, "unknown": 1, "readings": 4}


def test_snippet_tiers(spark):
    entries = spark.createDataFrame([("d1", "a1", 0, "abcdefghijklm", "reading"), ("d1", "a2", 1, "other", "reading"), ("d1", "a3", 2, "lemma", "x")], "div_id string, app_id string, ord int, lem string, rdg string")
    s = spark.createDataFrame([(1, "d1", "abcdefghijklmn", None), (2, "d1", "Reading.", ""), (3, "d1", "", "<rdg wit='x'>lemma</rdg>"), (4, "d2", "x", ""), (5, "", "x", '<app xml:id="q">')],
                              "id int, locus string, rdg_text string, stub string")
    got = {r.id: (r.app_id, r.reason, r.candidate_app_ids) for r in curate.resolve_snippets(s, entries).collect()}
    assert got == {1: ("a1", "", ""), 2: ("", "ambiguous (rdg_exact)", "a1,a2"), 3: ("a3", "", ""), 4: ("", "no match in div", ""), 5: ("q", "", "")}


def test_distance_matrix(spark):
    f = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("c", 9)], "witness string, feature int")
    m = reports.distance_matrix(reports.witness_distances(f), ["a", "b", "c"])
    assert {r.wit_a: (r.a, r.b, r.c) for r in m.collect()} == {"a": (0, 0.5, 1), "b": (0.5, 0, 1), "c": (1, 1, 0)}


def test_sql_functions(spark):
    udfs.register(spark)
    assert spark.sql("select gestalt_ratio('diet', 'tide')").first()[0] == 0.5
    assert spark.sql("select size(align_dp(array('ab','cd'), array('abcd')))").first()[0] == 1
    assert spark.sql("select word from alto_words(cast('<a><TextLine><String CONTENT=\"x\"/></TextLine></a>' as binary))").first()[0] == "x"


def test_readings_from_snippets_are_added_once(spark):
    s = spark.createDataFrame([("a1", "#w1", "x", "b for c"), ("a1", "#w2", "y", "q→r"), ("zz", "#w1", "x", "b for c")], "app_id string, wit_list string, rdg_text string, feature string")
    flags = ", ".join(f"{f} boolean" for f in ("orthography_match", "punct_penalty_applied", "singleton_demoted", "lexical_whitelist_applied", "unstable"))
    scores = spark.createDataFrame([("b→c", "variant", 0.9, 3, *[False] * 5)], f"feature string, label string, variant_likelihood double, doc_freq int, {flags}")
    there = spark.createDataFrame([("a1", "#w0", None, None)], "app_id string, wit string, resp string, n string")
    got = cascade.readings_from_snippets(s, scores, there)
    assert {(r.wit, r.cert, r.ana, r.n) for r in got.collect()} == {("#w1", "0.900", "#meaningful", "b→c"), ("#w2", "0.500", "#unknown", "q→r")}
    again = there.union(got.select("app_id", "wit", "resp", "n"))
    assert cascade.readings_from_snippets(s, scores, again).count() == 0
