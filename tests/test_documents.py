"""Damaged files, order across segments and tasks, the merged store, milestones."""

from pathlib import Path
from xml.etree import ElementTree

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from variorum.operators import order
from variorum.plans import collate
from variorum.sources import repair, sinks, store, xml

BROKEN = [
    ("<r><a><b>x</a><c/></r>", "<r><a><b>x</b></a><c /></r>", ["unclosed element"]),
    ("<r><a></r></a></r>", "<r><a /></r>", ["unclosed element", "stray end tag", "stray end tag"]),
    ("<r>a & b < c &foo; &#65;</b>d</r>", "<r>a &amp; b &lt; c &amp;foo; Ad</r>", ["bare &", "bare <", "unknown entity", "stray end tag"]),
    ("<r>\n<a x=1 x='2' y>t</r", '<r>\n<a x="1" y="">t</a></r>', ["value without quotes", "repeated attribute", "attribute without a value", "unfinished tag", "unclosed element"]),
    ("<r><a <b>x</b></a></r>", "<r><a><b>x</b></a></r>", ["unfinished tag"]),
    ("<r><p:a q:k='v'/></r>", '<r><a k="v" /></r>', ["undeclared prefix", "undeclared prefix"]),
    ("<r/> tail<x/>", "<r> tail<x /></r>", ["content after the root"]),
    ("x<r><!-- open <a>x</a></r>", "<r>&lt;!-- open <a>x</a></r>", ["text before the root", "bare <"]),
    ("<r>\x01a</r>", "<r>a</r>", ["forbidden character"]),
    ("<r><a>cut", "<r><a>cut</a></r>", ["unclosed element", "unclosed element"]),
]


@pytest.mark.parametrize("text, want, kinds", BROKEN)
def test_repairs(text, want, kinds):
    root, notes = repair.repaired(text.encode())
    assert ElementTree.tostring(root, encoding="unicode") == want and [k for k, _ in notes] == kinds


def test_lines_encodings_and_nothing_to_read():
    assert repair.repaired(b"<r>\n\n<a>\r\n</b>\r</c></a></r>")[1] == [("stray end tag", 4), ("stray end tag", 5)]
    assert repair.repaired('<?xml version="1.0" encoding="latin-1"?><r>é</q></r>'.encode("latin-1"))[0].text == "é"
    root, notes = repair.repaired(b"<r>\xff</r>")
    assert root.text == "�" and notes == [("undecodable bytes", 1)]
    assert [repair.tree(x) for x in (None, b"", b"no element")] == [None] * 3


def _sound(children):
    texts = st.sampled_from(["t &amp; u", "&#955;", "\n ", "<c/>", "<!-- x -->", "<![CDATA[<&]]>", "<?pi x?>"])
    tags = children.map(lambda c: f'<a x="1 &gt; 2" p:y=\'q\'>{c}</a>') | children.map(lambda c: f'<b xmlns="q">{c}</b >')
    return st.lists(texts | tags, max_size=5).map("".join)


@settings(deadline=None)
@given(st.recursive(st.just("x"), _sound, max_leaves=20))
def test_sound_files_read_as_by_the_strict_parser(body):
    text = f'<?xml version="1.0"?><!DOCTYPE r [<!ELEMENT r ANY>]><r xmlns:p="u" p:k="v">{body}</r>\n'.encode()
    root, notes = repair.repaired(text)
    assert not notes and ElementTree.tostring(root) == ElementTree.tostring(ElementTree.fromstring(text))


@settings(deadline=None)
@given(st.text("<>/&;ab=\"' !-[]?#x", max_size=60))
def test_any_text_is_read(text):
    root, _ = repair.repaired(f"<r>{text}".encode())
    assert root is not None and root.tag == "r"


def test_broken_witness_is_read_and_named(spark, tmp_path):
    (tmp_path / "7.xml").write_text('<TEI><div xml:id="d"><ab xml:id="Y1.1">one & two</hi><ab xml:id="Y1.2">three</div></TEI>')
    found = {r.key: r.text for r in xml.read_segments(spark, str(tmp_path)).where("kind = 'xml:id'").collect()}
    assert found["Y1.2"] == "three" and found["Y1.1"].startswith("one & two")
    (named,) = xml.read_unparsed(spark, str(tmp_path)).collect()
    assert named.error.startswith("not well-formed") and [r.kind for r in named.repairs] == ["bare &", "stray end tag", "unclosed element", "unclosed element"]


@pytest.mark.parametrize("doc", [[], ["doc"]])
def test_neighbours_over_many_ranges(spark, doc):
    rows = [(None if i % 300 > 280 else i // 300, i % 300, None if i % 7 == 0 else i) for i in range(900)]
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    rows = [(d, k, v) for k, (d, _, v) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc long, place long, v long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.place: (r.before, r.after) for r in order.neighbours(df, doc, ["place"], "v").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    near = lambda k, j: rows[j][2] if 0 <= j < len(rows) and (not doc or rows[j][0] == rows[k][0]) else None
    assert got == {k: (near(k, k - 1), near(k, k + 1)) for k in range(len(rows))}
    assert not order.neighbours(df.limit(0), doc, ["place"], "v").collect()


def test_merge_across_the_end_of_a_segment(spark):
    """The last word of a segment run together with the first of the next is a spacing merge."""
    lemma = spark.createDataFrame([("s2", 2, "mąm"), ("s1", 1, "aa frā")], "ab_id string, ord int, text string")
    wits = spark.createDataFrame([("w", "s1", "aa frāmąm"), ("w", "s2", "x")], "witness string, ab_id string, text string")
    got = {(r.ab_id, r.lem): (r.rdg, r.type) for r in collate.tagged_apparatus(lemma, wits, [], []).collect()}
    assert got["s1", "frā"] == ("frāmąm", "trivial") and got["s2", "mąm"][0] == "x"
    apart = collate.tagged_apparatus(lemma.withColumn("path", F.col("ab_id")), wits, [], []).collect()
    assert {(r.ab_id, r.lem): r.type for r in apart}["s1", "frā"] == "meaningful"


def _times(root: Path) -> dict[str, tuple]:
    return {str(p.relative_to(root)): (p.stat().st_mtime_ns, p.stat().st_size) for p in root.rglob("*.parquet")}


def test_merge_leaves_other_files_alone(spark, tmp_path):
    path = tmp_path / "store"
    one = spark.range(4000).select(F.concat(F.lit("w"), F.col("id") % 40).alias("witness_id"), F.concat(F.lit("s"), F.col("id") % 90).alias("stanza_id"), F.col("id").alias("our_index"), F.lit("a").alias("word"))
    store.merge_alignments(one, str(path), ["word"])
    before = _times(path)
    more = [("new", "s1", 1, "b", 7), ("w3", "s3", 3, "c", 8), ("w3", "s3", 3, "b", 9), ("w3", None, 3, "n", 1), ("w3", None, 3, "n", 1)]
    store.merge_alignments(spark.createDataFrame(more, "witness_id string, stanza_id string, our_index long, word string, note int"), str(path), ["word"])
    after = _times(path)
    kept = [k for k in before if after.get(k) == before[k]]
    # two witnesses, and of each one bucket for every stanza (and the null one)
    assert len(before) - len(kept) <= 3 and len(kept) > 100
    rows = {(r.witness_id, r.stanza_id, r.our_index): (r.word, r.note) for r in store.read_alignments(spark, str(path)).collect()}
    assert len(rows) == 4000 + 2 and rows["w3", "s3", 3] == ("c", 8) and rows["new", "s1", 1] == ("b", 7) and rows["w0", "s0", 0] == ("a", None)
    store.merge_alignments(spark.createDataFrame(more[3:], "witness_id string, stanza_id string, our_index long, word string, note int"), str(path), ["word"])
    assert store.read_alignments(spark, str(path)).where("stanza_id is null").count() == 4
    w3 = store.read_witness(spark, str(path), "w3")
    assert w3.count() == 100 + 4 and "PartitionFilters: [isnotnull(bucket" in w3._jdf.queryExecution().toString()


def test_milestones_stand_between_words(spark):
    files = spark.createDataFrame([("f", b'<TEI xmlns="u"><ab xml:id="x">old <hi>gone</hi></ab><ab xml:id="y"/><ab xml:id="z">stays</ab></TEI>')], "path string, content binary")
    words = [("f", "x", 0, "p1", 0, "a"), ("f", "x", 1, "p1", 0, "b"), ("f", "x", 2, "p1", 1, "c"), ("f", "y", 3, "p1", 1, "d"), ("f", "y", 4, "p2", 1, "e<"), ("f", "none", 5, "p2", 3, "lost")]
    df = spark.createDataFrame(words, "path string, ab_id string, seq long, page string, line int, word string")
    text = sinks.paged_segments(files, df).first().content.decode()
    assert text.replace("ns0:", "").partition("<ab")[2] == ' xml:id="x"><pb n="p1" /><lb n="1" /> a b<lb n="2" /> c</ab><ab xml:id="y"> d<pb n="p2" /> e&lt;</ab><ab xml:id="z">stays</ab></TEI>'
    back = [(r.id, r.page, r.line, r.word) for r in xml.paged_of(sinks.paged_segments(files, df)).orderBy("seq").collect()]
    assert back == [("x", "p1", "1", "a"), ("x", "p1", "1", "b"), ("x", "p1", "2", "c"), ("y", "p1", "2", "d"), ("y", "p2", "2", "e<"), ("z", "p2", "2", "stays")]


def test_ranges_grow_in_number_not_in_size(spark):
    from variorum.operators import order

    rows = spark.range(600).select((F.col("id") % 2).alias("doc"), "id")
    out = order.neighbours(rows, ["doc"], ["id"], "id", most=20)
    assert out.rdd.getNumPartitions() >= 30
    assert {(r.id, r.before, r.after) for r in out.collect()} == {(i, i - 2 if i > 1 else None, i + 2 if i < 598 else None) for i in range(600)}


def test_segments_are_found_without_a_grid(spark):
    """Witnesses times ids made the table grow with its square; ids inside keys are found by equality of parts."""
    from variorum.operators import segments

    e = spark.createDataFrame(
        [("w1", "xml:id", "A1", 0, "own"), ("w1", "ab", "A1", 0, "own"), ("w2", "ab", "xA1 A2y", 3, "inside"), ("w2", "ab", "A1", 5, "later"), ("w3", "n", "B", 1, "moved"), ("w3", "ab", "A1", 2, "not asked")],
        "witness string, kind string, key string, place int, text string",
    )
    wanted = spark.createDataFrame([("A1",), ("A2",), ("zz",)], "ab_id string")
    remap = spark.createDataFrame([("w3", "A1", "B"), ("w9", "A1", "B"), ("w1", "other", "A1")], "witness string, ab_id string, lookup_id string")
    out = segments.witness_segments(e, wanted, remap)
    assert "Cartesian" not in out._jdf.queryExecution().executedPlan().toString() and "Join Cross" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in out.collect()} == {("w1", "A1", "own"), ("w2", "A1", "inside"), ("w2", "A2", "inside"), ("w3", "A1", "moved")}
