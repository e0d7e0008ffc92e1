import json

import pytest
from pyspark.sql import functions as F

from variorum.operators import segments
from variorum.plans import collate
from variorum.sources import config, sinks, tables, xml

LEMMA = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><div xml:id="Y9"><ab xml:id="Y9.1">frā. mąm. aa<lb break="no"/>bb cc<lb/>dd <note>no</note><app><rdg type="mod">new</rdg><rdg type="orig">old</rdg></app> <seg>end</seg></ab><ab xml:id="head9Y9">title words</ab><ab xml:id="X1">other</ab></div>
<div xml:id="Z1"><ab xml:id="Y9.9">elsewhere</ab></div></text></TEI>"""
WITNESS = """<TEI><div xml:id="d"><ab xml:id="Y9.1">frāmąm. aabb cc dd old end</ab><ab n="head9Y9">titel words</ab><ab xml:id="pre-Y9.2-post">inside</ab></div></TEI>"""


@pytest.fixture
def files(tmp_path):
    for name, text in {"lemma/L.xml": LEMMA, "wit/5.xml": WITNESS, "wit/bad.xml": "<a><b></a>"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    return tmp_path


def test_segments_by_name_and_remap(spark, files):
    lemma = segments.lemma_segments(xml.read_segments(spark, str(files / "lemma")), ["Y9"])
    got = {r.ab_id: r.text for r in lemma.collect()}
    assert got == {"Y9.1": "frā. mąm. aabb cc dd old end", "head9Y9": "title words"}
    elements = xml.read_segments(spark, str(files / "wit"))
    wanted = spark.createDataFrame([("Y9.1",), ("head9Y9",), ("Y9.2",), ("nowhere",), ("moved",)], "ab_id string")
    remap = spark.createDataFrame([("#ms0005", "moved", "Y9.1")], config.REMAP)
    found = {r.ab_id: r.text for r in segments.witness_segments(elements, wanted, remap).collect()}
    assert found == {"Y9.1": "frāmąm. aabb cc dd old end", "head9Y9": "titel words", "Y9.2": "inside", "moved": "frāmąm. aabb cc dd old end"}


def test_apparatus_from_files_and_back(spark, files):
    rows = collate.apparatus_of_files(spark, str(files / "lemma"), [str(files / "wit")], ["Y9"], [], [])
    got = {(r.ab_id, r.a, r.b): (r.lem, r.rdg, r.type) for r in rows.collect()}
    assert got["Y9.1", 0, 2] == ("frā. mąm.", "frāmąm.", "trivial") and got["head9Y9", 0, 1][1] == "titel"
    apps = sinks.app_xml(rows.select(F.lit("Y9").alias("doc"), F.col("a").alias("ord"), "app_id", "lem", F.col("witness").alias("wit"), "rdg", "type"))
    sinks.write_tei(apps, str(files / "out"), "apparatus_Y9")
    text = "".join(p.read_text() for p in (files / "out").glob("doc=Y9/*.txt"))
    (files / "again").mkdir()
    (files / "again" / "a.xml").write_text(text)
    back = {(r.app_id, r.lem, r.wit, r.rdg, r.type) for r in xml.read_apparatus(spark, str(files / "again")).collect()}
    assert back == {(r.app_id, r.lem, r.witness, r.rdg, r.type) for r in rows.collect()}


def test_stanzas(spark, tmp_path):
    (tmp_path / "s.xml").write_text(
        '<r><div xml:id="Y1.1"><ab>Foo, <app><rdg type="orig">old</rdg><rdg type="mod">new</rdg></app> ba<lb break="no"/>r <lb/>1-2 x.y<foreign>gone</foreign></ab>'
        '<ab xml:lang="pahl">skip</ab><ab n="Nerang 2">skip</ab></div><div xml:id="Y1.2">no ab here</div></r>'
    )
    got = {r.xml_id: r.words for r in xml.read_stanzas(spark, str(tmp_path), True).collect()}
    assert got == {"Y1.1": ["foo", "new", "bar", "x.", "y"], "Y1.2": ["no", "ab", "here"]}


def test_alto_cab_text(spark, tmp_path):
    for k, word in (("p1", "one.two"), ("p2", "three")):
        (tmp_path / f"{k}.xml").write_text(f'<alto><TextLine><String CONTENT=""/><String CONTENT="{word}"/><String CONTENT="x"/></TextLine></alto>')
    got = [(r.page, r.line, r['index'], r.word) for r in xml.read_alto(spark, str(tmp_path)).orderBy("page", "seq").collect()]
    assert got == [("p1.xml", 0, 0, "one"), ("p1.xml", 0, 1, "two"), ("p1.xml", 0, 2, "x"), ("p2.xml", 0, 0, "three"), ("p2.xml", 0, 1, "x")]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "c.xml").write_text('<r><ab xml:id="a1">wo<lb break="no"/>rd a.b</ab></r>')
    assert [(r.id, r['index'], r.word) for r in xml.read_cab(spark, str(tmp_path / "c")).orderBy("seq").collect()] == [("a1", 0, "word"), ("a1", 1, "a"), ("a1", 2, "b")]
    (tmp_path / "t.txt").write_text("a b.\n\nc")
    assert [(r.line, r['index'], r.word) for r in xml.read_ocr_text(spark, str(tmp_path / "t.txt")).orderBy("line", "index").collect()] == [(0, 0, "a"), (0, 1, "b"), (2, 0, "c")]


def test_configuration(spark, tmp_path):
    (tmp_path / "p.yaml").write_text('rules:\n- {match: "a→b", label: Trivial, groups: [X]}\n- {match_regex: "c", label: meaningful}\n- {label: x}\ndefault_nontrivial_label: ""\n')
    rules, default = config.rules(str(tmp_path / "p.yaml"))
    assert [(r["ord"], r["kind"], r["label"], r["groups"]) for r in rules] == [(0, "match", "trivial", ["X"]), (1, "match_regex", "meaningful", [])] and default == ""
    assert config.rules_frame(spark, rules).count() == 2 and config.rules(None) == ([], "") and config.families("/nowhere") == []
    (tmp_path / "f.yaml").write_text("families:\n  a:\n    compare_only_regex: [x]\n    nested:\n      patterns: [y]\n")
    assert [f["family"] for f in config.families(str(tmp_path / "f.yaml"))] == ["a"]
    assert [f["family"] for f in config.families(str(tmp_path / "f.yaml"), strict=False)] == ["a", "nested"]
    (tmp_path / "g.yaml").write_text("groups: {A: [ms1, ms2], B: [ms1]}\nwitnesses: {ms1: {x: y}}\n")
    assert config.witness_groups(spark, str(tmp_path / "g.yaml")).count() == 3 and config.id_remap(spark, str(tmp_path / "g.yaml")).first()[2] == "y"
    (tmp_path / "w.txt").write_text("# no\nfrā\n\n")
    assert config.whitelist(str(tmp_path / "w.txt")) == ["frā"] and config.whitelist(None) == []


def test_scores_first_file_wins(spark, tmp_path):
    (tmp_path / "1.csv").write_text("feature,variant_likelihood,orthography_match?,doc_freq\na for b,0.9,True,3\n")
    (tmp_path / "2.csv").write_text("feature,variant_likelihood,label\na→b,0.1,reading\nc,x,variant\n")
    got = {r.feature: r for r in tables.read_scores(spark, [str(tmp_path / "1.csv"), str(tmp_path / "2.csv")]).collect()}
    assert got["a→b"].variant_likelihood == 0.9 and got["a→b"].orthography_match and got["c"].variant_likelihood == 0.5 and got["c"].doc_freq == 0


def test_matches_and_lineage(spark, tmp_path):
    rows = [{"canon_index": 1, "our_index": None, "relation": "delete", "matched": False}, {"canon_indexes": [1, 2], "our_index": 0, "relation": "many-to-one (merged)", "matched": True}]
    (tmp_path / "m.json").write_text(json.dumps(rows))
    got = tables.read_matches(spark, str(tmp_path / "m.json"))
    assert sorted((r.canon_indexes, r.our_indexes) for r in got.collect()) == [([1], []), ([1, 2], [0])]
    line = sinks.lineage(got, str(tmp_path / "m.json"), "test").first()
    import hashlib

    assert line.row_count == 2 and line.source_sha256 == hashlib.sha256((tmp_path / "m.json").read_bytes()).hexdigest()


def test_corpus_ids_and_layout(spark):
    df = spark.createDataFrame([("Y", "009.010"), ("Y", "3")], "p string, n string")
    assert sorted(r[0] for r in df.select(tables.corpus_id(F.col("p"), F.col("n"))).collect()) == ["Y3", "Y9.10"]
    pairs = spark.createDataFrame([("g", 0, "ab", "abcd")], "g string, i int, l string, r string")
    assert sinks.side_by_side(pairs, "g", "i", "l", "r").first().text == "ab  \tabcd"


def test_chains_of_pages(spark, tmp_path):
    """Chains of several lengths, a branch, a ring, a page of its own, a link to nowhere."""
    links = [(f"a{i}", f"a{i + 1}") for i in range(37)] + [("a37", None), ("b0", "b1"), ("b1", "gone"), ("c1", "c2"), ("c2", "c0"), ("c0", "c1"), ("d", "d"), ("e", None), ("x", "a30")]
    df = spark.createDataFrame(links, "url string, next string")
    got = {r.url: (r.first, r.place) for r in tables.chained(df).collect()}
    want = {f"a{i}": ("a0", i) for i in range(38)} | {"b0": ("b0", 0), "b1": ("b0", 1), "d": ("d", 0), "e": ("e", 0), "x": ("x", 0)}
    assert got == want
    assert {r.url: r.place for r in tables.walked(df, "a5").collect()} == {f"a{i}": i - 5 for i in range(5, 38)}
    assert {r.url: r.place for r in tables.walked(df, "x").collect()} == {"x": 0} | {f"a{i}": i - 29 for i in range(30, 38)}
    assert {r.url: r.place for r in tables.walked(df, "c2").collect()} == {"c2": 0, "c0": 1, "c1": 2}
    assert not tables.walked(df, "none").collect() and not tables.chained(df.limit(0)).collect()
    pages = [{"url": "p", "next": "q", "results": [{"prefix": "Y", "number": "9.010", "text": "one"}]}, {"url": "q", "next": "p", "results": []}]
    (tmp_path / "p.json").write_text("".join(json.dumps(x) + "\n" for x in pages))
    assert [tuple(r) for r in tables.read_corpus(spark, str(tmp_path), "q").collect()] == [(1, "Y9.10", 0, "one")]


def test_configuration_of_many_files(spark):
    good = 'rules:\n- {match: "a→b", label: Trivial, groups: [X]}\n- {label: x}\ngroups: {A: [ms1, 2]}\nwitnesses: {ms1: {x: y}}\nfamilies:\n  a:\n    compare_only_regex: [x]\n'
    files = spark.createDataFrame([("g", good.encode()), ("bad", b"rules: [\n"), ("list", b"- a"), ("none", None)], "path string, content binary")
    assert [(r.path, r.ord, r.label, r.groups, r.otherwise) for r in config.rules_of(files).collect()] == [("g", 0, "trivial", ["X"], "")]
    assert sorted((r.witness, r.grp) for r in config.groups_of(files).collect()) == [("2", "A"), ("ms1", "A")]
    assert [tuple(r) for r in config.remap_of(files).collect()] == [("g", "ms1", "x", "y")]
    assert [(r.ord, r.family, r.patterns, r.compare_only) for r in config.families_of(files).collect()] == [(0, "a", [], ["x"])]
    words = spark.createDataFrame([("w", b"# no\nfr\xc4\x81\n\n")], "path string, content binary")
    assert [tuple(r) for r in config.whitelists_of(words).collect()] == [("w", "frā")]
