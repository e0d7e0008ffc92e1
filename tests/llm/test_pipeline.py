import hashlib
from collections import Counter

import corpus_pipeline as P
from variorum.llm import bpe
from variorum.llm.common import materialize

from .brute import base_spans, jaccard5, similar_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(P.STAGES)
    raw = docs.collect()
    known = materialize(stages["language_id"](spark, docs, sf))
    assert known.columns == COLUMNS and known.count() >= 0.995 * len(raw)
    rows = {r.doc_id: r for r in known.collect()}

    ids = sorted(rows)
    want, links = similar_components([(i, rows[i].text) for i in ids])
    single = materialize(stages["simhash_dedup"](spark, known, sf))
    left = sorted(r.doc_id for r in single.collect())
    assert left == sorted({ids[k] for k in want.values()})
    assert links and all(jaccard5(rows[ids[a]].text, rows[ids[b]].text) >= 0.8 for a, b in links)

    clean = materialize(stages["pii"](spark, single, sf))
    got = {r.doc_id: r for r in clean.collect()}
    assert len(got) == single.count()
    for i, r in got.items():
        assert not [s for s in base_spans(r.text) if s[0] != "ip"] or base_spans(rows[i].text)
        if not base_spans(rows[i].text) and "<IBAN>" not in r.text and "<SSN>" not in r.text:
            assert r.text == rows[i].text
        assert r.n_chars == len(r.text)

    mixed = materialize(stages["mix_sources"](spark, clean, sf))
    copies = Counter(r.doc_id for r in mixed.collect())
    assert max(copies.values()) <= 2 and mixed.columns == COLUMNS
    words = lambda t: len(t.split())
    total = sum(words(r.text) for r in got.values())
    assert abs(sum(n * words(got[i].text) for i, n in copies.items()) / total - 1.5) < 0.1

    out = stages["bpe"](spark, mixed, sf).collect()
    enc = bpe.encoding(bpe.RANKS)
    assert Counter(r.doc_id for r in out) == copies
    for r in out:
        t = got[r.doc_id].text
        assert r.ids == enc.encode_ordinary(t) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_odd_rows(spark):
    rows = [(1, None, "en", "s", 0), (2, "", None, "s", 0), (3, "12 34", "en", None, 5), (None, "the cat sat here", "en", None, 4)]
    rows += [(4, "the dog sat there again", None, "t", 9)] * 3 + [(5, "le chien est ici encore", "fr", "t", 9), (5, "another text by the same id", "en", "t", 9)]
    rows += [(6, "mail a@b.co now " * 9000, "en", "t", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES[:-1]:
        docs = materialize(stage(spark, docs, ""))
        assert docs.columns == COLUMNS
        got = Counter(r.doc_id for r in docs.collect())
        assert not {1, 2, 3} & set(got) and all(r.lang for r in docs.collect())
    assert all("@" not in r.text for r in docs.collect())
    assert P.STAGES[-1][1](spark, docs, "").count() == docs.count()
    none = spark.createDataFrame([], docs.schema)
    for _, stage in P.STAGES:
        none = materialize(stage(spark, none, ""))
        assert none.count() == 0


def test_extra_columns_with_clashing_names(spark):
    extra = "id string, row string, _row string, pii string, score string, size string, target string, hash string, c0 string, lang_pred string, copies string, r string, fp string, f0 string, component_id string, kept_id string, _kept_id string, _copy string"
    names = [x.split()[0] for x in extra.split(", ")]
    rows = [(i, f"the cat number {i} sat here with a@b.co and looked at the rain over the old town", "en", "s", 9, *names) for i in range(6)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    columns = docs.columns
    for _, stage in P.STAGES[:-1]:
        docs = materialize(stage(spark, docs, ""))
        assert docs.columns == columns and docs.count()
        assert all([r[n] for n in names] == names for r in docs.collect())
    assert {r.n_chars == len(r.text) and "<EMAIL>" in r.text for r in docs.collect()} == {True}
    assert P.STAGES[-1][1](spark, docs, "").count() == docs.count()
