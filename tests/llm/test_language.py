import numpy as np
import pytest

from variorum.llm import language as L


def test_features_of_long_text_do_not_depend_on_parts():
    t = "abç dé " * 400_000
    v = L.features(t)
    assert abs(np.linalg.norm(v) - 1) < 1e-4
    assert np.allclose(v, L.features(t[: 7 * 1000]), atol=0.02)
    assert L.features(None) is None and L.features("12 _ !") is None


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in L.identify_documents(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    held = [r for r in rows if got[r.doc_id].held_out]
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.97
    import zlib

    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


@pytest.mark.parametrize("langs", [[], ["xx"], ["xx", "yy"], ["en", "de", "qq"]])
def test_few_languages_and_odd_texts(spark, langs):
    base = {"xx": "bab aba ", "yy": "kok oko ", "en": "the thing ", "de": "schön ist ", "qq": "zuz uzu "}
    rows = [(i, base[v] * (1 + i % 9), v) for v in langs for i in range(20)]
    rows += [(100, None, "en"), (101, "", None), (102, "123 !!", "de"), (103, "bab", None), (None, "bab aba", "xx")]
    out = L.identify_documents(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string"))
    got = out.collect()
    assert len(got) == len(rows) and out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id >= 100}
    assert [by[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3
    assert all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    if langs:
        assert by[103].lang_pred in langs


def plain_features(text):
    """The same n-grams, one by one, with Python's numbers."""
    import re
    from collections import Counter

    letters = re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip()
    if not letters:
        return None
    m1, m2, m3, top = 2654435761, 2246822519, 3266489917, 2**32
    counts = Counter()
    c = [ord(x) for x in f" {letters} "]
    for i in range(len(c)):
        counts[(c[i] * m1 % top) >> 20] += 1
        if i + 1 < len(c):
            two = ((c[i] * m1 % top) ^ (c[i + 1] * m2 % top)) * m1 % top
            counts[two >> 20] += 1
        if i + 2 < len(c):
            counts[((two ^ (c[i + 2] * m3 % top)) * m2 % top) >> 20] += 1
    size = sum(counts.values()) ** 0.5
    return {k: n**0.5 / size for k, n in counts.items()}


def plain_prediction(model, text):
    """Family by the largest share of the heads' chances, then the language of the largest product of its pairs' chances."""
    import math

    x = plain_features(text)
    if x is None:
        return "und", 0.0
    sure = []
    for w, scale in zip(model.weights.astype(float), model.scale, strict=True):
        margin = (sum(w[k] * v for k, v in x.items()) + w[-1]) * scale
        sure.append(1 / (1 + math.exp(-max(-30, min(30, margin)))))
    nf = len(model.families) if len(model.families) > 1 else 0
    share = [p / sum(sure[:nf]) for p in sure[:nf]] or [1.0]
    best = max(range(len(share)), key=lambda i: share[i])
    family = model.families[best]
    wins = dict.fromkeys(model.members[family], 1.0)
    for k, (fam, a, b) in enumerate(model.pairs):
        if fam == family:
            wins[a] *= sure[nf + k]
            wins[b] *= 1 - sure[nf + k]
    lang = max(wins, key=lambda v: wins[v])
    return lang, share[best] * wins[lang] / sum(wins.values())


def test_predictions_equal_brute_force(spark, sf):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    model = L.fit(docs.where(~L.held_out(F.col("doc_id"), 1, 3)))
    got = {r.doc_id: r for r in L.identify_documents(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows) and len(model.pairs) >= 1
    for r in rows:
        lang, score = plain_prediction(model, r.text)
        assert got[r.doc_id].lang_pred == lang and abs(got[r.doc_id].score - score) < 1e-4


def test_clashing_columns_and_too_many_languages(spark):
    rows = [(i, "the thing " * 9, "en", "own", 7.0) for i in range(30)] + [(90, "la chose ici " * 9, None, "own", 7.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    kept = L.keep_identified(docs).collect()
    assert {(r.lang_pred, r.score) for r in kept} == {("own", 7.0)} and all(r.lang for r in kept)


def test_any_number_of_languages(spark):
    """Six hundred values of lang, one of them in half of the rows: the sample stays bounded, all texts are predicted."""
    rows = [(i, f"word{i % 600} sits near place{i % 600}", f"l{i % 600:03}") for i in range(1800)] + [(i, f"the cat number {i} sat", "en") for i in range(5000, 6800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs, per_lang=20, sample=60, most_langs=5)
    assert sorted(v for m in model.members.values() for v in m) == ["en", "l000", "l001", "l002", "l003"]
    got = L.predict(docs, model).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got} <= {"en", "l000", "l001", "l002", "l003"}
    assert sum(r.lang_pred == "en" for r in got if r.lang == "en") > 1700


def test_sample_is_bounded_whatever_the_ids(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(L, "train", lambda x, langs: seen.append(len(langs)) or L.Model())
    rows = [(None, f"the cat number {i} sat here", "en") for i in range(900)] + [(7, f"le chat {i} est ici", "fr") for i in range(900)] + [(8, "copied text", "nl")] * 900
    L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=100)
    assert 2 * 120 < seen[0] < 2 * 280


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    got = L.identify_documents(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and not got.collect() and not L.keep_identified(docs).collect()
