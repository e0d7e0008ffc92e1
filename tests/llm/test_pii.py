import random

from variorum.llm import pii

from .brute import base_spans, joined, sha

CASES = [
    None, "", "no data", "mail a.b@c.de_x@y.zz. and a@b", "1.2.3.4.5.6.7.8", "1..2.3.4.5 256.1.1.1 0001.2.3.255",
    "4111 1111 1111 1111 and 4111-1111-1111-1112", "0 " * 4000 + "4111111111111111", "7" * 30000, "+49 (30) 123.456-78 x +1((((",
    "\U0001f600é a@b.co \U0001f600 +4930123456789", "x" * 60000 + "@y.z" + ".a" * 9000, "DE89 3704 0044 0532 0130 00", "ssn 078-05-1120, 078-05-1121",
]


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(3)
    texts = CASES + ["".join(rng.choice("01234567899. -+()@ab.é\n") for _ in range(400)) for _ in range(200)]
    got = {r.doc_id: r for r in pii.pii_documents(rows(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert got[i].base_sha256 == sha(joined(want)), t and t[:200]
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in want) for k in pii.BASE]
        assert got[i].spans.startswith(joined(want))


def test_added_kinds_and_redaction(spark):
    found = pii.find_pii(rows(spark, CASES))
    got = {r.doc_id: r for r in pii.redact(found).collect()}
    assert [s.kind for s in got[12].pii] == ["iban"]
    assert [s.kind for s in got[13].pii] == ["ssn"]  # the second has no context word near it
    assert got[13].text == "ssn <SSN>, 078-05-1121"
    assert got[0].text is None and got[1].text == "" and got[2].text == "no data"
    assert got[10].text == "\U0001f600é <EMAIL> \U0001f600 <PHONE>"
    assert not pii.find_pii(rows(spark, [])).collect()


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in pii.pii_documents(docs).collect()}
    for r in docs.collect():
        assert got[r.doc_id].base_sha256 == sha(joined(base_spans(r.text)))


def test_many_spans_in_one_text_take_linear_time(spark):
    import time

    n = 64_000
    text = " ".join(f"a{i}@b.co" for i in range(n))
    took = {}
    for part in (n // 8, n):
        t = " ".join(text.split(" ")[:part])
        began = time.time()
        got = pii.redact(pii.find_pii(rows(spark, [t]))).collect()[0]
        took[part] = time.time() - began
        assert len(got.pii) == part and got.text == " ".join(["<EMAIL>"] * part)
        assert [(s.start, s.end) for s in got.pii] == [(a, b) for _, a, b in base_spans(t)]
    assert took[n] < 30


def test_context_words_stand_whole_on_either_side(spark):
    far = "x" * pii.CONTEXT_CHARS
    cases = {
        "host 1.2.3.4": 1.0, "hostile 1.2.3.4": 0.8, "ghost 1.2.3.4": 0.8, "1.2.3.4 is the server": 1.0, "1.2.3.4 servers": 0.8, "ip1.2.3.4": 1.0,
        "lorem ipsum 1.2.3.4": 0.8, "hôst ip\n1.2.3.4": 1.0, f"ip {far} 1.2.3.4": 0.8, f"1.2.3.4 {far} ip": 0.8, f"ip{'.' * (pii.CONTEXT_CHARS - 2)}1.2.3.4": 1.0,
        f"xip{'.' * (pii.CONTEXT_CHARS - 2)}1.2.3.4": 0.8, f"1.2.3.4{' ' * (pii.CONTEXT_CHARS - 2)}ipx": 0.8, f"1.2.3.4{' ' * (pii.CONTEXT_CHARS - 2)}ip": 1.0,
        "tell +4930123456789": 0.8, "tel +4930123456789": 1.0, "1.2.3.4 x 5.6.7.8 host": 0.8,
    }
    got = {r.doc_id: r.pii[0].score for r in pii.find_pii(rows(spark, cases)).collect()}
    assert {t: got[i] for i, t in enumerate(cases)} == cases


def test_redaction_equals_brute_force(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("012.+ @ab.é") for _ in range(3000)) for _ in range(20)]
    for r in pii.redact(pii.find_pii(rows(spark, texts))).collect():
        out, pos = [], 0
        for s in sorted(r.pii, key=lambda s: (s.start, s.end, s.kind)):
            if s.start >= pos:
                out += [texts[r.doc_id][pos : s.start], f"<{s.kind.upper()}>"]
            pos = max(pos, s.end)
        assert r.text == "".join(out) + texts[r.doc_id][pos:]


def test_clashing_columns_stay(spark):
    df = spark.createDataFrame([("a@b.co", "T", "r", "p", "e")], "text string, t string, row string, PII string, email string")
    got = pii.redact(pii.find_pii(df)).collect()[0]
    assert (got.text, got.t, got.row, got.email, got.pii[0].kind) == ("<EMAIL>", "T", "r", "e", "email")


def test_empty_table(spark):
    assert not pii.pii_documents(spark.createDataFrame([], "doc_id long, text string")).collect()
