import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from variorum.llm import token_counts as T

LIBRARY = {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}


def brute(text, name=T.VOCABULARY):
    return len(LIBRARY[name].encode(text or "", add_special_tokens=False).ids)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in T.token_counts_of_documents(docs.repartition(5)).collect()}
    for r in docs.collect():
        g, n = got.pop(r.doc_id), brute(r.text)
        assert (g.n_bytes, g.n_tokens, g.over_limit) == (len((r.text or "").encode()), n, n > 2048)
    assert not got


ODD = [None, "", " \n\t", "a", "It'S we'LL \x1c\x1d x", "İstanbul ΟΔΟΣ Σ ΑΣ", "é ẛ̣ Å Ω K", "9² ½Ⅷ٣", "日本 語　x\xa0y\x85z​q", "ǅ ǆ ß ẞ ŉ"]
ODD += ["<|endoftext|>", "a<|endoftext|>b<|STARTOFTEXT|> <|startoftext|><|endoftext", "é<|endoftext|>́", "_a__b_ 'don't' ''s", "\U0001f600\U0001f468‍\U0001f469", "\0\x7f�"]
ODD += ["word " * 60000, "ab" * 4000, "x9" * 700 + "İ", "Ⱥɓ " * 50 + "ͅ"]


@pytest.mark.parametrize("name", list(LIBRARY))
def test_odd_texts(spark, name):
    rows = [(i % 7, t, "clash") for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = T.count_tokens(df, name=name).collect()
    assert sorted((r.doc_id, r.text or "", r.n_tokens) for r in got) == sorted((i, t or "", brute(t, name)) for i, t, _ in rows)
    assert not T.token_counts_of_documents(df.limit(0)).collect()


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(T, "KNOWN", 2)
    c = T.Counter(T.VOCABULARY)
    text = "the cat sat on the mat and the hat"
    assert [c.text(text) for _ in range(3)] == [brute(text)] * 3


@settings(deadline=None)
@given(st.text("abCsé \n'_.9²İσΣς日́<|>\x1c\xa0", max_size=30))
def test_counts_equal_the_library(text):
    assert [T.counter(n).text(text) for n in LIBRARY] == [brute(text, n) for n in LIBRARY]


@settings(deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.dictionaries(st.tuples(st.integers(0, 6), st.integers(0, 6)), st.integers(4, 6), max_size=12))
def test_merges_by_plain_search(symbols, merged):
    pairs = {p: (rank, m) for rank, (p, m) in enumerate(merged.items())}
    now = list(symbols)
    while found := min(((pairs[p][0], i) for i, p in enumerate(zip(now, now[1:], strict=False)) if p in pairs), default=None):
        i = found[1]
        now[i : i + 2] = [pairs[now[i], now[i + 1]][1]]
    assert T.merges_of(symbols, pairs) == len(symbols) - len(now)
