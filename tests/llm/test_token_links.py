import hashlib
from collections import Counter
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from variorum.llm import token_links as L


@cache
def library():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in letters} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*letters}))}
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), byte


def plain(text):
    """Groups of a text as lists of ids, with Python's big integers and loops."""
    if not text:
        return []
    one, two, byte = library()
    a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
    bytes_a = [bytes(byte[c] for c in one.id_to_token(i)) for i in a]
    bytes_b = [bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in (two.id_to_piece(i),)]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return []

    def mask(tokens):
        bits, at = 0, 0
        for t in tokens:
            at += len(t)
            bits |= 1 << at
        return bits

    shared, groups = mask(bytes_a) & mask(bytes_b), []
    ia = ib = at_a = at_b = 0
    for cut in (k for k in range(1, len(text.encode()) + 2) if shared >> k & 1):
        x, y = [], []
        while at_a < cut:
            at_a, ia = at_a + len(bytes_a[ia]), ia + 1
            x.append(a[ia - 1])
        while at_b < cut:
            at_b, ib = at_b + len(bytes_b[ib]), ib + 1
            y.append(b[ib - 1])
        groups.append((x, y))
    return groups


def brute(rows):
    every = [(i, plain(t)) for i, t in rows]
    links = [[(x, y) for a, b in g for x in a for y in b] for _, g in every]
    docs = Counter(p for row in links for p in set(row))
    most = {}
    for (x, _), n in docs.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for (i, g), row in zip(every, links, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        sha = hashlib.sha256(text.encode()).hexdigest() if g else ""
        best = sum(docs[p] == most[p[0]] for p in row)
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(row), best, sum(docs[p] for p in row), sha))
    return sorted(out, key=str), {(x, y): (n, n == most[x]) for (x, y), n in docs.items()}


ODD = [None, "", " ", "a", "x▁y", "<|endoftext|> </s> <s> <0x0A> <unk>", "日本語 का ½ Ⅷ\xa0x\x85y\x1cz", "\U0001f600\U0001f468‍\U0001f469 \0\x7f", "İstanbul ẛ̣ é"]
ODD += ["a" * 3000, "ab9" * 900, " " * 3000 + "x" + "\n" * 2000, "word " * 20000, "  two  spaces\t\r\n", "the cat", "the cat", "Σίσυφος" * 50]


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows, pairs = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(tuple, L.link_documents(docs.repartition(5)).collect()), key=str) == rows
    assert {(r.a, r.b): (r.docs, r.best) for r in L.count_links(docs).collect()} == pairs


@pytest.mark.parametrize("block, links, texts", [(1 << 21, 1 << 20, 256), (50, 40, 3), (1, 1, 1)])
def test_odd_texts(spark, monkeypatch, block, links, texts):
    monkeypatch.setattr(L, "BLOCK", block)
    monkeypatch.setattr(L, "LINKS", links)
    monkeypatch.setattr(L, "TEXTS", texts)
    rows = [(None if i == 5 else i % 9, t, "clash") for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a string")
    assert sorted(map(tuple, L.link_documents(df).collect()), key=str) == brute([r[:2] for r in rows])[0]


def test_no_rows_and_no_tokens(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, L.link_documents(df).collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    assert not L.link_documents(df.limit(0)).collect() and not L.count_links(df).collect()


def test_groups(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)], "doc_id long, text string, groups int")
    got = L.align_texts(df).collect()
    assert len(got) == len(ODD)
    for r in got:
        ends = [(0, 0), *((g.a_end, g.b_end) for g in r.groups)]
        assert [(r.a_ids[a:c], r.b_ids[b:d]) for (a, b), (c, d) in zip(ends, ends[1:], strict=False)] == plain(ODD[r.doc_id])
    assert not L.align_texts(df.limit(0)).collect()


@settings(deadline=None)
@given(st.lists(st.text("abTHé \n'_.9²日▁<0x>\x1c\xa0\0", max_size=20), min_size=1, max_size=5))
def test_groups_equal_plain_loops(texts):
    (found,) = L.aligned_texts(iter(texts))
    want = [";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in plain(t)) for t in texts]
    assert found.written() == want


@given(st.lists(st.integers(1, 70), max_size=40), st.randoms())
def test_ranks(lens, rng):
    total = sum(lens)
    bits = L.ends_as_bits(np.array(lens, np.int64), -(-total // 64))
    ends = np.cumsum(lens) - 1
    at = np.array(sorted(rng.sample(range(total), min(total, 20))), np.int64)
    assert L.ranks_of(bits, at).tolist() == [int((ends <= k).sum()) for k in at]
