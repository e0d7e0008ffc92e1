import random
import time
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from variorum.llm import token_files as T


@given(st.lists(st.one_of(st.integers(0, 40), st.integers(0, 2**32 - 1)), max_size=300))
def test_round_trip(values):
    ids = np.array(values, np.uint32)
    assert T.unpack(T.pack(ids)).tolist() == values


def test_blocks_are_read_alone():
    ids = np.random.default_rng(1).integers(0, 50000, 3 * T.BLOCK + 5).astype(np.uint32)
    assert T.unpack(T.pack(ids), 1, 3).tolist() == ids[T.BLOCK : 3 * T.BLOCK].tolist()
    assert len(T.pack(ids)) < 2.2 * len(ids)


@cache
def library():
    """The library's tokenizer as the file gives it."""
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def brute(rows):
    t = library()
    out, at = [], 0
    for i, text in sorted(rows):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(map(tuple, T.token_files_of_documents(docs.repartition(7)).collect())) == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("segment", [3, 1 << 18])
def test_odd_tables(spark, monkeypatch, segment, tmp_path):
    monkeypatch.setattr(T, "SEGMENT", segment)
    rows = [(9, None), (2, ""), (4, "it's 9² Ⅷ _x_ é\x1c z" * 500), (7, "a <|endoftext|> b<|endoftext|><|endoftext|>x<|endoftext"), (-3, "word " * 30000), (11, "日本 " * 99)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int")
    assert sorted(map(tuple, T.token_files_of_documents(df).collect())) == brute(rows)
    assert not T.token_files_of_documents(df.limit(0)).collect()
    same = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (1, None)], "doc_id long, text string")
    T.write_tokens(same, str(tmp_path / "f"))
    got = sorted(T.read_documents(spark, str(tmp_path / "f")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 1, 1] and sum(len(r.ids) for r in got) == 9
    assert [r.start for r in got] == np.cumsum([0, *(len(r.ids) for r in got)])[:-1].tolist()


def whole(texts, most):
    out = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(T, "AT_ONCE", most)
        for ids, n in T.encode(texts, T.VOCABULARY):
            out += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    return out


@settings(deadline=None)
@given(st.lists(st.lists(st.one_of(st.text("ab'sé \n\t\0\x1c\xa0.9²日<|", max_size=25), st.just("<|endoftext|>"))).map("".join), min_size=1, max_size=8))
def test_encoding_equals_the_library(texts):
    want = [[*library().encode(x, add_special_tokens=False).ids, 0] for x in texts]
    assert whole(texts, 1 << 18) == whole(texts, 30) == whole(texts, 0) == want


def test_added_tokens_are_the_librarys():
    assert whole(["a <|endoftext|> b"], 9) == [[64, 220, 50256, 275, 0]]


#: what stands where tokens could lie across a cut: apostrophes, line feeds and other white space, letters of two bytes
TRAPS = [*"'stvlmdrSaéßÀĝſ1.,-_()\"\n\t\r\x0b\x1c\0 ", "re", "ve", "ll", "  ", "''", "\n\n", " \n", "23", "<|endoftext|>", "<|"]


def test_unsplit_texts_get_the_files_ids():
    draw = random.Random(9)
    texts = ["".join(draw.choices(TRAPS, k=draw.randint(0, 30))) for _ in range(20000)]
    texts += ["a\n\nb", "a\n\n\nb", "a\n\n", "a\n\n b", "it's 5'9 o'clock", "don't", "l'été"]
    easy = [x for x in texts if T.plain(x)]
    assert len(easy) > 1000
    got, want = (t.encode_batch_fast(easy, add_special_tokens=False) for t in (T.unsplit(T.VOCABULARY), library()))
    assert [x.ids for x in got] == [x.ids for x in want]


@pytest.mark.parametrize("text", ["''s", "'tis", "a 's", "'sabc", "x'vex", "'llama", "3×4", "9²", "a—b", "\xa0 \xa0", "ɐʼ", "日", "Ω"])
def test_odd_texts_are_split_as_the_file_says(text):
    assert not T.plain(text)


def test_every_plain_letter_is_a_letter():
    assert all(chr(c).isalpha() == T.plain(chr(c)) for c in range(0xC0, 0x280))
    assert not any(T.plain(chr(c)) for c in (*range(0x80, 0xC0), *range(0x280, 0xD800), *range(0xE000, 0x11000)))


@pytest.mark.parametrize(("token", "pairs"), [(b" word", []), (b"12", []), (b"...", []), (b"caf\xc3\xa9", []), (b"\xe2\x80\x94-", []), (b"'s", [b"'s"]), (b"a b", [b"a "]), (b"x,", [b"x,"]), (b"\n\n", [b"\n\n"]), (b"  a", [b"  "])])
def test_tokens_across_a_cut(token, pairs):
    assert T.crossed([token]) == set(pairs)


def test_plain_texts_cost_less_than_the_files_split():
    draw = random.Random(4)
    words = ["".join(draw.choices("etaoinshrdlucé", k=draw.randint(2, 9))) for _ in range(30000)]
    texts = [" ".join(draw.choices(words, k=600)) + "." for _ in range(60)]
    took = {}
    for _ in range(5):
        for way, run in (("file", lambda: library().encode_batch_fast(texts, add_special_tokens=False)), ("here", lambda: list(T.encode(texts, T.VOCABULARY)))):
            began = time.process_time()
            run()
            took[way] = min(took.get(way, 1e9), time.process_time() - began)
    assert took["here"] < 0.7 * took["file"], took
