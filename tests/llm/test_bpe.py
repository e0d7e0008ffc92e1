import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from variorum.llm import bpe, pretoken

ODD = [None, "", " ", "a", "a  b\n\n c", "it's 9² Ⅷ _x_ é\x1c\x85　z", "日本語 \U0001f600 " * 300, "x" * 20000, "word " * 40000, "<|endoftext|>", "a"]


def want(texts):
    enc = bpe.encoding(bpe.RANKS)
    out = Counter()
    for i, t in texts:
        ids = np.array(enc.encode_ordinary(t or ""), "<u4")
        out[i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    return out


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert Counter(map(tuple, bpe.tokenize_documents(docs).collect())) == want([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("block", [10, 12_000_000])
def test_odd_texts(spark, monkeypatch, block):
    monkeypatch.setattr(bpe, "BLOCK", block)
    rows = [*enumerate(ODD), (None, "x y"), (3, "a")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, block string")
    assert Counter(map(tuple, bpe.tokenize_documents(df).collect())) == want(rows)
    assert not bpe.tokenize_documents(df.limit(0)).collect()
    encoded = bpe.encode_texts(df)
    assert encoded.columns == ["doc_id", "block", "ids"]
    back = bpe.decode_ids(encoded).collect()
    assert Counter((r.doc_id, bytes(r.bytes)) for r in back) == Counter((i, (t or "").encode()) for i, t in rows)


def test_pieces_join_to_the_text():
    import random

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    alphabet = "ab'sdmt l\n\t \x1c\x1f\x85\xa0  _9²½éßñ日٣́​　!#\U0001f600﻿"
    for _ in range(2000):
        s = "".join(rng.choice(alphabet) for _ in range(30))
        assert pretoken.pieces(s) == [s[a:b] for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(s)]


def test_bucket_hash_is_sparks(spark):
    """Blocks are named so that a task's blocks fall in one bucket: that needs Spark's own hash."""
    from pyspark.sql import functions as F

    values = [0, 1, -1, 7, 2**40, 2**40 + 8, -(2**63), 2**63 - 1, *range(1000, 1300)]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x long").repartition(1).select("x", F.hash("x").alias("h")).orderBy("x").select("h").collect()]
    assert got == bpe.spark_hash(np.array(sorted(values), np.int64)).tolist()
    names = [n for _, n in zip(range(50), bpe.block_names(5, 8), strict=False)]
    where = {r[0] for r in spark.createDataFrame([(n,) for n in names], "x long").select(F.pmod(F.hash("x"), F.lit(8))).collect()}
    assert len(names) == len(set(names)) == 50 and where == {5}
