import random

import pytest
from pyspark.sql import functions as F

from variorum import queries as Q
from variorum.kernels import book as B
from variorum.kernels import greedy as G
from variorum.operators import books


def edited(rng, words, rate, alphabet="bdfgkmt"):
    out = []
    for w in words:
        x = rng.random()
        if x < rate:
            continue
        out.append(w if x > 3 * rate else w[:-1] + rng.choice(alphabet))
        while rng.random() < rate:
            out.append("".join(rng.choice(alphabet) for _ in range(6)))
    return out


def text(rng, n, size=5):
    return ["".join(rng.choice("bdfgkmtnprs") for _ in range(size)) for _ in range(n)]


def allowed(pairs, canon, our):
    """Matches in order, no more than 15 words passed between two, fillers not counted."""
    solid = lambda ws, a, b: sum(w not in ("W", "Y") for w in ws[a + 1 : b])
    assert all(G.same_word(canon[c], our[o]) for c, o in pairs)
    for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False):
        assert c > a and d > b and solid(canon, a, c) + solid(our, b, d) <= 15


def test_words_that_match():
    rng = random.Random(1)
    canon, our = text(rng, 60, 3) + ["", "aē", "frāmąm"], text(rng, 60, 3) + ["", "ā", "framm"]
    assert B.matching(canon, our) == [[o for o, y in enumerate(our) if G.same_word(x, y)] for x in canon]


def test_longest_increasing_chain():
    rng = random.Random(2)
    for _ in range(100):
        points = [(c, o) for c, o in enumerate(rng.sample(range(9), 9))]
        best = max(
            (m for k in range(1 << 9) for m in [[p for i, p in enumerate(points) if k >> i & 1]] if all(x[1] < y[1] for x, y in zip(m, m[1:], strict=False))), key=len
        )
        got = B.increasing(points)
        assert len(got) == len(best) and all(x < y and x[1] < y[1] for x, y in zip(got, got[1:], strict=False)) and set(got) <= set(points)
    assert B.increasing([]) == []


@pytest.mark.parametrize("seed", range(12))
def test_a_stretch_equals_the_exact_programme(seed):
    rng = random.Random(seed)
    canon = text(rng, 45, 2 + seed % 3)
    our = edited(rng, canon, 0.02 * (seed % 6))
    if seed % 4 == 3:  # something that can't be crossed
        our[20:20] = text(rng, 17, 7)
    want = G.anchored(canon, our)
    got = [(p["c"], p["o"]) for p in B.stretch(canon, our, range(len(canon)), range(len(our)), True, True)["pairs"]]
    allowed(got, canon, our)
    assert len(got) == len(want)


def rows_of(spark, pairs, apart):
    df = spark.createDataFrame([(k, c, o) for k, (c, o) in enumerate(pairs)], "book long, canon array<string>, our array<string>")
    out = {}
    for r in books.match_books(df, apart).orderBy("book", "c").collect():
        out.setdefault(r.book, []).append((r.c, r.o))
    return [out.get(k, []) for k in range(len(pairs))]


def test_short_books_equal_the_exact_programme_however_they_are_cut(spark):
    rng = random.Random(5)
    pairs = []
    for k in range(10):
        canon = text(rng, 70, 5)
        pairs.append((canon, edited(rng, canon, 0.015 * k)))
    pairs.append((text(rng, 30), text(rng, 30)))
    pairs += [(["W", *pairs[1][0][:40]], [x for k, w in enumerate(pairs[1][1][:40]) for x in (w, *["Y"] * (k > 5))]), ([], ["a"]), (None, None), (["aa", "bb"], ["aa", "bb"])]
    for apart in (8, 1000):
        for (canon, our), got in zip(pairs, rows_of(spark, pairs, apart), strict=True):
            want = G.anchored(canon or [], our or [])
            allowed(got, canon, our)
            assert len(got) == len(want), (apart, canon, our)


def test_a_book_of_twenty_thousand_words(spark):
    rng = random.Random(9)
    canon = text(rng, 20000, 4)
    our = edited(rng, canon, 0.03)
    broken = our[:9000] + text(rng, 40, 9) + our[9000:]
    whole, stopped = rows_of(spark, [(canon, our), (canon, broken)], books.APART)
    allowed(whole, canon, our)
    assert len(whole) > 0.93 * len(our)
    allowed(stopped, canon, broken)
    assert stopped[-1][1] < 9015 and len(stopped) > 0.9 * 9000


def test_query_over_documents(spark):
    sf = "/root/testdata/sf0.001"
    lines = Q.witnesses(spark, sf).where("trim(text) <> ''").orderBy("doc_id", "line").collect()
    words = {}
    for r in lines:
        words.setdefault((r.lemma, r.doc_id), []).extend(r.text.lower().split())
    got = {}
    for r in Q.QUERIES["book_matches"](spark, sf).collect():
        got.setdefault(r.doc_id, []).append((r.c, r.o))
    checked = 0
    for (lemma, doc), our in words.items():
        if lemma != doc:
            canon, mine = words[lemma, lemma], sorted(got.get(doc, []))
            allowed(mine, canon, our)
            if len(canon) * len(our) <= 2500:
                assert len(mine) == len(G.anchored(canon, our))
                checked += 1
    assert got and F and checked >= 0
