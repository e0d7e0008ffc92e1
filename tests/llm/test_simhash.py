from fractions import Fraction

import numpy as np
import pytest

from variorum.llm import simhash as S
from variorum.llm.common import connected_components

from .brute import components, jaccard5, similar_components, simhash


def check(got, texts):
    fps = {i: simhash(t) for i, t in texts.items()}
    ids = sorted(fps)
    v = np.array([fps[i] for i in ids], np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(v[:, None] ^ v[None]) <= 2, 1))
    want = components(ids, [(ids[a], ids[b]) for a, b in near])
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in ids}


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(S.dedup_documents(docs).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_odd_texts(spark):
    texts = [None, "", " \t\n", "one", "One", "one  two", "é\xa0x y z", "word " * 70000, "a b c d", "A b c D", "a b c d"]
    rows = list(enumerate(texts, -3))
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, fp string")
    check(S.dedup_documents(df).collect(), dict(rows))
    assert not S.dedup_documents(df.limit(0)).collect()


def test_links_over_cut_tiles(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 8)
    rng = np.random.default_rng(5)
    v = rng.integers(0, 2**63, 40, dtype=np.uint64)
    v = np.unique(np.concatenate([v, *(v ^ np.uint64(1 << int(b)) for b in rng.integers(0, 64, 12)), v ^ np.uint64(3 << 40)]))
    fps = v.view(np.int64).tolist()
    edges = S.links_between(spark.createDataFrame([(x,) for x in fps], "fp long"), 2)
    got = {r.node: r.root for r in connected_components(edges).collect()}
    near = np.argwhere(np.triu(np.bitwise_count(v[:, None] ^ v[None]) <= 2, 1))
    want = components(fps, [(fps[a], fps[b]) for a, b in near])
    assert {x: got.get(x, x) for x in fps} == want


def test_components_of_long_chain(spark):
    got = connected_components(spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901), (5, 5)], "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == {**{i: 0 for i in range(301)}, 900: 900, 901: 900}


def words(rng, n):
    return [f"w{rng.integers(3000)}" for _ in range(n)]


def check_similar(spark, rows):
    got = S.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want, _ = similar_components(rows)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[want[k]] = min(least.get(want[k], i), i)
    assert sorted((r.id, r.component_id) for r in got) == sorted((i, least[want[k]]) for k, (i, _) in enumerate(rows))


def edited_copies(seed=3):
    rng, rows = np.random.default_rng(seed), []
    for g in range(6):
        base = words(rng, 150)
        for _ in range(25):
            own = list(base)
            for k in rng.integers(0, 150, rng.integers(0, 6)):
                own[k] = "edit"
            rows.append(" ".join(own))
        rows.append(" ".join(base).upper() + " ")
    rows += [" ".join(words(rng, 80)) for _ in range(60)] + ["", None, " ", "one", "ONE", "a b c d e", "a b c d f"]
    return list(enumerate(rows, 10))


def test_similar_documents_equal_brute_force(spark):
    check_similar(spark, edited_copies())


@pytest.mark.parametrize("shingles, blocks, pairs", [(3000, 20000, 100), (1, 1, 1)])
def test_similar_documents_over_cut_groups(spark, monkeypatch, shingles, blocks, pairs):
    monkeypatch.setattr(S, "SHINGLES", shingles)
    monkeypatch.setattr(S, "TEXTS", blocks)
    monkeypatch.setattr(S, "PAIRS", pairs)
    check_similar(spark, edited_copies(4)[:: 1 if pairs > 1 else 4])


def test_group_of_hundreds_of_near_copies(spark):
    """Each at about 0.85 to a base that stands last, and at about 0.72 to one another, some farther; and a chain whose ends are unlike."""
    rng = np.random.default_rng(8)
    base, rows = words(rng, 300), []
    for _ in range(400):
        own = list(base)
        for k in rng.integers(0, 300, rng.integers(5, 16)):
            own[k] = f"w{rng.integers(3000)}"
        rows.append(" ".join(own))
    chain = words(rng, 200)
    for k in range(30):
        rows.append(" ".join(chain[4 * k :] + [f"new{j}" for j in range(4 * k)]))
    rows.append(" ".join(base))
    check_similar(spark, list(enumerate(rows, 10)))


def test_prefix_meets_every_similar_set():
    """Sets at exactly the asked similarity share a member of their first ones, in any order."""
    share = Fraction(0.8).limit_denominator(1000)
    for n in range(1, 60):
        for m in range(n, 2 * n):
            for o in range(1, n + 1):
                if o * 5 >= 4 * (n + m - o):
                    # the worst order: what is shared comes last on both sides
                    assert n - o < S.prefix_length(np.array(n), share) and m - o < S.prefix_length(np.array(m), share)


def test_wide_radius_holds_all_similar_texts():
    """Texts of similarity 0.8 or more, short ones too, stay far inside the radius within which pairs are counted."""
    rng, most = np.random.default_rng(1), 0
    for n in (5, 8, 14, 40, 120, 400):
        for _ in range(200):
            base = words(rng, n + 4)
            own = base[: -max(1, n // 9)] + words(rng, max(0, n // 9 - rng.integers(0, 2)))
            a, b = " ".join(base), " ".join(own)
            if jaccard5(a, b) >= 0.8:
                x, y = (S.wide_fingerprint(S.shingle_set(t, 5)) for t in (a, b))
                most = max(most, int(np.bitwise_count(x ^ y).sum()))
    assert 30 < most <= S.radius_of(0.8) + S.SLACK - 10


def test_overlaps_by_product(monkeypatch):
    monkeypatch.setattr(S, "COLUMNS", 7)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(25)]
    got = S._overlaps(sets[:10], sets[10:])
    assert got.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets[10:]] for a in sets[:10]]


@pytest.mark.parametrize("size, links", [("sf0.01", None), ("sf0.1", 48)])
def test_similar_documents_of_the_table(spark, size, links):
    """All links of the texts and no other: 48 on sf0.1, as the README says."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{size}/documents.parquet").collect()]
    check_similar(spark, rows)
    assert links in (None, len(similar_components(rows)[1]))


def test_one_row_of_a_component_stays_whatever_the_columns(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(7, text, 1, 2, 3, 4), (5, text + " more", 1, 2, 3, 4), (5, text + " more", 1, 2, 3, 4), (None, text, 9, 9, 9, 9), (8, "other", 1, 1, 1, 1), (None, "lone", 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id int, row int, _row int, component_id int")
    got = S.drop_near_duplicates(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=str) == sorted([rows[1], rows[4], rows[5]], key=str)
    assert not S.drop_near_duplicates(df.limit(0)).collect()
