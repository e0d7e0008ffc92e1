import numpy as np

from variorum.llm import vector_dedup as D

from .brute import components


def want(rows, threshold=0.9):
    good = [i for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    by = dict(rows)
    pairs = []
    for k, a in enumerate(good):
        for b in good[k + 1 :]:
            x, y = np.array(by[a], float), np.array(by[b], float)
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                pairs.append((a, b))
    root = components(sorted(by), pairs)
    return {i: (sum(i in p for p in pairs), root[i], root[i] == i) for i in by}


def result(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in D.dedup_embeddings(df).collect()}


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    errors, below = [], 0
    for s in range(40):
        q, _ = np.linalg.qr(np.random.default_rng(1000 + s).standard_normal((64, 64)))
        x = rng.standard_normal(64)
        y = x + 0.45 * rng.standard_normal(64)
        x, y = x / np.linalg.norm(x), y / np.linalg.norm(y)
        bits, f = D.codes((y @ q)[None])
        e = D.estimates((x @ q)[None], bits, f)[0, 0]
        errors.append(e - x @ y)
        below += x @ y >= 0.9 and e < D.floors(f, 0.9, 64)[0]
    assert abs(np.mean(errors)) < 0.03 and not below


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(D, "CHUNK", 100)
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rng = np.random.default_rng(3)
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in table.collect()]
    rows += [(1000 + i, (np.array(rows[i % 40][1]) + 0.055 * rng.standard_normal(64)).tolist()) for i in range(120)]
    got = result(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got == want(rows) and sum(n for n, _, _ in got.values()) > 100


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, None), (6, []), (7, [0.0, 0.0]), (8, [1.0, nan]), (9, [inf, 1.0]), (10, [1.0, None])]
    rows += [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.1]), (4, [-1.0, 0.0]), (11, [1.0, 0.0, 0.0]), (-7, [0.0, 5.0]), (12, [1.0]), (13, [3.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, n_links string")
    assert result(df) == want(rows)
    assert not result(df.limit(0))
    twice = D.dedup_embeddings(spark.createDataFrame([(1, [1.0]), (1, [1.0]), (None, [1.0]), (None, [-1.0])], "vec_id long, embedding array<float>"))
    assert sorted((r.n_links, r.component_id or 0) for r in twice.collect()) == [(0, 0), (2, 1), (2, 1), (2, 1)]
