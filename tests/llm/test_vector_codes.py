import hashlib
import math

import numpy as np
import pytest

from variorum.llm import vector_codes as V


def brute(rows):
    """Rows (id, vector, label) to (id, code, error, label_error, digest), by plain loops over whole numbers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max(len(r[1]) for r in kept) // 16) * 16
    whole = [[min(max(math.floor(256 * x), -V.MOST), V.MOST) for x in r[1]] + [0] * (width - len(r[1])) for r in kept]
    cut = width // 16
    parts = [[w[p * cut : (p + 1) * cut] for p in range(16)] for w in whole]
    books = [[x[p] for x in parts[:64]] for p in range(16)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(2):
        for p, book in enumerate(books):
            mine = {}
            for x in parts:
                mine.setdefault(nearest(x[p], book)[1], []).append(x[p])
            books[p] = [[sum(c) // len(mine[e]) for c in zip(*mine[e], strict=True)] if e in mine else c for e, c in enumerate(book)]
    found = [[nearest(x[p], books[p]) for p in range(16)] for x in parts]
    digest = hashlib.sha256(",".join(str(v) for book in books for c in book for v in c).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in found]
    by = {}
    for r, e in zip(kept, errors, strict=True):
        by[r[2]] = by.get(r[2], 0) + e
    return [(r[0], "".join(f"{e:02x}" for _, e in f), x, by[r[2]], digest) for r, f, x in zip(kept, found, errors, strict=True)]


def check(spark, rows, more=""):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<float>, label int{more}")
    got = V.compress_vectors(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute([r[:3] for r in rows]), key=str)


def test_table(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").limit(200).collect()]
    check(spark, rows)


@pytest.mark.parametrize("size", [16, 32, 7, 0])
def test_ties_repeats_nulls_and_bad_components(spark, size):
    rng = np.random.default_rng(size)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 3, size) / 128], None if i % 5 == 0 else int(i % 3)) for i in rng.integers(0, 150, 230)]
    rows += [(None, [0.25] * size, 1), (None, [0.25] * size, 1), (-1, None, 2), (3, [1e30] * size, None), (5, [0.5] * (size // 2), 2)]
    rows += [(-2, [float("nan")] * (size + 1), 1), (-3, [None, 1.0], 1), (-4, [float("-inf")], 1)]
    check(spark, [(*r, "x", 1) for r in rows], ", code string, label_key int")


def test_few_and_no_vectors(spark):
    check(spark, [(4, [0.5] * 16, 1), (9, [-0.001] * 16, None)])
    check(spark, [(4, None, 1), (9, [float("nan")] * 16, None)])
    check(spark, [])


def test_search_scans_less_than_all_and_finds_the_nearest():
    rng = np.random.default_rng(2)
    books = V.Codebooks(rng.integers(-60, 60, (16, 64, 4)))
    x = np.concatenate([books.entries[:, rng.integers(0, 64, 300)].transpose(1, 0, 2) + rng.integers(-8, 8, (300, 16, 4)), rng.integers(-300, 300, (50, 16, 4))])
    d = ((x[:, :, None] - books.entries[None]) ** 2).sum(-1)
    first, least, cold = books.search(x, np.zeros((350, 16), np.uint8))
    assert (first == d.argmin(2)).all() and (least == d.min(2)).all()
    again, _, warm = books.search(x[:300], first[:300])
    assert (again == first[:300]).all() and warm < 0.2 * 300 * 16 * 64 < cold
