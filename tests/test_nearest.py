import random

import pytest

from variorum.kernels.gestalt import nearest, ratio
from variorum.operators import curate


def words(rng, n, letters="abcdeinorst→ "):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(n)]


@pytest.mark.parametrize("cutoff", [0.0, 0.6])
def test_nearest_keys_equal_a_search_of_all(spark, cutoff):
    rng = random.Random(3)
    keys = sorted({*words(rng, 120), "x", "abab", "\U0001f600a", "ā", "a" * 250})
    features = sorted({*words(rng, 60), *keys[:10], *(k[:-1] + "q" for k in keys[20:60]), "zzz", "", "\U0001f600", "baba", "a" * 249})
    a, b = (spark.createDataFrame([(x,) for x in xs] + [(None,), (xs[0],)], f"{c} string") for c, xs in (("feature", features), ("key", keys)))
    got = {r.feature: (r.key, round(r.s, 9)) for r in curate.nearest_keys(a, b, cutoff).collect()}
    want = {f: (k, round(s, 9)) for f in features for k, s in [nearest(f, keys, cutoff)] if k is not None}
    assert got == want
    assert not curate.nearest_keys(a.limit(0), b, cutoff).collect() and not curate.nearest_keys(a, b.limit(0), cutoff).collect()


def test_few_pairs_are_compared(spark):
    """Features that are near a key are found among a small part of all pairs, and no pair that reaches the step is left out."""
    rng = random.Random(4)
    keys = sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(1500)})
    features = sorted({k[:4] + rng.choice("xyz") + k[5:] for k in keys[::3]})
    fs, ks = (curate._letters(spark.createDataFrame([(x,) for x in xs], "c string"), "c") for xs in (features, keys))
    for step in (0.9, 0.75):
        got = {(r.feature, r.key) for r in curate.likely_keys(fs, ks, step).collect()}
        assert len(got) < 0.02 * len(features) * len(keys)
        assert {(f, k) for f in features[:60] for k in keys if ratio(f, k) >= step} <= got
