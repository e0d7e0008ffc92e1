import zlib

import numpy as np
import pytest

from variorum.llm import toxicity as X


def test_isotonic_is_monotone_and_mean_preserving():
    rng = np.random.default_rng(1)
    m, y = rng.normal(size=500), rng.random(500) < 0.3
    x, v = X.isotonic(m, y.astype(float), np.ones(500))
    assert (np.diff(x) > 0).all() and (np.diff(v) >= 0).all() and 0 <= v.min() and v.max() <= 1


def test_boost_learns_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    start, trees = X.boost(x, y, np.ones(2000))
    out = X.Model({}, start, trees, np.zeros(0), np.zeros(0)).margin(x)
    assert ((out > 0) == (y > 0)).mean() > 0.95


def test_documents(spark):
    read = lambda n: spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet")
    got = {r.doc_id: r for r in X.score_documents(read("documents"), read("labels")).collect()}
    truth = {r.doc_id: r.toxic for r in read("labels").collect()}
    held = [(got[i].predicted, t) for i, t in truth.items() if got[i].held_out]
    hit = sum(p and t for p, t in held)
    assert len(got) == 10000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert hit / sum(t for _, t in held) > 0.85 and hit / sum(p for p, _ in held) > 0.9


@pytest.mark.parametrize("labels", [[], [(0, 1)], [(i, i % 2) for i in range(60)] + [(3, None), (None, 1)]])
def test_few_labels_and_odd_texts(spark, labels):
    docs = [(i, "you utter moron" if i % 2 else "a fine day", "x") for i in range(60)]
    docs += [(100, None, "x"), (101, "", "x"), (102, "m0r0n " * 50000, "x"), (None, "moron", "x")]
    out = X.score_documents(
        spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    )
    got = out.collect()
    assert len(got) == len(docs) and out.columns == ["doc_id", "held_out", "score", "predicted"]
    assert all(0 <= r.score <= 1 for r in got)
    if len(labels) > 50:
        by = {r.doc_id: r for r in got}
        assert by[1].predicted == 1 and by[2].predicted == 0


@pytest.mark.parametrize("before", ["word " * 3000, "İ word " * 3000])
def test_obfuscated_hits_stand_where_they_are_in_long_texts(before):
    near = lambda text: X.features(text, X.Weights({}))[X.NAMES.index("near_you_count")]
    assert near(before + "you m0ron") == 1
    for k in (0, 300, 570, 800, 1000, 1500):  # a far "you", also where the last 4,000 characters would put the hit
        words = before.split(" ")
        assert near(" ".join([*words[:k], "you", *words[k:], "m0ron"])) == 0


def plain_features(text, lexicon):
    """Every feature by its definition, character by character and word by word."""
    import math
    import re

    text = text or ""
    letters = lambda t: re.findall(r"[^\W\d_]+", t)
    kind = lambda c: ("up" if c.isupper() and ord(c) < 0x250 else "low") if c.isalpha() else "digit" if c.isdigit() else "space" if c.isspace() else "join" if c in "'’-.,/_" and ord(c) < 0x250 else "mark"
    words = letters(text.lower())
    weight = lambda w: (max(lexicon.get(w, 0.0), 2.0 if w in X.SEED else 0.0), max([lexicon.get(w[:n] + "*", 0.0) for n in X.PREFIXES if n < len(w)] or [0.0]))
    hits = [(i, w, *weight(w)) for i, w in enumerate(words) if any(weight(w))]
    kinds = [kind(c) for c in text]
    runs = [(m.start(), m.end()) for m in re.finditer(r"A+", "".join("A" if k in ("up", "low") else "x" for k in kinds))]
    breaks = [
        (e, s) for (_, e), (s, _) in zip(runs, runs[1:], strict=False)
        if s - e <= 3 and kinds[e] in ("mark", "digit") and kinds[e] == kinds[s - 1] == kinds[(e + s - 1) // 2]
    ]
    for m in re.finditer(r"\S+", text):
        if any(m.start() <= e < m.end() for e, _ in breaks):
            meant = "".join(letters(m[0].lower().translate(X._LEET)))
            if meant in X.SEED or lexicon.get(meant, 0.0) >= 2:
                hits.append((len(letters(text[: m.start()].lower())), meant, 2.0, 0.0))
    n, chars = max(1, len(words)), max(1, len(text))
    you = [i for i, w in enumerate(words) if w in X.SECOND_PERSON]
    strong = [i for i, _, a, b in hits if max(a, b) >= 2]
    near = sum(any(abs(i - j) <= X.NEAR for j in you) for i in strong)
    shouted = sum(e - s > 2 and all(k == "up" for k in kinds[s:e]) for s, e in runs)
    marked = sum(kinds[i] in ("up", "low") and kinds[i + 1] == kinds[i + 2] == "mark" for i in range(len(text) - 2))
    long = sum(text[i] == text[i + 1] == text[i + 2] and kinds[i] in ("up", "low") and not (i and text[i - 1] == text[i]) for i in range(len(text) - 2))
    own, stem, seeds = sum(h[2] for h in hits), sum(h[3] for h in hits), sum(h[1] in X.SEED for h in hits)
    return [
        math.log1p(len(words)), len(hits) / n, own / n, len(hits), own, max([max(h[2:]) for h in hits] or [0.0]), len({h[1] for h in hits}),
        seeds / n, seeds, stem / n, near / n, near, len(you) / n, kinds.count("up") / chars, shouted / n, text.count("!") / n, text.count("?") / n,
        (kinds.count("mark") + kinds.count("join")) / chars, marked / n, len(breaks) / n, long / n, kinds.count("digit") / chars, sum(map(len, words)) / n,
    ]


def plain_score(model, x):
    margin = model.start
    for feat, cut, leaf in model.trees:
        at = 0
        while at < len(feat):
            at = 2 * at + 1 + (x[feat[at]] > cut[at])
        margin += leaf[at - len(feat)]
    xs, ys = model.steps_x, model.steps_y
    if margin <= xs[0] or margin >= xs[-1]:
        return ys[0] if margin <= xs[0] else ys[-1]
    i = next(i for i in range(len(xs) - 1) if xs[i] <= margin <= xs[i + 1])
    return ys[i] + (ys[i + 1] - ys[i]) * (margin - xs[i]) / (xs[i + 1] - xs[i])


LEXICON = {"zork": 2.5, "grum*": 1.7, "blat": 1.6, "you*": 0.4}
ODD = [
    None, "", "m0r0n", "you m0r0n go", "YOU are a ST-UPID z0rk!!! grumble sooo blat", "a" * 5000 + " m0r0n you", "x1y2z3 " * 40 + "1d10t", "moron" * 900,
    "ĦĀĒ ȩɐɐɐ 日本 m@ron 　 id!ot you", "m0r0n" * 300 + " you", "w" * 45 + "0" + "w" * 45, "d'you st*pid? no…no", "²a³b you idiot",
]


def test_features_equal_brute_force(spark, sf):
    import random

    rng = random.Random(9)
    pool = ["you", "moron", "m0r0n", "id10t", "blat", "grumpy", "zork", "ZORK", "fine", "day", "s-o", "a1b", "!!", "u", "soooo", "é", "st@pid", "\n", "x" * 50]
    texts = ODD + [" ".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(200)]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    for t in texts:
        assert np.allclose(X.features(t, X.Weights(LEXICON)), plain_features(t, LEXICON), atol=1e-9), t and t[:200]


def test_scores_equal_brute_force(spark, sf):
    from pyspark.sql import functions as F

    read = lambda n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet")
    docs, labels = read("documents"), read("labels")
    model = X.fit(docs, labels.where(~X.held_out(F.col("doc_id"), 2, 4)))
    got = {r.doc_id: r.score for r in X.score_documents(docs, labels).collect()}
    assert len(model.trees) == X.TREES and len(got) == docs.count()
    for r in docs.limit(200).collect():
        assert abs(got[r.doc_id] - plain_score(model, plain_features(r.text, model.lexicon))) < 1e-6


def test_one_word_counts_once_and_long_words_are_mined(spark):
    count = lambda t: X.features(t, X.Weights({}))[X.NAMES.index("seed_count")]
    assert count("m0r0n") == 1 and count("m0r0n m0r0n") == 2
    assert X.features("you m0r0n go " + "word " * 3000, X.Weights({}))[X.NAMES.index("near_you_count")] == 1
    long = "zq" * 30
    rows = [(i, f"{long} day" if i % 2 else "fine day", i % 2) for i in range(40)]
    assert long in X.mine_lexicon(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = X.score_documents(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and not got.collect()
    some = spark.createDataFrame([(1, None), (2, ""), (None, "you moron")], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in X.score_documents(some, labels).collect())
