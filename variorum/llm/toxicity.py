"""Toxicity by gradient-boosted trees over dense features, calibrated isotonically.

Features: densities of a lexicon (seed words and what the labelled sample shows),
how near its words stand to second-person words, capitals, punctuation and
obfuscation rates. Fitting sees a bounded sample of labelled rows; scoring runs
over Arrow batches of whole texts with a model of some kilobytes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .language import _schema, held_out, sample_by_hash

PER_CLASS = 4000  # labelled rows of either class at most, as an expected number
LEXICON = 2000  # mined entries at most
TREES, DEPTH, RATE, BINS = 120, 3, 0.1, 32
THRESHOLD = 0.3

SEED = frozenset(
    "idiot moron stupid loser scum trash pathetic disgusting worthless clown dumb ugly hate kill "
    "imbécile connard salaud débile ordure crétin dummkopf trottel abschaum arschloch widerlich "
    "estúpido basura imbécil asqueroso inútil".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti usted ustedes vos".split())
NEAR = 6  # words

_LETTERS = re.compile(r"[^\W\d_]+")
#: classes of characters; what lies beyond the table counts as a small letter if it is one
SPACE, LOWER, UPPER, DIGIT, JOINS, MARK = range(6)
_BEYOND = 0x250
_CLASS = np.array(
    [
        UPPER if c.isupper() else LOWER if c.isalpha() else DIGIT if c.isdigit() else SPACE if c.isspace() else JOINS if c in "'’-.,/_" else MARK
        for c in map(chr, range(_BEYOND))
    ],
    np.uint8,
)
_LEET = str.maketrans("@013457$!", "aoieastsi")
PREFIXES = (4, 5, 6, 7)
NAMES = (
    "words", "lexicon_rate", "lexicon_weight_rate", "lexicon_count", "lexicon_weight", "lexicon_most", "lexicon_kinds", "seed_rate", "seed_count",
    "stem_weight_rate", "near_you_rate", "near_you_count", "you_rate", "capital_rate", "shout_rate", "bang_rate", "question_rate",
    "punctuation_rate", "marked_rate", "broken_rate", "long_rate", "digit_rate", "word_chars",
)


def tokens(text: str) -> list[str]:
    """Lower-case words of letters."""
    return _LETTERS.findall(text.lower())


def keys(word: str) -> list[str]:
    """Lexicon keys of a word: itself, and its beginnings marked with ``*``."""
    return [word, *(word[:n] + "*" for n in PREFIXES if n < len(word))]


class Weights(dict):
    """Word to (word weight, stem weight, second person), remembered for a bounded number of words; None for plain words."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> tuple[float, float, bool] | None:
        own = self.lexicon.get(word, 0.0)
        stem = max((self.lexicon.get(k, 0.0) for k in keys(word)[1:]), default=0.0)
        if word in SEED:
            own = max(own, 2.0)
        you = word in SECOND_PERSON
        value = (own, stem, you) if own or stem or you else None
        if len(self) > 500_000:
            self.clear()
        self[word] = value
        return value


def _marks(text: str) -> tuple[int, np.ndarray, np.ndarray, list[float]]:
    """How often words are broken by signs or digits, starts and ends of what holds such breaks between white space, and counts of what characters alone show."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    k = _CLASS[np.minimum(c, _BEYOND - 1)]
    far = np.flatnonzero(c >= _BEYOND)
    k[far] = [LOWER if x.isalpha() else SPACE if x.isspace() else MARK for x in map(chr, c[far].tolist())]
    letter, upper, mark = (k == LOWER) | (k == UPPER), k == UPPER, k == MARK
    edge = np.diff(np.concatenate(([0], letter.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ups = np.concatenate(([0], np.cumsum(upper)))
    shouted = int(((ups[end] - ups[start] == end - start) & (end - start > 2)).sum())
    # a word's end, up to three signs or digits of one kind, and the next word's start
    gap = start[1:] - end[:-1]
    cut = np.flatnonzero((gap > 0) & (gap <= 3))
    first, last = k[end[cut]], k[start[cut + 1] - 1]
    broken = cut[(first == last) & (k[(end[cut] + start[cut + 1] - 1) // 2] == first) & ((first == MARK) | (first == DIGIT))]
    marked = int((letter[:-2] & mark[1:-1] & mark[2:]).sum()) if len(k) > 2 else 0
    run = (c[:-2] == c[1:-1]) & (c[1:-1] == c[2:]) & letter[:-2] if len(k) > 2 else np.zeros(0, bool)
    long = int((run & ~np.concatenate(([False], run[:-1]))).sum()) if len(run) else 0
    spaces = np.concatenate(([-1], np.flatnonzero(k == SPACE), [len(k)]))
    at = np.unique(np.searchsorted(spaces, end[broken]))  # one broken twice counts once
    return len(broken), spaces[at - 1] + 1, spaces[at], [int(upper.sum()), shouted, int(mark.sum() + (k == JOINS).sum()), marked, long, int((k == DIGIT).sum())]


def _words_before(text: str, lower: str, places: list[int]) -> list[int]:
    """How many words of ``lower`` start before each of ``places`` in ``text``."""
    starts = np.fromiter((x.start() for x in _LETTERS.finditer(lower)), np.int64)
    at = np.array(places, np.int64)
    if len(lower) != len(text):  # small forms of more than one character move what follows
        at += np.searchsorted([i for i, c in enumerate(text) for _ in c.lower()[1:]], at)
    return np.searchsorted(starts, at).tolist()


def features(text: str | None, weights: Weights) -> list[float]:
    """Values of ``NAMES``; null and empty texts give zeros."""
    text = text or ""
    n_chars = max(1, len(text))
    lower = text.lower()
    words = _LETTERS.findall(lower)
    found = list(map(weights.__getitem__, words))
    some = [i for i, v in enumerate(found) if v]
    hits = [(i, words[i], found[i]) for i in some if found[i][0] or found[i][1]]
    you = np.array([i for i in some if found[i][2]])
    broken, starts, ends, (capitals, shouted, signs, marked, long, digits) = _marks(text)
    hidden = []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):  # obfuscated spellings count as the word they spell
        meant = "".join(_LETTERS.findall(text[a:b].lower().translate(_LEET)))
        if meant in SEED or weights.lexicon.get(meant, 0.0) >= 2:
            hidden.append((a, meant))
    if hidden:
        at = _words_before(text, lower, [a for a, _ in hidden])
        hits += [(i, meant, (2.0, 0.0, False)) for i, (_, meant) in zip(at, hidden, strict=True)]
    n = max(1, len(words))
    strong = np.array([i for i, _, v in hits if max(v[:2]) >= 2])
    near = 0
    if len(you) and len(strong):
        at = np.searchsorted(you, strong)
        gap = np.minimum(np.abs(you[np.minimum(at, len(you) - 1)] - strong), np.abs(you[np.maximum(at - 1, 0)] - strong))
        near = int((gap <= NEAR).sum())
    own, stem = sum(v[0] for _, _, v in hits), sum(v[1] for _, _, v in hits)
    seeds = sum(w in SEED for _, w, _ in hits)
    return [
        np.log1p(len(words)), len(hits) / n, own / n, len(hits), own, max((max(v[:2]) for _, _, v in hits), default=0.0),
        len({w for _, w, _ in hits}), seeds / n, seeds, stem / n, near / n, near, len(you) / n, capitals / n_chars, shouted / n,
        text.count("!") / n, text.count("?") / n, signs / n_chars, marked / n, broken / n, long / n, digits / n_chars,
        sum(map(len, words)) / n,
    ]


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either class that hold a key, added up within a batch."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())

    def out():
        both = set(seen[0]) | set(seen[1])
        return pa.RecordBatch.from_pydict(
            {"key": list(both), "clean": [seen[0][k] for k in both], "toxic": [seen[1][k] for k in both]},
            pa.schema([("key", pa.string()), ("clean", pa.int64()), ("toxic", pa.int64())]),
        )

    for b in batches:
        for t, y in zip(b["text"], b["toxic"].to_pylist(), strict=True):
            seen[y].update({k for w in set(tokens(t.as_py() or "")) for k in keys(w)})
            if len(seen[0]) + len(seen[1]) > 400_000:
                yield out()
                seen = (Counter(), Counter())
    yield out()


def mine_lexicon(sample: DataFrame, size: int = LEXICON) -> dict[str, float]:
    """Key to log-odds weight, of the ``size`` keys that tell the classes apart best."""
    n = dict(sample.groupBy("toxic").count().collect())
    if not n.get(0) or not n.get(1):
        return {}
    least = max(3, round(0.004 * n[1]))
    found = sample.select("text", "toxic").mapInArrow(_mine, "key string, clean long, toxic long")
    found = found.groupBy("key").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("toxic") >= least)
    odds = F.log(((F.col("toxic") + 0.5) / (n[1] + 1)) / ((F.col("clean") + 0.5) / (n[0] + 1)))
    found = found.withColumn("w", odds).where("w >= 1.5").orderBy(F.desc(F.col("w") * F.sqrt("toxic")), "key").limit(size)
    return {r.key: float(r.w) for r in found.collect()}


@dataclass
class Model:
    lexicon: dict[str, float]
    start: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # feature and threshold of inner nodes in heap order, leaf values
    steps_x: np.ndarray  # isotonic curve: score from raw margin
    steps_y: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for feat, cut, leaf in self.trees:
            out += _walk(x, feat, cut, leaf)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.steps_x):
            return np.zeros(len(x))
        return np.interp(self.margin(x), self.steps_x, self.steps_y)


def _walk(x: np.ndarray, feat: np.ndarray, cut: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), int)
    rows = np.arange(len(x))
    for _ in range(DEPTH):
        at = 2 * at + 1 + (x[rows, feat[at]] > cut[at])
    return leaf[at - len(feat)]


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, list]:
    """Logistic gradient boosting with histogram splits of full binary trees."""
    p0 = float(np.clip((w * y).sum() / w.sum(), 1e-3, 1 - 1e-3))
    start = np.log(p0 / (1 - p0))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], 1)
    out, trees = np.full(len(x), start), []
    inner = 2**DEPTH - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-out))
        g, h = w * (y - p), w * p * (1 - p)
        feat, cut, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(x), int)
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            best = (1e-6, 0, np.inf, BINS)
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for f in range(x.shape[1]) if len(rows) >= 10 else ():
                b = binned[rows, f]
                gl = np.bincount(b, g[rows], BINS + 1)[: len(cuts[f])].cumsum()
                hl = np.bincount(b, h[rows], BINS + 1)[: len(cuts[f])].cumsum()
                gain = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
                gain[(hl < 0.5) | (total_h - hl < 0.5)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), f, cuts[f][int(gain.argmax())], int(gain.argmax()))
            feat[k], cut[k] = best[1], best[2]
            node[rows] = 2 * k + 1 + (binned[rows, best[1]] > best[3])
        leaf = np.zeros(inner + 1)
        for k in range(inner + 1):
            rows = node == inner + k
            leaf[k] = RATE * g[rows].sum() / (h[rows].sum() + 1)
        out += leaf[node - inner]
        trees.append((feat, cut, leaf))
    return start, trees


def isotonic(margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; the curve as points (mean margin, share of class 1), smoothed by one example of the prior."""
    blocks: list[list[float]] = []  # weight, weighted label, weighted margin
    for i in np.argsort(margin, kind="stable"):
        blocks.append([w[i], w[i] * y[i], w[i] * margin[i]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    prior = (w * y).sum() / w.sum()
    return np.array([b[2] / b[0] for b in blocks]), np.array([(b[1] + prior * w.mean()) / (b[0] + w.mean()) for b in blocks])


def train(x: np.ndarray, y: np.ndarray, w: np.ndarray, calibrate: np.ndarray, lexicon: dict[str, float]) -> Model:
    """Trees from the rows that are not for calibration, the curve from those that are."""
    start, trees = boost(x[~calibrate], y[~calibrate], w[~calibrate])
    m = Model(lexicon, start, trees, np.zeros(0), np.zeros(0))
    rows = calibrate if len(set(y[calibrate])) > 1 else np.ones(len(y), bool)
    m.steps_x, m.steps_y = isotonic(m.margin(x[rows]), y[rows], w[rows])
    return m


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Model from ``doc_id, text`` and ``doc_id, toxic`` (0 or 1; other labels and null ids are left out).

    ``per_class`` bounds the rows of a class that are looked at; weights undo the
    choice, which is made among ids before any text moves. Each half of the rows meets
    the lexicon that the other half gave, as unseen texts do; the model keeps the
    lexicon of all. Without both classes every score is 0.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int")).distinct()
    part = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(10)).cast("int")
    chosen = sample_by_hash(known, F.col("doc_id"), "toxic", per_class).withColumn("part", part)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    picked = materialize(texts.join(F.broadcast(chosen), "doc_id"))
    halves = [mine_lexicon(picked.where(f"part % 2 = {1 - k}")) for k in (0, 1)]
    at = ["toxic", "_share", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = [Weights(x) for x in halves]
        for b in batches:
            x = [np.array(features(t.as_py(), weights[p % 2])).tobytes() for t, p in zip(b["text"], b["part"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in at), pa.array(x, pa.binary())], [*at, "x"])

    got = sorted(tuple(r) for r in picked.select("text", *at).mapInArrow(run, "toxic int, _share double, part int, x binary").collect())
    lexicon = mine_lexicon(picked)
    if len({r[0] for r in got}) < 2:
        return Model(lexicon, 0.0, [], np.zeros(0), np.zeros(0))
    y = np.array([r[0] for r in got], float)
    w = 1 / np.array([r[1] for r in got])
    x = np.frombuffer(b"".join(bytes(r[3]) for r in got)).reshape(len(got), len(NAMES))
    return train(x, y, w, np.array([r[2] for r in got]) >= 7, lexicon)


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``df`` plus ``score`` (0 to 1) and ``predicted`` (1 from ``THRESHOLD`` on).

    Null and empty texts are scored as texts without words. Equal texts get
    equal scores; columns of the two names are replaced.
    """
    df = df.drop("score", "predicted")
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(model.lexicon)
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                b = whole.slice(k, 512)
                x = np.array([features(t.as_py(), weights) for t in b.column(at)]).reshape(-1, len(NAMES))
                s = model.score(x)
                more = [pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "score", "predicted"])

    return df.mapInArrow(run, _schema(df, "score double, predicted int"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of all ``documents``; labels are learned from rows not held out only.

    Null and empty texts are scored as any other; null ids are not held out; repeated rows stay
    repeated; without a usable label all scores are equal; an empty table gives no rows.
    """
    out = held_out(F.col("doc_id"), 2, 4)
    rows = docs.select("doc_id", "text")
    return score(rows, fit(rows, labels.where(~out))).select("doc_id", out.alias("held_out"), "score", "predicted")
