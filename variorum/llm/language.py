"""Language identification in two steps: family first, then one-versus-one linear SVMs inside it.

Features are hashed character 1- to 3-grams of the whole lower-cased text.
Training sees a sample chosen by hash, bounded per language (``PER_LANG``) and in all (``SAMPLE``);
predictions run over Arrow batches with a few small weight vectors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small

DIMS = 4096
PER_LANG = 400  # training documents of a language at most, as an expected number
SNIPPET = 48  # characters of the short extra example cut from each training document
UNDETERMINED = "und"
SAMPLE = 8000  # training documents of all languages together, as an expected number: languages share them equally where PER_LANG each would be more
MOST_LANGS = 512  # languages in the sample: those with most documents
MIN_SCORE = 0.2  # below it a text fits no known language

#: fixed values: families by language code; a code that is not listed is a family of its own
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be bg mk sr hr bs sl cs sk pl",
    "indic": "hi ur bn pa gu mr ne si",
    "semitic": "ar he mt am",
    "turkic": "tr az kk uz tk ky",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "sinitic": "zh yue",
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

_OTHER = re.compile(r"[\W\d_]+")
_MULT = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def features(text: str | None) -> np.ndarray | None:
    """Unit vector of ``DIMS`` hashed n-gram counts (square roots); None without a letter."""
    letters = _OTHER.sub(" ", (text or "").lower()).strip()
    if not letters:
        return None
    counts = np.zeros(DIMS, np.float32)
    letters = f" {letters} "
    for k in range(0, len(letters), 1 << 20):  # bounded memory for very long texts; n-grams over a seam count in the next part
        c = np.frombuffer(letters[max(0, k - 2) : k + (1 << 20)].encode("utf-32-le"), np.uint32)
        skip = min(k, 2)
        one = c * _MULT[0]
        two = (one[:-1] ^ (c[1:] * _MULT[1])) * _MULT[0]
        three = (two[:-1] ^ (c[2:] * _MULT[2])) * _MULT[1]
        for h, n in ((one, 1), (two, 2), (three, 3)):
            h = h[max(0, skip - n + 1) :]
            counts += np.bincount(h >> np.uint32(20), minlength=DIMS)
    v = np.sqrt(counts)
    return v / np.linalg.norm(v)


@dataclass
class Model:
    """Linear heads: one per family against the rest, one per language pair of a family."""

    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, DIMS + 1), np.float32))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    pairs: list[tuple[str, str, str]] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score (probability by the calibrated margins) of each row of ``x``."""
        margins = (x @ self.weights[:, :-1].T + self.weights[:, -1]) * self.scale
        sure = 1 / (1 + np.exp(-np.clip(margins, -30, 30)))
        nf = len(self.families) if len(self.families) > 1 else 0
        if nf:
            p = sure[:, :nf] / sure[:, :nf].sum(1, keepdims=True)
            best = p.argmax(1)
            score = p.max(1)
        else:
            best, score = np.zeros(len(x), int), np.ones(len(x))
        out = np.empty(len(x), object)
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(best == f)
            langs = self.members[name]
            wins = np.full((len(rows), len(langs)), 1.0)
            for k, (fam, a, b) in enumerate(self.pairs):
                if fam == name:
                    q = sure[rows, nf + k]
                    wins[:, langs.index(a)] *= q
                    wins[:, langs.index(b)] *= 1 - q
            wins /= wins.sum(1, keepdims=True) + 1e-300
            out[rows] = np.array(langs, object)[wins.argmax(1)]
            score[rows] *= wins.max(1)
        return out.tolist(), score


def _svm(x: np.ndarray, y: np.ndarray, c: float = 2000.0, rounds: int = 120) -> np.ndarray:
    """Weights and bias of a linear SVM (squared hinge, classes weighed equally) by Nesterov steps."""
    sign = np.where(y, 1.0, -1.0).astype(np.float32)
    w_row = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum())).astype(np.float32) * c
    w = np.zeros(x.shape[1] + 1, np.float32)
    ahead, step = w.copy(), 1.0 / (1.0 + 4.0 * c)
    for t in range(rounds):
        pull = 2 * w_row * sign * np.maximum(0, 1 - sign * (x @ ahead[:-1] + ahead[-1]))
        new = ahead - step * (ahead - np.append(pull @ x, pull.sum()))
        ahead = new + t / (t + 3) * (new - w)
        w = new
    return w


def _platt(margin: np.ndarray, y: np.ndarray) -> float:
    """Slope of the logistic curve that fits the margins best, on a short grid."""
    m = np.where(y, margin, -margin)
    grid = np.geomspace(0.5, 32, 25)
    return float(min(grid, key=lambda a: np.log1p(np.exp(-np.clip(a * m, -30, 30))).mean() + 1e-4 * a))


def train(x: np.ndarray, langs: list[str]) -> Model:
    """``x``: feature rows; ``langs``: their languages."""
    names = np.array(langs, object)
    fam = np.array([FAMILY_OF.get(v.lower().split("-")[0], f"={v}") for v in langs], object)
    m = Model(sorted(set(fam)))
    m.members = {f: sorted(set(names[fam == f])) for f in m.families}
    heads, scales = [], []

    def head(rows: np.ndarray, y: np.ndarray) -> None:
        seen = x[rows].astype(np.float32)  # the only whole copy beside the sample of 16 bits
        w = _svm(seen, y)
        heads.append(w)
        scales.append(_platt(seen @ w[:-1] + w[-1], y))

    if len(m.families) > 1:
        for f in m.families:
            head(np.arange(len(x)), fam == f)
    for f in m.families:
        for a, b in combinations(m.members[f], 2):
            rows = np.flatnonzero((names == a) | (names == b))
            head(rows, names[rows] == a)
            m.pairs.append((f, a, b))
    m.weights = np.array(heads, np.float32).reshape(-1, DIMS + 1)
    m.scale = np.array(scales)
    return m


def sample_by_hash(df: DataFrame, key: Column, stratum: str, cap: int) -> DataFrame:
    """About ``cap`` rows of each value of ``stratum``, chosen by the hash of ``key``; all where there are fewer.

    Adds ``_share``, the part of the stratum that is kept.
    """
    sizes = df.groupBy(stratum).count().withColumn("_share", F.least(F.lit(1.0), F.lit(float(cap)) / F.col("count")))
    unit = F.pmod(F.xxhash64(F.lit(7), key), F.lit(1 << 30)) / F.lit(1 << 30)
    return df.join(small(sizes.drop("count")), stratum).where(unit < F.col("_share"))


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training rows: the whole text, and a short cut from it; features as 16-bit floats."""
    for b in batches:
        lang, rows = [], []
        for t, v in zip(b["text"].to_pylist(), b["lang"].to_pylist(), strict=True):
            mid = max(0, len(t) // 2 - SNIPPET // 2)
            for part in (t, t[mid : mid + SNIPPET]):
                x = features(part)
                if x is not None:
                    lang.append(v)
                    rows.append(x.astype(np.float16).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(rows, pa.binary())], ["lang", "x"])


def held_out(doc_id: Column, fold: int, folds: int) -> Column:
    """Whether crc32 of the id as text has the remainder ``fold`` by ``folds``; null ids are not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, per_lang: int = PER_LANG, sample: int = SAMPLE, most_langs: int = MOST_LANGS) -> Model:
    """Model of the languages in ``lang`` over (doc_id, text, lang); null texts and languages are left out.

    The driver gets two vectors of 8 KB for each document of the sample, which holds about ``per_lang``
    of each of the ``most_langs`` languages with most documents (ties by name), and about ``sample`` of
    all. Rows are chosen by their hash, copies count once, so reruns agree and neither null nor
    repeated ids make it larger. Without a labelled row the model knows no language.
    """
    rows = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    langs = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs)
    known = [r["lang"] for r in langs.collect()]  # most_langs at most
    if not known:
        return Model()
    picked = sample_by_hash(rows.where(F.col("lang").isin(known)), F.struct("doc_id", "text"), "lang", max(1, min(per_lang, sample // len(known))))
    picked = picked.select("text", "lang").distinct()
    got = sorted((r[0], bytes(r[1])) for r in picked.mapInArrow(_examples, "lang string, x binary").collect())
    if not got:
        return Model()
    x, langs = np.empty((len(got), DIMS), np.float16), [r[0] for r in got]
    for k in range(len(got)):
        x[k], got[k] = np.frombuffer(got[k][1], np.float16), None
    return train(x, langs)


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``df`` plus ``lang_pred`` and ``score`` (0 to 1).

    Texts that are null or hold no letter, and all texts under a model without
    languages, are ``und`` with score 0. Ties go to the first language by name.
    Repeated rows get equal results; columns of the two names are replaced; an empty table gives no rows.
    """
    df = df.drop("lang_pred", "score")
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                b = whole.slice(k, 512)
                x = [features(t.as_py()) for t in b.column(at)] if model.families else [None] * b.num_rows
                lang, score = np.full(b.num_rows, UNDETERMINED, object), np.zeros(b.num_rows)
                rows = [i for i, v in enumerate(x) if v is not None]
                if rows:
                    lang[rows], score[rows] = model.predict(np.array([x[i] for i in rows]))
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(lang.tolist(), pa.string()), pa.array(score)], [*b.schema.names, "lang_pred", "score"]
                )

    return df.mapInArrow(run, _schema(df, "lang_pred string, score double"))


def _schema(df: DataFrame, more: str):
    from pyspark.sql.types import StructType

    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def keep_identified(docs: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, lang and more) whose language is found with a score of ``least`` or more.

    A null ``lang`` is filled with what was found; other values stay. Null and empty
    texts and texts without a letter go, as do all where no language can be learned;
    repeated rows stay repeated; an empty table gives no rows. Further columns stay,
    also those named ``lang_pred`` or ``score``.
    """
    model = fit(docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id"), 1, 3)))
    # numbered names can't meet the added ones
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    found = predict(docs.toDF(*own.values()), model, own["text"]).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least))
    return found.withColumn(own["lang"], F.coalesce(own["lang"], "lang_pred")).select(*[F.col(n).alias(c) for c, n in own.items()])


def identify_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of all ``documents``; learned from those not held out.

    Null texts, and those without a letter, are ``und`` with score 0; null ids are not held out and not
    learned from; repeated rows stay repeated; an empty table gives no rows.
    """
    rows = docs.select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 1, 3)
    model = fit(rows.where(~out & F.col("doc_id").isNotNull()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score")
