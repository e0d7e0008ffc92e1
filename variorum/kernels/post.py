"""Trimming of readings that took in words of their neighbours."""

from __future__ import annotations

import re
from functools import lru_cache

from .gestalt import ratio
from .text import PUNCT, nfc, no_punct, squeeze, token_key


@lru_cache(maxsize=200_000)
def _like(a: str, b: str, least: float) -> bool:
    return ratio(token_key(a), token_key(b)) >= least


def drop_neighbours(reading: str, lemma: list[str], before: list[list[str]], after: list[list[str]], least: float = 0.50) -> str:
    """Leading tokens like the first of a lemma before, and trailing ones like the last of one after, go while too many are left.

    ``before`` and ``after`` hold the nearest lemmas first.
    """
    tokens = reading.split()
    for lem in before:
        while lem and len(tokens) > len(lemma) and _like(tokens[0], lem[0], least):
            tokens = tokens[1:]
    for lem in after:
        while lem and len(tokens) > len(lemma) and _like(tokens[-1], lem[-1], least):
            tokens = tokens[:-1]
    return " ".join(tokens) if tokens and lemma else reading


def _fused_key(s: str) -> str:
    return no_punct("".join(nfc(s).split())).lower()


def bigram_jaccard(a: str, b: str) -> float:
    if not a or not b:
        return float(a == b)
    x, y = ({s[i : i + 2] for i in range(len(s) - 1)} for s in (a, b))
    return len(x & y) / len(x | y) if x | y else float(a == b)


def trim_fused(lemma: str, reading: str, least: float = 0.80, too_long: float = 1.4) -> str:
    """For a one-token lemma, the window of an over-long reading that looks most like it."""
    want, have = _fused_key(lemma), _fused_key(reading)
    if " " in squeeze(lemma) or not want or not have or have == want or len(have) <= int(len(want) * too_long):
        return reading
    source = nfc(reading)
    where = [i for i, c in enumerate(source) if not c.isspace() and c not in PUNCT]
    lengths = range(max(1, len(want) - 2), min(len(have), len(want) + 2) + 1)
    spots = [(a, a + n) for n in lengths for a in range(len(have) - n + 1)]
    a, b = max(spots, key=lambda s: bigram_jaccard(want, have[s[0] : s[1]]), default=(0, len(have)))
    cut = source[where[a] : where[b - 1] + 1]
    key = _fused_key(cut)
    good = have.count(want) >= 2 or bigram_jaccard(want, key) >= least
    return cut if good and key and key != have else reading


_trim_fused = lru_cache(maxsize=50_000)(trim_fused)


def trimmed_line(lemmas: list[str], readings: list[str]) -> list[str]:
    """The readings of a line's lemmas: what they hold of the two lemmas before and behind goes, then what a fused reading holds beyond its lemma."""
    words = [(x or "").split() for x in lemmas]
    out = []
    for k, (lemma, reading) in enumerate(zip(lemmas, readings, strict=True)):
        lemma, reading = lemma or "", reading or ""
        if len(reading.split()) > len(words[k]):
            before = [words[i] if i >= 0 else [] for i in (k - 1, k - 2)]
            reading = drop_neighbours(reading, words[k], before, [words[i] if i < len(words) else [] for i in (k + 1, k + 2)])
        out.append(_trim_fused(lemma, reading))
    return out


def best_window(lemma: str, reading: str) -> str:
    """For a lemma of several tokens, the window of as many reading tokens that fits best token by token."""
    left, right = lemma.split(), reading.split()
    n = len(left)
    if n <= 1 or len(right) <= n:
        return reading

    def fit(start: int) -> float:
        total = 0.0
        for a, b in zip(left, right[start : start + n], strict=True):
            s = ratio(token_key(a), token_key(b))
            total += (max(s, 0.05) if s > 0 else 0.0) + 0.05 * (a.count(".") == b.count(".") and a.endswith(".") == b.endswith("."))
        return total

    at = max(range(len(right) - n + 1), key=fit)
    return " ".join(right[at : at + n])


def dot_segments(text: str) -> list[str]:
    """White-space tokens cut after inner full stops."""
    return [s for t in text.split() for s in re.split(r"(?<=\.)(?=[^.])", t) if s]


def trim_by_segments(lemma: list[str], reading: str) -> str:
    """The run of dot segments that reads most like the lemma, starting and covering its ends; else by length from its first word."""
    parts = dot_segments(reading)
    if not parts or not lemma:
        return reading
    join = lambda ts: "".join(map(token_key, ts))
    like = lambda a, b: ratio(token_key(a), token_key(b))
    whole, first = join(lemma), token_key(lemma[0])
    starts = [i for i, p in enumerate(parts) if like(p, lemma[0]) >= 0.5 or token_key(p).startswith(first[:3])]
    best = None
    for i in starts:
        for j in range(i + 1, len(parts) + 1):
            s = ratio(join(parts[i:j]), whole)
            score = s - 0.02 * max(0, j - i - len(lemma))
            if s >= 0.6 and (best is None or score > best[0]) and max(like(p, lemma[-1]) for p in parts[i:j]) >= 0.5:
                best = (score, i, j)
            if j - i > len(lemma) + 2 and s < 0.5:
                break
    if best:
        return " ".join(parts[best[1] : best[2]])
    if not starts:
        return reading
    j = starts[0] + 1
    while j < len(parts) and len(join(parts[starts[0] : j])) < len(whole) - 2:
        j += 1
    return " ".join(parts[starts[0] : j])
