"""Gestalt similarity, argument order kept: ratio(a, b) may differ from ratio(b, a)."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher
from functools import lru_cache


SHORT = 48  # characters up to which substrings are sought directly, which is faster than the library's index for words


def _matched(a: str, b: str) -> int:
    """Characters in common blocks: the longest one, the first in ``a`` and then in ``b`` of equal ones, and so on to its left and right."""
    total, todo = 0, [(a, b)]
    while todo:
        a, b = todo.pop()
        i = n = 0
        for k in range(len(a)):
            if k + n >= len(a):
                break  # nothing longer is left
            while k + n < len(a) and a[k : k + n + 1] in b:
                i, n = k, n + 1
        if n:
            j = b.find(a[i : i + n])
            total += n
            if i and j:
                todo.append((a[:i], b[:j]))
            if i + n < len(a) and j + n < len(b):
                todo.append((a[i + n :], b[j + n :]))
    return total


@lru_cache(maxsize=200_000)
def ratio(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if len(a) <= SHORT and len(b) <= SHORT:
        return 2.0 * _matched(a, b) / (len(a) + len(b)) if not set(a).isdisjoint(b) else 0.0
    return SequenceMatcher(None, a, b).ratio()


def reaches(a: str, b: str, floor: float) -> bool:
    """Whether ratio(a, b) can be ``floor`` or more, by lengths and then by the characters both have."""
    total = len(a) + len(b)
    if not total:
        return True
    if 2 * min(len(a), len(b)) < floor * total:
        return False
    return 2 * sum(min(a.count(c), b.count(c)) for c in set(a)) >= floor * total


def opcodes(a: Sequence[str], b: Sequence[str]) -> list[tuple[str, int, int, int, int]]:
    return SequenceMatcher(None, a, b).get_opcodes()


def nearest(key: str, keys: Sequence[str], cutoff: float) -> tuple[str | None, float]:
    """First key of highest ratio(key, k), if that is positive and at least ``cutoff``."""
    best, top = None, 0.0
    for k in keys:
        r = ratio(key, k)
        if r > top:
            best, top = k, r
    return (best, top) if best is not None and top >= cutoff else (None, 0.0)


@lru_cache(maxsize=100_000)
def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]
