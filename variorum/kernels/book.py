"""Pieces of the book-length matcher: words that match, increasing anchors, and the best chain of matches of a stretch."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import numpy as np

from .greedy import _skeleton, edit_distance

SKIP, BUDGET = 10, 15  # words passed in one move, and between two matches, of both sides together
_BEFORE, _BESIDE = np.array([(d, e) for d in range(BUDGET + 1) for e in range(BUDGET + 1 - d)]).T  # words passed on either side, fewest first
_COST = -(-_BEFORE // SKIP) - (-_BESIDE // SKIP)  # the moves that this takes
_MATCH, _NONE, _AT_ONCE = 1 << 32, -(1 << 62), 2048


def _cut(word: str) -> set[str]:
    """The word, and the word without one of its letters: two words at most one edit apart share one of these."""
    return {word, *(word[:k] + word[k + 1 :] for k in range(len(word)))}


def matching(canon: Sequence[str], our: Sequence[str]) -> list[list[int]]:
    """For each canon word the places of our words that match it: equal, or at most one edit apart in their skeletons; empty words match nothing."""
    places: dict[str, list[int]] = {}
    for o, w in enumerate(our):
        if w:
            places.setdefault(w, []).append(o)
    near: dict[str, set[str]] = {}
    for w in places:
        for x in _cut(_skeleton(w)):
            near.setdefault(x, set()).add(w)
    found: dict[str, list[int]] = {"": []}
    for w in canon:
        if w not in found:
            s = _skeleton(w)
            likely = set().union(*(near.get(x, ()) for x in _cut(s)), {w} & places.keys())
            found[w] = sorted(o for x in likely if x == w or edit_distance(s, _skeleton(x)) <= 1 for o in places[x])
    return [found[w] for w in canon]


def increasing(points: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest chain of points that grow on both sides, from points in order of the first; by patience sorting."""
    tops: list[int] = []  # least second place of a chain of each length
    last: list[int] = []
    before: list[int] = []
    for k, (_, o) in enumerate(points):
        at = bisect_left(tops, o)
        if at == len(tops):
            tops.append(o)
            last.append(k)
        else:
            tops[at], last[at] = o, k
        before.append(last[at - 1] if at else -1)
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(tuple(points[k]))
        k = before[k]
    return out[::-1]


def cuts(points: Sequence[tuple[int, int]], apart: int) -> list[tuple[int, int]]:
    """Anchors of a longest chain, at least ``apart`` words after the one before on both sides."""
    out: list[tuple[int, int]] = []
    for c, o in increasing(points):
        if not out or (c - out[-1][0] >= apart and o - out[-1][1] >= apart):
            out.append((c, o))
    return out


def strong_start(rows: list[list[int]], last: int, canon_at: Sequence[int], our_at: Sequence[int]) -> tuple[int, int] | None:
    """The first place, by canon and then by our words, from which three words in a row match; not behind canon word ``last``.

    Words are in a row if their places in the book, ``canon_at`` and ``our_at``, are: no filler stands between.
    """
    sets = list(map(set, rows))
    for c in range(min(last + 1, len(rows) - 2)):
        if canon_at[c + 2] - canon_at[c] == 2:
            for o in rows[c]:
                if o + 1 in sets[c + 1] and o + 2 in sets[c + 2] and our_at[o + 2] - our_at[o] == 2:
                    return c, o
    return None


def chain(rows: list[list[int]], start: tuple[int, int], forced: bool, end: tuple[int, int] | None) -> tuple[list[tuple[int, int]], bool]:
    """Most matches in order from ``start`` (``forced``: itself the first match), at most ``BUDGET`` words passed between two; then fewest moves.

    With ``end`` (a match) the chain has to arrive there, and the second value tells whether it can; if not, and without
    ``end``, the chain ends where it is best.
    """
    s, t = start
    keep = BUDGET + 2  # the last rows of values, by our words from ``t`` on; as one number each: matches, less the moves
    width = max((r[-1] for r in rows if r), default=t) - t + keep + 1
    ring = np.full((keep, width), _NONE)
    held: list[np.ndarray] = [np.zeros(0, np.int64)] * keep  # where a row of the ring is filled
    prior: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    best, top = ((s, t), _MATCH - 1) if forced else (None, 0)
    # as if the words before had matched, if the start itself need not
    ring[(s - 1 + forced) % keep, keep - 1 + forced] = top
    held[(s - 1 + forced) % keep] = np.array([keep - 1 + forced])
    reach, filled, read = t - 1 + forced, s - 1 + forced, {}
    for c in range(s + forced, (end[0] if end else len(rows) - 1) + 1):
        ring[c % keep, held[c % keep]] = _NONE
        held[c % keep] = held[0][:0]
        if filled < c - BUDGET - 1:
            if c > s + BUDGET:
                break  # nothing is near enough to go on from
            continue
        places = read.get(id(rows[c]))
        if places is None:
            places = read[id(rows[c])] = np.array(rows[c], np.int64)
        # no farther than one can move from what is reached
        places = places[places.searchsorted(t + forced) : places.searchsorted(min(reach + BUDGET + 1, end[1] if end else reach + BUDGET + 1), "right")]
        if not len(places):
            continue
        back = (c - 1 - _BEFORE) % keep * width - t + keep - 1 - _BESIDE
        new, came = np.empty(len(places), np.int64), np.empty(len(places), np.int64)
        for k in range(0, len(places), _AT_ONCE):
            values = ring.take(places[k : k + _AT_ONCE, None] + back)
            values -= _COST
            came[k : k + _AT_ONCE] = values.argmax(axis=1)
            new[k : k + _AT_ONCE] = values[np.arange(len(values)), came[k : k + _AT_ONCE]]
        found = new > _NONE // 2
        if not found.any():
            continue
        places, new, came = places[found], new[found] + _MATCH - 1, came[found]
        held[c % keep] = places - t + keep
        ring[c % keep, held[c % keep]] = new
        prior[c] = places, came
        reach, filled = max(reach, int(places[-1])), c
        first = int(new.argmax())
        if new[first] > top:
            best, top = (c, int(places[first])), int(new[first])

    def before(at: tuple[int, int]) -> tuple[int, int] | None:
        places, came = prior.get(at[0], (held[0][:0], held[0][:0]))
        k = int(places.searchsorted(at[1]))
        if k == len(places) or places[k] != at[1]:
            return None
        return at[0] - 1 - int(_BEFORE[came[k]]), at[1] - 1 - int(_BESIDE[came[k]])

    arrived = end is not None and before(end) is not None
    at, out = end if arrived else best, []
    while at is not None:
        if at[0] >= s and at[1] >= t:
            out.append(at)
        at = before(at)
    return out[::-1], arrived


def stretch(canon: Sequence[str], our: Sequence[str], canon_at: Sequence[int], our_at: Sequence[int], first: bool, last: bool) -> dict:
    """Matches of a stretch, ``pairs``, and whether they arrive at its end.

    A stretch begins with a match, but for the ``first``, which begins where three words match; it ends with
    the match of the next one (the two words behind it included, as the start may need them), but for the ``last``.
    """
    rows = matching(canon, our)
    end = None if last else (len(canon) - 3, len(our) - 3)
    start = strong_start(rows, len(rows) if end is None else end[0], canon_at, our_at) if first else (0, 0)
    if start is None or (end is not None and start[1] > end[1]):
        start = end
    if start is None:
        return {"pairs": [], "arrived": False}
    if start == end:
        return {"pairs": [{"c": start[0], "o": start[1]}], "arrived": True}
    pairs, arrived = chain(rows, start, not first, end)
    return {"pairs": [{"c": c, "o": o} for c, o in pairs], "arrived": arrived}
