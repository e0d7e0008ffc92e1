"""Windowed left-to-right matching of a manuscript's tokens to a canon, and what follows from it."""

from __future__ import annotations

from functools import lru_cache
from itertools import pairwise

from .gestalt import edit_distance, ratio, reaches
from .text import skeleton, stanza_token

_skeleton = lru_cache(maxsize=100_000)(skeleton)

CLAIMED = 0.95  # similarity at which a token counts as well matched elsewhere
SLACK, MERGED_SLACK, EDITS = 2, 3, 2
CROSSING, GAIN = 12, 0.05


def _one_edit(x: str, y: str) -> bool:
    """Whether the edit distance is at most 1: what lies between the common beginning and the common end is one character at most."""
    if x == y:
        return True
    if len(x) > len(y):
        x, y = y, x
    n, m = len(x), len(y)
    if m - n > 1:
        return False
    for i in range(n):
        if x[i] != y[i]:
            return x[i:] == y[i + 1 :] or (n == m and x[i + 1 :] == y[i + 1 :])
    return True


def same_word(a: str, b: str) -> bool:
    """Equal, or equal but for one edit in their consonant skeletons; empty words match nothing."""
    if not a or not b:
        return False
    return a == b or _one_edit(_skeleton(a), _skeleton(b))


@lru_cache(maxsize=100_000)
def _spelled(t: str) -> str:
    return t.replace("ii", "ai").replace("ə̄", "ē")


def spelling_ratio(a: str, b: str, floor: float = 0.0) -> float:
    """Best similarity over the common alternate spellings of either side; -1 where none can reach ``floor``."""
    pairs = {(x, y): None for x in (a, _spelled(a)) for y in (b, _spelled(b))}
    return max((ratio(x, y) for x, y in pairs if floor <= 0 or reaches(x, y, floor)), default=-1.0)


_token = lru_cache(maxsize=100_000)(stanza_token)


@lru_cache(maxsize=100_000)
def _dotless(t: str) -> str:
    return _token(t).replace(".", "")


def _close(a: str, b: str, slack: int) -> bool:
    return (a in b or b in a) and abs(len(a) - len(b)) <= slack


def _near(a: str, b: str) -> bool:
    return abs(len(a) - len(b)) <= EDITS and edit_distance(a, b) <= EDITS


def _alike(a: str, b: str, floor: float) -> bool:
    return a == b or (reaches(a, b, floor) and ratio(a, b) >= floor)


class Bags:
    """Words as bit sets of their characters, repeated ones told apart: two words share as many characters as their sets share bits."""

    def __init__(self) -> None:
        self.bit: dict[tuple[str, int], int] = {}
        self.known: dict[str, list[list]] = {}

    def of(self, word: str) -> int:
        out, seen = 0, {}
        for ch in word:
            n = seen[ch] = seen.get(ch, 0) + 1
            b = self.bit.get((ch, n))
            if b is None:
                b = self.bit[ch, n] = 1 << len(self.bit)
            out |= b
        return out

    def spellings(self, word: str) -> list[list]:
        """[length, set, text] of a word and of its alternate spelling; the set is made when a length first asks for it."""
        out = self.known.get(word)
        if out is None:
            other = _spelled(word)
            out = self.known[word] = [[len(word), None, word]] if other == word else [[len(word), None, word], [len(other), None, other]]
        return out

    def best(self, ours: list[list], theirs: list[list], floor: float) -> float:
        """Highest ratio of a spelling of ``theirs`` to one of ``ours``, -1 if none can reach ``floor``: only those are compared whose lengths and common characters allow for it."""
        top = -1.0
        for one in theirs:
            n = one[0]
            for other in ours:
                m = other[0]
                need = floor * (n + m)
                if 2 * n < need or 2 * m < need:
                    continue
                if one[1] is None:
                    one[1] = self.of(one[2])
                if other[1] is None:
                    other[1] = self.of(other[2])
                if 2 * (one[1] & other[1]).bit_count() >= need:
                    top = max(top, ratio(one[2], other[2]))
        return top


class Matcher:
    """State of one alignment: ``at[c]`` is the manuscript index matched to canon token c, or None.

    ``good`` holds, by canon token without full stops, where it is well matched and to what. It is kept by
    :meth:`put`, so that no match has to be looked for among all equal tokens of a line.
    """

    def __init__(self, canon: list[str], our: list[str]):
        self.canon, self.our = canon, our
        self.key, self.bare = [_token(t) for t in canon], [_dotless(t) for t in canon]
        self.our_key, self.our_bare = [_token(t) for t in our], [_dotless(t) for t in our]
        self.at: list[int | None] = [None] * len(canon)
        self.good: dict[str, dict[int, int]] = {}

    def put(self, c: int, o: int) -> None:
        self.at[c] = o
        b = self.bare[c]
        self.good.get(b, {}).pop(c, None)
        if _alike(b, self.our_bare[o], CLAIMED):
            self.good.setdefault(b, {})[c] = o

    def claimed(self, members, excluded, o: int) -> bool:
        """Whether an equal token of some member, outside ``excluded``, is well matched to another manuscript token."""
        for c in members:
            for t, other in self.good.get(self.bare[c], {}).items():
                if other != o and t not in excluded(c):
                    return True
        return False

    def place(self, window: int, threshold: float, max_span: int) -> None:
        """Each manuscript token in turn takes the best free canon token or run after the last one taken."""
        n, last, bags = len(self.canon), -1, Bags()
        bones = [_skeleton(t) if t else None for t in self.canon]
        singles = [bags.spellings(t) for t in self.key]
        runs: list[list[tuple[int, list]] | None] = [None] * n
        for o, word in enumerate(self.our):
            lo = last + 1
            if lo >= n:
                break  # no canon token is left
            top, hit = -1.0, None
            stop = min(n, lo + window * 3 + 1)
            if word:
                bone = _skeleton(word)
                for c in range(lo, stop):
                    if bones[c] is not None and (self.canon[c] == word or _one_edit(bones[c], bone)):
                        top, hit = 1.0, (c, 1)
                        break
            if hit is None:
                ours = bags.spellings(self.our_key[o])
                for c in range(lo, stop):  # what stays below the threshold decides nothing; of equal ones the first is taken
                    mark = bags.best(ours, singles[c], max(threshold, top))
                    if mark > top and mark >= threshold:
                        top, hit = mark, (c, 1)
                if top < threshold:
                    hit, top = self._runs(o, ours, lo, window, max_span, threshold, runs, bags)
            if hit and top >= threshold:
                c, k = hit
                for x in range(c, c + k):
                    self.put(x, o)
                last = c + k - 1

    def _runs(self, o, ours, lo, window, max_span, threshold, runs, bags):
        n, top, hit = len(self.canon), -1.0, None
        for c in range(lo, min(n, lo + window * 3)):
            if runs[c] is None:  # read once for a line, as many manuscript tokens meet them
                runs[c] = []
                for k in range(2, min(max_span, n - c) + 1):
                    glued = dict.fromkeys((stanza_token(".".join(self.canon[c : c + k])), stanza_token("".join(self.canon[c : c + k]))))
                    runs[c].append((k, [x for t in glued for x in bags.spellings(t)]))
            for k, read in runs[c]:
                mark = bags.best(ours, read, max(threshold, top))
                if mark > top and mark >= threshold:
                    run = range(c, c + k)
                    if not self.claimed(run, lambda _, run=run: run, o):
                        top, hit = mark, (c, k)
            if top >= CLAIMED:
                break
        return hit, top

    def _open_right(self, c: int) -> bool:
        return self.at[c] is not None and self.at[c + 1] is None and self.bare[c] != self.our_bare[self.at[c]]

    def _joins(self, c: int, o: int) -> bool:
        """Whether canon tokens c and c+1 together read as manuscript token o, and neither is claimed elsewhere."""
        both, word = self.bare[c] + self.bare[c + 1], self.our_bare[o]
        if not _near(both, word) and not _close(both, word, SLACK):
            return False
        return not self.claimed((c, c + 1), lambda x: (x,), o)

    def merge(self) -> None:
        """Fused words: the next canon token joins a match that lacks it. One pass finds all: a join opens nothing before it, and only adds claims."""
        spots = range(len(self.canon) - 1)
        for c in spots:
            if self._open_right(c) and self._joins(c, self.at[c]):
                self.put(c + 1, self.at[c])
        for c in spots:
            if self.at[c] is None and self.at[c + 1] is not None and self._joins(c, self.at[c + 1]):
                self.put(c, self.at[c + 1])

    def uncross(self) -> None:
        """Swap inverted matches where that reads better."""
        n = len(self.canon)
        matched = [o for o in self.at if o is not None]
        if all(a <= b for a, b in pairwise(matched)):
            return  # nothing is inverted
        fit = lambda c, o: ratio(self.bare[c], self.our_bare[o])
        for c in range(n):
            for d in range(c + 1, min(n, c + 1 + CROSSING)):
                a, b = self.at[c], self.at[d]
                if a is not None and b is not None and a > b and fit(c, b) + fit(d, a) > fit(c, a) + fit(d, b) + GAIN:
                    self.put(c, b)
                    self.put(d, a)

    def records(self, threshold: float) -> list[dict]:
        """One record a canon token, one an unused manuscript token, and the merged ones; sorted."""
        out = []
        cut = lambda t: t[:-1] if t.endswith(".") else t

        def add(cs, os, canon, our, relation, matched):
            out.append({"canon_indexes": cs, "our_indexes": os, "canon_word": canon, "our_word": our, "relation": relation, "matched": matched})

        users: dict[int, list[int]] = {}
        for c, o in enumerate(self.at):
            if o is not None:
                users.setdefault(o, []).append(c)
        for c, o in enumerate(self.at):
            if o is None:
                add([c], [], self.canon[c], "", "delete", False)
            else:
                kind = "many-to-one" if len(users[o]) > 1 else "equal" if self.key[c] == self.our_key[o] else "substitution"
                add([c], [o], self.canon[c], self.our[o], kind, True)
        for o, word in enumerate(self.our):
            if o not in users:
                add([], [o], "", word, "insert", False)
        for o, cs in users.items():
            if len(cs) > 1:
                whole = ".".join(cut(self.canon[c]) for c in cs) + "."
                a, b = _dotless(whole), self.our_bare[o]
                good = _near(a, b) or _alike(a, b, CLAIMED) or (a and _close(a, b, MERGED_SLACK))
                if good and not self.claimed(cs, lambda _, cs=cs: cs, o):
                    add(cs, [o], whole, self.our[o], "many-to-one (merged)", True)
        taken: set[int] = set()
        for c, o in enumerate(self.at):
            for other in (o - 1, o + 1) if o is not None else ():
                if not 0 <= other < len(self.our) or other in taken or other in users:
                    continue
                os = sorted((o, other))
                whole = ".".join(cut(self.our[x]) for x in os) + "."
                key = stanza_token(whole)
                a, b = key.replace(".", ""), self.bare[c]
                if _close(a, b, MERGED_SLACK) or _alike(key, self.key[c], max(threshold, 0.9)) or _near(a, b):
                    add([c], os, self.canon[c], whole, "one-to-many (merged)", True)
                    taken.update(os)
        end = float("inf")
        return sorted(out, key=lambda r: (min(r["canon_indexes"][:1], default=end), min(r["our_indexes"][:1], default=end)))


def match(canon: list[str], our: list[str], window: int = 3, threshold: float = 0.68, max_span: int = 3) -> list[dict]:
    m = Matcher(canon, our)
    m.place(window, threshold, max_span)
    m.merge()
    m.uncross()
    return m.records(threshold)


def greedy_groups(records: list[dict]) -> list[tuple[list[int], list[int]]]:
    """Merged records, then runs of canon tokens that share one manuscript token."""
    groups = [(r["canon_indexes"], r["our_indexes"]) for r in records if r["relation"] == "many-to-one (merged)"]
    runs: list[tuple[list[int], list[int]]] = []
    for r in sorted((r for r in records if r["matched"] and "merged" not in r["relation"]), key=lambda r: r["canon_indexes"]):
        (c,), (o,) = r["canon_indexes"], r["our_indexes"]
        if runs and runs[-1][0][-1] + 1 == c and runs[-1][1] == [o]:
            runs[-1][0].append(c)
        else:
            runs.append(([c], [o]))
    return [(sorted(c), sorted(set(o))) for c, o in groups + runs]


def anchored(canon: list[str], our: list[str], skip: int = 10, budget: int = 15, anchor: int = 3) -> list[tuple[int, int]]:
    """Pairs of a book-length match from the first place where ``anchor`` words agree.

    Maximises matches, then minimises steps; up to ``skip`` words of either side may
    be passed at once, ``budget`` in a row. Filler words W and Y are passed freely.
    Works from the end over (canon, our, errors) without recursion.
    """
    start = next(
        ((c, o) for c in range(len(canon) - anchor + 1) for o in range(len(our) - anchor + 1)
         if all(same_word(canon[c + k], our[o + k]) for k in range(anchor))),
        None,
    )
    if start is None:
        return []
    c0, o0 = start
    canon, our = canon[c0:], our[o0:]
    n, m = len(canon), len(our)
    # value: (matches, -steps); kept for the next `skip` rows only, with the choice for all
    value: dict[int, list[list[tuple[int, int]]]] = {}
    choice: dict[tuple[int, int, int], tuple[int, int, int]] = {}
    done = (0, 0)

    def at(c: int, o: int, e: int) -> tuple[int, int]:
        return done if c >= n or o >= m or e > budget else value[c][o][e]

    for c in range(n - 1, -1, -1):
        value[c] = [[done] * (budget + 1) for _ in range(m)]
        value.pop(c + skip + 1, None)
        for o in range(m - 1, -1, -1):
            agree = same_word(canon[c], our[o])
            for e in range(budget + 1):
                if canon[c] in ("W", "Y"):
                    moves = [(1, 0, e)]
                elif our[o] in ("W", "Y"):
                    moves = [(0, 1, e)]
                else:
                    moves = [(1, 1, 0)] if agree else []
                    moves += [(0, k, e + k) for k in range(1, skip + 1)] + [(k, 0, e + k) for k in range(1, skip + 1)]
                best = None
                for dc, do, e2 in moves:
                    hits, cost = at(c + dc, o + do, e2)
                    mark = (hits + (dc == do), cost - 1)
                    if best is None or mark > best[0]:
                        best = (mark, (dc, do, e2))
                value[c][o][e], choice[c, o, e] = best
    pairs, c, o, e = [], 0, 0, 0
    while c < n and o < m and e <= budget:
        dc, do, e = choice[c, o, e]
        if dc == do:
            pairs.append((c0 + c, o0 + o))
        c, o = c + dc, o + do
    return pairs
