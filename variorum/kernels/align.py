"""Alignment of two token sequences: dynamic programming, opcode and greedy forms."""

from __future__ import annotations

import numpy as np

from .gestalt import SHORT, opcodes, ratio, reaches
from .ratios import Alphabet, Strings, common, ratios
from .text import nfc, stanza_token, token_key

Op = tuple[str, int, int, int, int]
#: fixed values: penalty of a gap, least gain of a pair, floor and bonus of a run
GAP = -0.6
FLOOR = 0.10
RUN_FLOOR, RUN_BONUS = 0.5, 0.05

_FEW = 100  # pairs that are compared sooner one by one


def _ratios(a: Strings, b: Strings) -> np.ndarray:
    """ratio() of all distinct strings; of none or one letter in common it needs no search."""
    out = np.zeros((len(a.strings), len(b.strings)))
    for lo, both in common(a, b):
        part = out[lo : lo + len(both)]
        x, y = a.sizes[lo : lo + len(both), None], b.sizes[None, :]
        plain = (both == 1) & (x <= SHORT) & (y <= SHORT)
        np.divide(2.0, x + y, out=part, where=plain)
        i, j = np.nonzero(((both > 0) & ~plain) | (x + y == 0))
        part[i, j] = ratios(a, b, i + lo, j)
    return out


def _runs(keys: list[str], b: Strings, max_run: int, turned: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Length and end of the runs of ``keys``, places of ``b`` that reach the floor with them, and what they gain (``turned``: by ratio(b, run))."""
    spans = [(k, i) for k in range(max_run, 1, -1) for i in range(k, len(keys) + 1)]
    a = Strings(["".join(keys[i - k : i]) for k, i in spans], b.alphabet)
    k, end = np.array(spans, np.int32).reshape(-1, 2).T
    order = np.argsort(a.at, kind="stable")
    found = []
    for lo, both in common(a, b):
        # letters in common decide first, then those in order, and ratio()
        i, j = np.nonzero(both >= RUN_FLOOR / 2 * (a.sizes[lo : lo + len(both), None] + b.sizes[None, :]))
        s = ratios(b, a, j, i + lo, RUN_FLOOR) if turned else ratios(a, b, i + lo, j, RUN_FLOOR)
        high = s >= RUN_FLOOR
        s = s[high]
        hit = np.zeros(both.shape, np.int32)
        hit[i[high], j[high]] = np.arange(1, len(s) + 1)
        here = order[np.searchsorted(a.at[order], lo) : np.searchsorted(a.at[order], lo + len(both))]
        for few in np.array_split(here, -(-len(here) // len(both)) or 1):
            cells = hit[a.at[few] - lo][:, b.at]
            i, j = np.nonzero(cells)
            at = few[i]
            found.append((k[at], end[at], j.astype(np.int32), s[cells[i, j] - 1] + RUN_BONUS * (k[at] - 1)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (*[np.zeros(0, np.int32)] * 3, np.zeros(0))


def _path(moves: list[tuple[int, int]], one: np.ndarray, left: np.ndarray, right: np.ndarray, gap: float, runs: tuple | None = None) -> tuple[list[int], float]:
    """Moves of the best path, as their numbers in text order, and its total; of equal moves the first counts.

    ``moves`` are steps on both sides, the last three a pair, which gains ``one`` at (left, right), and the gaps;
    ``runs`` (move, i, j, gain) are what the others gain. Cells of a diagonal, which don't depend on one another, are filled at once.
    """
    n, m, count = len(left), len(right), len(moves)
    pad, keep = max(i for i, _ in moves), max(i + j for i, j in moves) + 1
    width = n + 1 + pad
    ring = np.full((keep, width), -np.inf)  # the last diagonals, by left place
    ring[0, pad] = 0.0
    before = np.array([[[(d - i - j) % keep * width + pad - i] for i, j in moves] for d in range(keep)]) + np.arange(n + 1)
    gain = np.full((count, n + 1), -np.inf)
    gain[-2:] = gap
    flat = gain.reshape(-1)
    if runs:
        move, i, j, more = runs
        order = np.argsort(i + j, kind="stable")
        starts = np.searchsorted((i + j)[order], np.arange(n + m + 2)).tolist()
        spot, more = (move * (n + 1) + i)[order], more[order]
    dense = one[left][:, right].reshape(-1) if n * m <= 1 << 22 else None
    came: list[tuple[int, np.ndarray]] = [(0, np.zeros(1, np.int8))]
    for d in range(1, n + m + 1):
        lo, hi, a, b = max(0, d - m), min(n, d), max(1, d - m), min(n, d - 1)
        if a <= b:
            if dense is not None:
                first = (a - 1) * m + d - a - 1
                gain[-3, a : b + 1] = dense[first : first + (b - a) * (m - 1) + 1 : m - 1] if a < b else dense[first]
            else:
                gain[-3, a : b + 1] = one[left[a - 1 : b], right[d - b - 1 : d - a][::-1]]
        some = spot[starts[d] : starts[d + 1]] if runs else ()
        if len(some):
            flat[some] = more[starts[d] : starts[d + 1]]
        cells = ring.take(before[d % keep, :, lo : hi + 1])
        cells += gain[:, lo : hi + 1]
        row = ring[d % keep]
        row.fill(-np.inf)
        np.maximum.reduce(cells, axis=0, out=row[pad + lo : pad + hi + 1])
        came.append((lo, cells.argmax(axis=0).astype(np.int8)))
        if len(some):
            flat[some] = -np.inf
    path: list[int] = []
    i, j = n, m
    while i or j:
        lo, arrow = came[i + j]
        path.append(int(arrow[i - lo]))
        di, dj = moves[path[-1]]
        i, j = i - di, j - dj
    return path[::-1], float(ring[(n + m) % keep, pad + n])


def align(lemma: list[str], witness: list[str], max_run: int = 4) -> list[Op]:
    """Best path of match, merge (several lemma tokens to one), split, delete and insert, in text order.

    Every cell takes the best of its predecessors; of equal ones the first by
    (lemma, witness) position stays, which fixes the result.
    """
    lk, wk = [token_key(t) for t in lemma], [token_key(t) for t in witness]
    alphabet = Alphabet([*lk, *wk])
    left, right = Strings(lk, alphabet), Strings(wk, alphabet)
    one = _ratios(left, right)
    one = np.where(one > 0, np.maximum(one, FLOOR), 0.0)
    # runs of either side that reach the floor, longest first, merges before splits
    lengths = range(max_run, 1, -1)
    moves = [("merge", k, 1) for k in lengths] + [("split", 1, k) for k in lengths] + [("match", 1, 1), ("delete", 1, 0), ("insert", 0, 1)]
    k, i, j, gain = _runs(lk, right, max_run, False)
    k2, j2, i2, gain2 = _runs(wk, left, max_run, True)
    runs = [np.concatenate(x) for x in ((max_run - k, 2 * max_run - 1 - k2), (i, i2 + 1), (j + 1, j2), (gain, gain2))]
    steps, _ = _path([x[1:] for x in moves], one, left.at, right.at, GAP, tuple(runs))
    path: list[Op] = []
    i = j = 0
    for op, di, dj in map(moves.__getitem__, steps):
        path.append((op, i, i + di, j, j + dj))
        i, j = i + di, j + dj
    return path


def coverage(ops: list[Op], n: int) -> list[list[int]]:
    """Witness indices of each of ``n`` lemma tokens."""
    out: list[list[int]] = [[] for _ in range(n)]
    for _, a, b, c, d in ops:
        for i in range(a, b):
            out[i].extend(range(c, d))
    return out


def surfaces(ops: list[Op], lemma: list[str], witness: list[str]) -> list[tuple[int, int, str]]:
    """(start, end, reading) of every operation on the lemma and of every single lemma token, sorted."""
    out = {(a, b): " ".join(witness[c:d]) for op, a, b, c, d in ops if op != "insert"}
    for i, at in enumerate(coverage(ops, len(lemma))):
        out.setdefault((i, i + 1), " ".join(witness[w] for w in sorted(set(at))))
    return [(a, b, s) for (a, b), s in sorted(out.items())]


def _diff_keys(tokens: list[str]) -> list[str]:
    return [nfc(t.lstrip(".")) for t in tokens]


def differing(lemma: list[str], witness: list[str]) -> list[int]:
    """Lemma positions outside the equal runs of the two sequences."""
    return sorted({i for op, a, b, _, _ in opcodes(_diff_keys(lemma), _diff_keys(witness)) if op != "equal" for i in range(a, b)})


def opcode_spans(lemma: list[str], witness: list[str]) -> list[tuple[int, int, str]]:
    """(start, end, reading) by difference runs: whole where one side has one token, token by token elsewhere."""
    out = []
    for op, a, b, c, d in opcodes(_diff_keys(lemma), _diff_keys(witness)):
        if op == "insert":
            continue
        if op == "replace" and (b - a == 1) != (d - c == 1):
            out.append((a, b, " ".join(witness[c:d])))
        else:
            out += [(i, i + 1, witness[c + i - a] if c + i - a < d else "") for i in range(a, b)]
    return sorted(out)


def greedy_spans(lemma: list[str], witness: list[str], max_run: int = 4, threshold: float = 0.75) -> list[tuple[int, int, str]]:
    """Left-to-right spans: the longest fused or split run at ``threshold``, else one to one."""
    out, i, j = [], 0, 0

    def longest(one: str, many: list[str], witness_first: bool) -> int:
        runs = range(min(max_run, len(many)), 1, -1)
        keys = {k: token_key("".join(many[:k])) for k in runs}
        return next((k for k in runs if ratio(one, keys[k]) >= threshold), 1)

    while i < len(lemma) and j < len(witness):
        fused = longest(token_key(witness[j]), lemma[i:], True)
        split = 1 if fused > 1 else longest(token_key(lemma[i]), witness[j:], False)
        out.append((i, i + fused, " ".join(witness[j : j + split])))
        i, j = i + fused, j + split
    return out + [(k, k + 1, "") for k in range(i, len(lemma))]


def reading_of(lemma: list[str], witness: list[str], a: int, b: int) -> str:
    """Witness text for lemma tokens [a, b), by difference runs; inside uneven runs a token's place is proportional."""
    out: list[str] = []
    for op, i1, i2, j1, j2 in opcodes(_diff_keys(lemma), _diff_keys(witness)):
        if i2 <= a or i1 >= b:
            continue
        if b - a > 1:
            if op == "equal":
                lo, hi = max(i1, a), min(i2, b)
                out += witness[j1 + lo - i1 : j1 + hi - i1]
            else:
                out += witness[j1:j2]
            continue
        width = j2 - j1
        if width:
            off = a - i1
            out.append(witness[j1 + (off if width == i2 - i1 else min(width - 1, int(off / (i2 - i1) * width)))])
        break
    return " ".join(out).strip()


def compounds(lemma: list[str], witness: list[str], max_run: int = 4, threshold: float = 0.75) -> list[tuple[int, int, int]]:
    """(lemma start, lemma end, witness index) where one witness token stands for a run of lemma tokens.

    Tokens inside equal runs take no part. A run fits by similarity above the threshold,
    or if the witness token begins with its first and holds its last token; the
    shortest, then first, fitting run that is still free is taken.
    """
    lk, wk = _diff_keys(lemma), _diff_keys(witness)
    equal = [(a, b, c, d) for op, a, b, c, d in opcodes(lk, wk) if op == "equal"]
    taken = {i for a, b, _, _ in equal for i in range(a, b)}
    settled = {j for _, _, c, d in equal for j in range(c, d)}
    out = []
    for j, word in enumerate(wk):
        runs = ((i, i + k) for k in range(2, min(max_run, len(lemma)) + 1) for i in range(len(lemma) - k + 1))
        fits = (
            (a, b) for a, b in runs
            if taken.isdisjoint(range(a, b))
            and (ratio(word, "".join(lk[a:b])) > threshold or (len(word) > len(lk[a]) and word.startswith(lk[a]) and lk[b - 1] in word))
        )
        found = None if j in settled else next(fits, None)
        if found:
            out.append((*found, j))
            taken.update(range(*found))
    return out


def needleman(canon: list[str], our: list[str], gap: float = -0.25) -> tuple[list[tuple[list[int], list[int]]], float]:
    """Global alignment by token similarity; ties prefer pairing, then a canon gap, then ours.

    Consecutive pairs form one group; every gap is a group of its own. Also the score.
    """
    ck, ok = ([stanza_token(t).replace(".", "") for t in x] for x in (canon, our))
    alphabet = Alphabet([*ck, *ok])
    left, right = Strings(ck, alphabet), Strings(ok, alphabet)
    same = np.where((left.sizes[:, None] > 0) & (right.sizes[None, :] > 0), _ratios(left, right), 0.0)
    moves = [(1, 1), (1, 0), (0, 1)]
    steps, score = _path(moves, same, left.at, right.at, gap)
    groups: list[tuple[list[int], list[int]]] = []
    i = j = 0
    for di, dj in map(moves.__getitem__, steps):
        c, o = list(range(i, i + di)), list(range(j, j + dj))
        i, j = i + di, j + dj
        if c and o and groups and groups[-1][0] and groups[-1][1]:
            groups[-1][0].extend(c)
            groups[-1][1].extend(o)
        else:
            groups.append((c, o))
    return groups, score


def _reaching(canon: list[str], our: list[str], threshold: float) -> list[tuple[int, int]]:
    """Places of the pairs of no empty word that reach the threshold, the most similar first, then in order; letters in common decide before ratio()."""
    if len(canon) * len(our) <= _FEW:
        pairs = [(ratio(x, y), i, j) for i, x in enumerate(canon) for j, y in enumerate(our) if x and y and reaches(x, y, threshold)]
        return [(i, j) for s, i, j in sorted(pairs, key=lambda p: -p[0]) if s >= threshold]
    alphabet = Alphabet([*canon, *our])
    a, b = Strings(canon, alphabet), Strings(our, alphabet)
    like = np.full((len(a.strings), len(b.strings)), -np.inf)
    for lo, both in common(a, b):
        x, y = a.sizes[lo : lo + len(both), None], b.sizes[None, :]
        i, j = np.nonzero((2 * both.astype(np.int64) >= threshold * (x + y)) & (x > 0) & (y > 0))
        like[i + lo, j] = ratios(a, b, i + lo, j, threshold)
    like = like[a.at][:, b.at]
    i, j = np.nonzero(like >= threshold)
    order = np.argsort(-like[i, j], kind="stable")
    return list(zip(i[order].tolist(), j[order].tolist(), strict=True))


def pair_groups(groups: list[tuple[list[int], list[int]]], canon: list[str], our: list[str], threshold: float = 0.90) -> list[list[int]]:
    """Canon indices of each of our tokens: inside a group of several on both sides, best pairs at ``threshold`` first."""
    out: list[list[int]] = [[] for _ in our]
    key = lambda t: stanza_token(t).replace(".", "")
    for cs, os in groups:
        if len(cs) <= 1 or len(os) == 1:
            for o in os:
                out[o].extend(cs)
            continue
        pairs = _reaching([key(canon[c]) for c in cs], [key(our[o]) for o in os], threshold)
        free_c, free_o = dict.fromkeys(cs), dict.fromkeys(os)
        for x, y in pairs:
            c, o = cs[x], os[y]
            if c in free_c and o in free_o:
                out[o].append(c)
                del free_c[c], free_o[o]
        if len(free_o) == 1:
            out[next(iter(free_o))].extend(free_c)
    return out
