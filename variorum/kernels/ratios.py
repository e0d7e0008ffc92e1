"""gestalt.ratio() of many string pairs at once, by bit sets: the same blocks, found for all pairs in step."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

from .gestalt import ratio

LONG = 64  # characters of a string that one word of bits holds; longer ones are compared one by one
_TOGETHER, _CELLS = 4096, 1 << 20  # pairs compared in step, and cells of a matrix held at once
_ONE = np.uint64(1)


class Alphabet:
    """Numbers of the characters of some words, and of their repetitions up to the most that a word has."""

    def __init__(self, words: Sequence[str]):
        self.chars = np.unique(_points("".join(words)))
        s, _, c = self.read(words)
        most = np.zeros(len(self.chars) + 1, np.int64)
        np.maximum.at(most, c, _nth(s, c, len(self.chars)) + 1)
        self.most, self.first = most, np.cumsum(most) - most
        self.words = int(most.sum() + 63) // 64

    def read(self, strings: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """String, place and number of every character."""
        sizes = np.array([len(s) for s in strings], np.int64)
        s = np.repeat(np.arange(len(strings)), sizes)
        return s, np.arange(len(s)) - np.repeat(np.cumsum(sizes) - sizes, sizes), np.searchsorted(self.chars, _points("".join(strings)))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _nth(s: np.ndarray, c: np.ndarray, chars: int) -> np.ndarray:
    """How often a character stood in its string before."""
    key = s * (chars + 1) + c
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    index = np.arange(len(key))
    out = np.empty(len(key), np.int64)
    out[order] = index - np.maximum.accumulate(np.where(new, index, 0))
    return out


class Strings:
    """Distinct strings of a sequence, and which of them stands at each place; their characters are those of an alphabet."""

    def __init__(self, strings: Sequence[str], alphabet: Alphabet):
        ids: dict[str, int] = {}
        self.at = np.array([ids.setdefault(s, len(ids)) for s in strings], np.int64)
        self.strings, self.alphabet = list(ids), alphabet
        self.sizes = np.array([len(s) for s in ids], np.int64)
        self.s, self.place, self.c = alphabet.read(self.strings)
        nth = _nth(self.s, self.c, len(alphabet.chars))
        held = nth < alphabet.most[self.c]
        bit = (alphabet.first[self.c] + nth)[held]
        self.bags = np.zeros((alphabet.words, len(ids)), np.uint64)
        np.bitwise_or.at(self.bags, (bit >> 6, self.s[held]), _ONE << (bit & 63).astype(np.uint64))
        self._masks = self._letters = None

    def masks(self) -> np.ndarray:
        """The places of each character in each string, as bits; the last column, for no character, is empty."""
        if self._masks is None:
            self._masks = np.zeros((len(self.strings), len(self.alphabet.chars) + 1), np.uint64)
            near = self.place < LONG
            np.bitwise_or.at(self._masks, (self.s[near], self.c[near]), _ONE << self.place[near].astype(np.uint64))
        return self._masks

    def letters(self) -> np.ndarray:
        """The characters of each string by place, and no character behind its end."""
        if self._letters is None:
            near = self.place < LONG
            self._letters = np.full((len(self.strings), min(LONG, int(self.sizes.max(initial=0)))), len(self.alphabet.chars), np.int64)
            self._letters[self.s[near], self.place[near]] = self.c[near]
        return self._letters


def common(a: Strings, b: Strings) -> Iterator[tuple[int, np.ndarray]]:
    """Chunks of ``a`` with the letters that each of their strings shares with each of ``b``: first string, matrix.

    Exact if one of the two holds no character more often than the words of the alphabet.
    """
    step = max(1, _CELLS // max(1, len(b.strings)))
    for lo in range(0, len(a.strings), step):
        both = np.zeros((len(a.strings[lo : lo + step]), len(b.strings)), np.uint16)
        for x, y in zip(a.bags[:, lo : lo + step], b.bags, strict=True):
            both += np.bitwise_count(x[:, None] & y[None, :])
        yield lo, both


def ratios(a: Strings, b: Strings, i: np.ndarray, j: np.ndarray, least: float = 0.0) -> np.ndarray:
    """ratio() of the strings ``i`` of ``a`` and ``j`` of ``b``; 0 for those that can't reach ``least`` by the letters they share in order."""
    x, y = a.sizes[i], b.sizes[j]
    out = np.zeros(len(i))
    far = (x > LONG) | (y > LONG)
    for k in np.nonzero(far)[0]:
        out[k] = ratio(a.strings[i[k]], b.strings[j[k]])
    out[x + y == 0] = 1.0
    near = np.nonzero(~far & (np.minimum(x, y) > 0))[0]
    # the shorter side is gone through by characters, the longer one stands in bits
    turned = int(x[near].sum()) > int(y[near].sum())
    by, bits, p, q = (b, a, j, i) if turned else (a, b, i, j)
    near = near[np.argsort(by.sizes[p[near]], kind="stable")]
    masks, letters = bits.masks(), by.letters()
    for k in range(0, len(near), _TOGETHER):
        some = near[k : k + _TOGETHER]
        width = int(by.sizes[p[some[-1]]])
        # for each character of the one its places in the other, one row a character
        same = masks[q[some][None, :], letters[p[some], :width].T]
        total = (x + y)[some]
        if least > 0:
            fit = 2 * _in_order(same) >= least * total
            some, total, same = some[fit], total[fit], same[:, fit]
        out[some] = 2.0 * _matched(same, turned) / total
    return out


def _in_order(same: np.ndarray) -> np.ndarray:
    """Most letters that the strings of each pair share in order, which no common blocks exceed."""
    row = np.full(same.shape[1], ~np.uint64(0))
    for hit in same:
        u = row & hit
        row = (row + u) | (row - u)
    return LONG - np.bitwise_count(row).astype(np.int64)


def _matched(same: np.ndarray, turned: bool) -> np.ndarray:
    """Characters in common blocks of each pair: the longest block, the first in ``a`` and then in ``b`` of equal ones, and so on to its left and right.

    ``same`` has a row for each character of ``a`` with the bits of its places in ``b``; ``turned``: for each of ``b`` those in ``a``.
    """
    total = np.zeros(same.shape[1], np.int64)
    owner, same = _some(np.arange(same.shape[1]), same)
    while len(owner):
        size, row, low = (np.empty(len(owner), k) for k in (np.int64, np.int64, np.uint64))  # the blocks, and row and bit where they begin
        index, here, whole, k = np.arange(len(owner)), same, same, 1
        while len(index):
            # where k + 1 characters agree, of the pairs that agree in k
            more = here[:-1] & (whole[k:] >> np.uint64(k))
            going = np.bitwise_or.reduce(more, axis=0) != 0
            ended = ~going
            done = index[ended]
            if len(done):
                last = here[:, ended]
                if turned:
                    bit = np.bitwise_or.reduce(last, axis=0)
                    bit &= ~bit + _ONE
                    at = ((last & bit) != 0).argmax(axis=0)
                else:
                    at = (last != 0).argmax(axis=0)
                    bit = last[at, np.arange(len(at))]
                    bit &= ~bit + _ONE
                size[done], row[done], low[done] = k, at, bit
                index, more, whole = index[going], more[:, going], whole[:, going]
            here = more
            k += 1
        total += np.bincount(owner, size, len(total)).astype(np.int64)
        end = row + size
        # bits behind the block; none where it ends with the last one
        behind = low << np.minimum(size, LONG - 1).astype(np.uint64)
        behind = np.where((size >= LONG) | (behind == 0), np.uint64(0), ~(behind - _ONE))
        parts = []
        rows = np.arange(len(same))[:, None]
        for some, mask, kept in (((row > 0) & (low > 1), low - _ONE, rows < row), ((end < len(same)) & (behind != 0), behind, rows >= end)):
            some = np.nonzero(some)[0]
            part = same[:, some] & mask[some]
            part *= kept[:, some]
            parts.append(_some(owner[some], part))
        owner, same = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts], axis=1)
    return total


def _some(owner: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that have a character in common."""
    some = np.bitwise_or.reduce(same, axis=0) != 0
    return (owner, same) if some.all() else (owner[some], same[:, some])
