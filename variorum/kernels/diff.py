"""Atomic differences between a lemma and a reading, as feature strings."""

from __future__ import annotations

from .gestalt import nearest, opcodes
from .text import EQUIVALENT, canonical_feature, compare_form, compared_tokens, graphemes, nfc, no_punct, plain, squeeze


def _atoms(lemma: list[str], reading: list[str], replace, name=lambda g: g) -> list[str]:
    """Differences of two grapheme or token lists: ``replace`` turns an evenly replaced pair into features."""
    out: list[str] = []
    for op, a, b, c, d in opcodes(lemma, reading):
        if op == "equal":
            continue
        if op == "replace" and b - a == d - c:
            for x, y in zip(lemma[a:b], reading[c:d], strict=True):
                out += replace(x, y)
        else:
            out += [f"{name(x)} deleted" for x in lemma[a:b]]
            out += [f"{name(y)} inserted" for y in reading[c:d]]
    return out


def grapheme_ops(lemma: str, reading: str) -> list[str]:
    """``A→B`` from reading to lemma, ``X inserted``, ``X deleted`` between two tokens."""
    return _atoms(graphemes(lemma), graphemes(reading), lambda x, y: [f"{y}→{x}"] if x != y else [])


def atomic_ops(lemma: str, reading: str) -> list[str]:
    """Grapheme differences over all differing tokens; tokens equal in compare form are passed."""
    out: list[str] = []
    left, right = compared_tokens(lemma), compared_tokens(reading)
    for op, a, b, c, d in opcodes(left, right):
        if op == "replace" and b - a == d - c:
            for x, y in zip(left[a:b], right[c:d], strict=True):
                if compare_form(x) != compare_form(y):
                    out += grapheme_ops(x, y)
        elif op != "equal":
            out += [f"{g} deleted" for t in left[a:b] for g in graphemes(t)]
            out += [f"{g} inserted" for t in right[c:d] for g in graphemes(t)]
    return [canonical_feature(x) if " for " in x else x for x in out]


def equivalent_ops(manual: str, ocr: str) -> list[str]:
    """Changes from a manual to an OCR word, graphemes by their representatives."""
    rep = lambda g: EQUIVALENT.get(g, g)
    trim = lambda s: squeeze(nfc(s)).rstrip(".,;:·⸳")
    return _atoms(graphemes(trim(manual)), graphemes(trim(ocr)), lambda x, y: [f"{rep(y)}→{rep(x)}"] if x != y else [], rep)


def token_feature(lemma: str, reading: str) -> str:
    """One token inserted, deleted or put for another; else ``subst`` or ``no_change``."""
    left, right = ([t for t in nfc(x).split() if no_punct(t)] for x in (lemma, reading))
    if left == right:
        return "no_change"
    for long, short, verb in ((right, left, "inserted"), (left, right, "deleted")):
        if len(long) == len(short) + 1:
            for i, t in enumerate(long):
                if long[:i] + long[i + 1 :] == short:
                    return f"{t} {verb}"
    if len(left) == len(right):
        pairs = [(x, y) for x, y in zip(left, right, strict=True) if compare_form(x) != compare_form(y)]
        if len(pairs) == 1:
            return f"{pairs[0][1]} for {pairs[0][0]}"
    return "subst"


def inferred_feature(lemma: str, reading: str, aggressive: bool = False, known: frozenset[str] | None = None) -> str:
    """The single feature that describes a reading. ``known`` are catalogue features, sought fuzzily if aggressive."""
    lemma, reading = plain(lemma), plain(reading)
    if not reading:
        return "deleted"
    if not lemma:
        return f"{reading} inserted" if len(reading.split()) == 1 else "inserted"
    if lemma == reading:
        return "no_change"
    if not aggressive:
        if len(lemma) == len(reading) and sum(x != y for x, y in zip(lemma, reading, strict=True)) == 1:
            return f"{reading} for {lemma}"
        left, right = lemma.split(), reading.split()
        if len(left) == len(right) and sum(x != y for x, y in zip(left, right, strict=True)) == 1:
            return f"{right[0]}→{left[0]}"
        return "subst"
    feature = token_feature(lemma, reading)
    canon = feature.replace(" for ", "→")
    if known is not None and feature not in ("subst", "no_change"):
        if canon in known:
            return canon
        near, s = nearest(canon, sorted(known), 0.6)
        if near is not None and s >= 0.6:
            return near
    a, b = compare_form(lemma), compare_form(reading)
    if a != b and len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1:
        return canon
    return canon if known and canon in known else "subst"


#: fixed values: diphthong alternations looked for, in this order
DIPHTHONGS = (("ō", "aō"), ("aō", "ō"), ("ē", "aē"), ("aē", "ē"), ("ai", "aē"), ("aē", "ai"), ("ōi", "ō"), ("ō", "ōi"), ("ou", "ōu"), ("ōu", "ou"))


def concise_diphthong(lemma: str, reading: str) -> str:
    """First diphthong alternation that the first differing token pair shows, lemma to reading; else empty."""
    for x, y in zip(compared_tokens(lemma), compared_tokens(reading), strict=False):
        if compare_form(x) != compare_form(y):
            x, y = nfc(x), nfc(y)
            return next((f"{a}→{b}" for a, b in DIPHTHONGS if a in x and b in y), "")
    return ""
