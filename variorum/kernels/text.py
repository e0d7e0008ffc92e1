"""Normal forms that need Unicode decomposition, and tokens; the rest are Column functions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

#: fixed values: decorative punctuation
PUNCT = ".,;:·⸳"
_PUNCT = re.compile(f"[{PUNCT}]")
#: fixed values: graphemes of more than one code point or outside ASCII, and the plain letters
GRAPHEMES = (
    "ə̄u", "aō", "aē", "āu", "āi", "ōi", "ou", "ai", "au", "ā̊", "ą̇", "ə̄", "t̰", "x́", "xᵛ", "ŋ́", "ŋᵛ", "š́", "ṣ̌", "ṇ", "ń", "ɱ", "ġ", "γ", "δ", "ẏ", "č", "ž", "β",
    "ā", "ą", "ō", "ē", "ū", "ī", "a", "o", "ə", "e", "u", "i",
    "k", "x", "g", "c", "j", "t", "ϑ", "d", "p", "b", "ŋ", "n", "m", "y", "v", "r", "l", "s", "z", "š", "h", "uu", "ii",
)
_GRAPHEME = re.compile("|".join(map(re.escape, sorted((g for g in GRAPHEMES if len(g) > 1), key=len, reverse=True))) + "|.", re.S)
#: fixed values: representatives of graphemes that count as one in feature keys
EQUIVALENT = {
    "ae": "aē", "ao": "aō", "ou": "ō", "ii": "ī", "uu": "ū", "ṣ̌": "š", "ś": "š", "ṣ": "š", "š́": "š",
    "ṇ": "n", "ń": "n", "ŋ́": "ŋ", "ŋᵛ": "ŋ", "ϑ": "t",
}


def nfc(s: str) -> str:
    return unicodedata.normalize("NFC", s)


def squeeze(s: str) -> str:
    return " ".join(s.split())


def base_form(s: str) -> str:
    """Compatibility decomposition without combining marks, lower case."""
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()


def without_marks(s: str) -> str:
    """Canonical decomposition without nonspacing marks, composed again."""
    return nfc("".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn"))


def no_punct(s: str) -> str:
    return _PUNCT.sub("", s)


def bare(s: str) -> str:
    """Composed, without decorative punctuation, spaces squeezed."""
    return squeeze(no_punct(nfc(s)))


#: fixed values: phonological classes, applied in this order
CLASSES = (("aē", "ae"), ("aō", "ao"), ("ē", "e"), ("ō", "o"), ("ā", "a"), ("ī", "i"), ("ū", "u"), ("ṣ̌", "s"), ("š", "s"), ("ś", "s"), ("ṣ", "s"), ("ṇ", "n"), ("ϑ", "t"))
_INITIAL_Y = re.compile(r"\b[yY](?=[aāeēiīoōuū])")


def phonological(s: str) -> str:
    for a, b in CLASSES:
        s = s.replace(a, b)
    return _INITIAL_Y.sub("", s)


def compare_form(s: str) -> str:
    """What two tokens must share to count as the same word in comparisons."""
    return phonological(base_form(bare(s)))


def search_form(s: str) -> str:
    """Base form for searching: no brackets, no decorative punctuation, spaces squeezed."""
    return squeeze(re.sub(rf"[\[\]{PUNCT}]", "", base_form(s)))


def plain(s: str) -> str:
    """Composed, spaces squeezed, no final full stops."""
    return squeeze(nfc(s)).rstrip(".")


def token_key(t: str) -> str:
    """What the aligners compare: composed, no spaces, no decorative punctuation, lower case."""
    return no_punct(nfc(t).replace(" ", "")).lower()


def stanza_token(t: str) -> str:
    return nfc(t).replace("⸳", ".").replace("⁛", "").strip().lower()


def graphemes(word: str) -> list[str]:
    return _GRAPHEME.findall(squeeze(nfc(word)))


def compared_tokens(text: str) -> list[str]:
    """White-space tokens without the punctuation inside them; empty ones dropped."""
    return [t for t in map(no_punct, nfc(text).split()) if t]


def base_tokens(text: str) -> list[str]:
    return [base_form(t) for t in re.split(r"[.\s]+", nfc(text)) if t]


def canonical_feature(s: str) -> str:
    """``A for B`` as ``A→B``; only the first separator counts."""
    s = squeeze(nfc(s))
    for mark in ("→", " for "):
        if mark in s:
            a, b = s.split(mark, 1)
            return f"{a.strip()}→{b.strip()}"
    return s


_SKELETON = (
    (re.compile(r"[ą̇aeoāąēōūīəə̄ēyẏ\d]"), ""),
    (re.compile(r"([^u])u([^u])"), r"\1\2"),
    (re.compile(r"([^i])i([^i])"), r"\1\2"),
)
#: fixed values: consonant classes of the matching skeleton, merged in this order
MERGED = (
    ("ŋ", ("ŋ́", "ŋᵛ")), ("s", ("š", "š́", "ṣ")), ("mh", ("m̨",)), ("x", ("θ", "x́")), ("y", ("ẏ",)), ("n", ("ń",)), ("x́", ("xᵛ",)), ("t", ("δ", "t", "t̰")),
)


def skeleton(word: str) -> str:
    for pattern, to in _SKELETON:
        word = pattern.sub(to, word)
    for to, those in MERGED:
        for one in those:
            word = word.replace(one, to)
    return word


def families_normal(text: str, families: list[dict]) -> tuple[bool, str, str]:
    """Every pattern of every family replaced by ``§``: (any hit, first family hit, text)."""
    first = ""
    for f in families:
        hits = 0
        for p in compiled(f):
            text, n = p.subn("§", text)
            hits += n
        if hits and not first:
            first = f["family"]
    return bool(first), first, text


_compiled: dict[tuple, list[re.Pattern]] = {}


def compiled(family: dict) -> list[re.Pattern]:
    key = (*family["patterns"], None, *family["compare_only"])
    if key not in _compiled:
        _compiled[key] = [re.compile(p, re.I) for p in (*family["patterns"], *family["compare_only"])]
    return _compiled[key]


def compose(*steps: Callable[[str], str]) -> Callable[[str], str]:
    def run(s: str) -> str:
        for f in steps:
            s = f(s)
        return s

    return run
