"""Pre-token split of the byte-level tokenizers: one rule for both operators that need it.

Pieces of a text are the matches of ``public_tokenizers.PATTERN``. Where a text
holds no character on which Python's ``re`` and that pattern could differ, the
faster ``re`` is used with an equal pattern; other texts go through ``regex``
with the white space of Unicode written out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import public_tokenizers
import regex

#: fixed values: characters of Unicode's White_Space
_SPACE = r"\t-\r \x85\xa0  -     　"
#: letters and digits mean the same to re below U+0250 but for these number signs; re also takes \x1c-\x1f for white space
_ODD = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbeɐ-\U0010ffff]")
# letters first: no other alternative begins with a letter, or with a space before one
_FAST = re.compile(r" ?[^\W\d_]+| ?\d+|'(?:[stmd]|re|ve|ll)| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


@cache
def _exact() -> regex.Pattern:
    spaced = public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^{_SPACE}\p{{L}}\p{{N}}]")
    return regex.compile(spaced.replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]"))


def _odd(text: str) -> bool:
    if text.isascii():
        return any(c in text for c in "\x1c\x1d\x1e\x1f")
    return _ODD.search(text) is not None


def pieces(text: str) -> list[str]:
    """Pre-tokens of the text in order; joined they give the text."""
    return (_exact() if _odd(text) else _FAST).findall(text)


def each_piece(text: str) -> Iterator[str]:
    """The same one by one: a very long text need not stand beside all its pieces."""
    return (m[0] for m in (_exact() if _odd(text) else _FAST).finditer(text))
