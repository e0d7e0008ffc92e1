"""What a search pattern demands of a text: used to look patterns up instead of trying each."""

from __future__ import annotations

import re
from re import _constants as K
from re import _parser as P


def demanded(pattern: str | None) -> str | None:
    """The longest run of characters that every text the pattern finds must hold; empty if there is none, None if the pattern is broken."""
    try:
        tree = P.parse(pattern or "")
    except (re.error, OverflowError, RecursionError):
        return None
    if tree.state.flags & re.IGNORECASE:
        return ""
    best = run = ""
    for kind, value in _flat(tree):
        run = run + chr(value) if kind is K.LITERAL else ""
        best = max(best, run, key=len)
    return best


def _flat(tree):
    """Parts in order; groups that can't be left out count as what they hold."""
    for kind, value in tree:
        if kind is K.SUBPATTERN and not value[1] & re.IGNORECASE:
            yield from _flat(value[3])
        elif kind is not K.AT:  # places take no room
            yield kind, value


def found(pattern: str, text: str) -> bool:
    return re.search(pattern, text) is not None
