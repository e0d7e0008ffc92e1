"""Kernels in the shapes that DataFrame rows have; workers import this module, not the one that makes the UDFs."""

from __future__ import annotations

from functools import lru_cache

from . import align, greedy
from .gestalt import ratio
from .text import without_marks


@lru_cache(maxsize=4)  # equal pairs come one after the other
def _needleman(canon: tuple, our: tuple) -> tuple[list, float]:
    return align.needleman(list(canon), list(our))


@lru_cache(maxsize=4)
def _greedy(canon: tuple, our: tuple) -> list[dict]:
    return greedy.match(list(canon), list(our))


def greedy_records(canon, our) -> list[dict]:
    return _greedy(tuple(canon), tuple(our))


def greedy_column(canon, our):
    """The records of a whole Arrow batch, put into columns a hundred stanzas at a time: few are Python objects at once."""
    import pyarrow as pa

    index = pa.list_(pa.int32())
    fields = {"canon_indexes": index, "our_indexes": index, "canon_word": pa.string(), "our_word": pa.string(), "relation": pa.string(), "matched": pa.bool_()}
    kind = pa.list_(pa.struct(fields.items()))
    parts = [pa.array([], kind)]
    for i in range(0, len(canon), 100):
        some = zip(canon.slice(i, 100).to_pylist(), our.slice(i, 100).to_pylist(), strict=True)
        parts.append(pa.array([greedy_records(a or [], b or []) for a, b in some], kind))
    return pa.concat_arrays(parts)


@lru_cache(maxsize=200_000)
def _apart(a: str, b: str, vowels: str, low: float) -> bool:
    a, b = ("".join(c for c in without_marks(x) if c not in vowels) for x in (a, b))
    return a != b and ratio(a, b) < low


def apart_column(a, b, vowels, low):
    """Whether the words of two Arrow arrays differ without marks and vowels, and are less similar than ``low``; false where one is null."""
    import pyarrow as pa
    import pyarrow.compute as pc

    both = pc.and_(a.is_valid(), b.is_valid())
    found = both.to_numpy(zero_copy_only=False).copy()
    found[found] = [_apart(*x) for x in zip(*(c.filter(both).to_pylist() for c in (a, b, vowels, low)), strict=True)]
    return pa.array(found)


def count_below(a, b, low: float) -> int:
    """How many pairs are less similar than ``low``."""
    return sum(ratio(x or "", y or "") < low for x, y in zip(a, b, strict=True))


def group_positions(groups, n: int) -> list[list[int]]:
    """Canon indices of each of ``n`` manuscript words, from (canon, our) index groups."""
    out: list[set[int]] = [set() for _ in range(n)]
    for g in groups:
        for o in g["o"]:
            if 0 <= o < n:
                out[o].update(g["c"])
    return [sorted(x) for x in out]


def single_positions(records, n: int) -> list[list[int]]:
    """The same from greedy records of single manuscript words."""
    return group_positions([{"c": r["canon_indexes"], "o": r["our_indexes"]} for r in records if len(r["canon_indexes"]) and len(r["our_indexes"]) == 1], n)


def dp_positions(canon, our, threshold: float) -> list[list[int]]:
    """The same from the global alignment, groups of several on both sides paired by similarity."""
    return align.pair_groups(_needleman(tuple(canon), tuple(our))[0], list(canon), list(our), threshold)


def needleman_result(canon, our) -> dict:
    groups, score = _needleman(tuple(canon), tuple(our))
    return {"groups": [{"c": c, "o": o} for c, o in groups], "score": score}


def paired(groups, canon, our) -> list[list[int]]:
    return align.pair_groups([(list(g["c"]), list(g["o"])) for g in groups], canon, our)


def grouped_records(records) -> list[dict]:
    plain = [{k: list(r[k]) if k.endswith("indexes") else r[k] for k in ("canon_indexes", "our_indexes", "relation", "matched")} for r in records]
    return [{"c": c, "o": o} for c, o in greedy.greedy_groups(plain)]


def alignment(lemma, witness) -> dict:
    """Spans, witness indices of each lemma token and differing positions, from one alignment."""
    return _alignment(tuple(lemma), tuple(witness))


@lru_cache(maxsize=4)
def _alignment(lemma: tuple, witness: tuple) -> dict:
    lemma, witness = list(lemma), list(witness)
    ops = align.align(lemma, witness)
    spans = [dict(zip(("a", "b", "surface"), x, strict=True)) for x in align.surfaces(ops, lemma, witness)]
    return {"spans": spans, "cover": align.coverage(ops, len(lemma)), "diff": align.differing(lemma, witness)}
