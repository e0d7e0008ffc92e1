from collections import Counter
from difflib import SequenceMatcher
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from variorum.kernels import align as A
from variorum.kernels import diff as D
from variorum.kernels import gestalt as S
from variorum.kernels import greedy as G
from variorum.kernels import post as P
from variorum.kernels import ratios as R
from variorum.kernels import text as T

words = st.lists(st.text("abcā.", min_size=1, max_size=4), max_size=5)


@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_gestalt_is_the_standard_librarys(a, b):
    assert S.ratio(a, b) == SequenceMatcher(None, a, b).ratio()
    assert S.reaches(a, b, 0.5) or S.ratio(a, b) < 0.5


def test_gestalt_keeps_argument_order():
    assert (S.ratio("tide", "diet"), S.ratio("diet", "tide")) == (0.25, 0.5)


@given(st.text("ab", max_size=6), st.text("ab", max_size=6))
def test_edit_distance_is_a_metric(a, b):
    assert S.edit_distance(a, b) == S.edit_distance(b, a) >= abs(len(a) - len(b))
    assert (S.edit_distance(a, b) == 0) == (a == b)


def best_score(lemma, witness):
    """Best total over all paths, by plain recursion."""
    key = T.token_key
    if not lemma and not witness:
        return 0.0
    options = []
    if lemma:
        options.append(best_score(lemma[:-1], witness) - 0.6)
    if witness:
        options.append(best_score(lemma, witness[:-1]) - 0.6)
    for k, m in product(range(1, 5), repeat=2):
        if (k == 1 or m == 1) and k <= len(lemma) and m <= len(witness):
            s = SequenceMatcher(None, "".join(map(key, lemma[-k:])), "".join(map(key, witness[-m:]))).ratio()
            if k == m == 1:
                s = max(s, 0.1) if s > 0 else 0.0
            elif s < 0.5:
                continue
            options.append(best_score(lemma[:-k], witness[:-m]) + s + 0.05 * (max(k, m) - 1))
    return max(options)


def path_score(ops, lemma, witness):
    total = 0.0
    for op, a, b, c, d in ops:
        s = SequenceMatcher(None, "".join(map(T.token_key, lemma[a:b])), "".join(map(T.token_key, witness[c:d]))).ratio()
        total += {"match": max(s, 0.1) if s > 0 else 0.0, "delete": -0.6, "insert": -0.6}.get(op, s + 0.05 * (max(b - a, d - c) - 1))
    return total


@settings(max_examples=60, deadline=None)
@given(words, words)
def test_alignment_is_best_and_covers_all(lemma, witness):
    ops = A.align(lemma, witness)
    assert [i for _, a, b, _, _ in ops for i in range(a, b)] == list(range(len(lemma)))
    assert [j for _, _, _, c, d in ops for j in range(c, d)] == list(range(len(witness)))
    assert path_score(ops, lemma, witness) == pytest.approx(best_score(lemma, witness))


@given(st.lists(st.text("abc", min_size=1, max_size=3), min_size=1, max_size=6))
def test_equal_sequences_only_match_and_differ_nowhere(x):
    assert {op for op, *_ in A.align(x, x)} == {"match"} and not A.differing(x, x)
    assert A.needleman(x, x)[0] == [(list(range(len(x))), list(range(len(x))))]
    assert all(r["relation"] == "equal" for r in G.match(x, x) if "merged" not in r["relation"]) or len(set(x)) < len(x)


def test_merge_split_and_spans():
    lemma, wit = "aaa bbb ccc ddd".split(), "aaabbb ccc dd d".split()
    assert [o[0] for o in A.align(lemma, wit)] == ["merge", "match", "split"]
    assert A.surfaces(A.align(lemma, wit), lemma, wit) == [(0, 1, "aaabbb"), (0, 2, "aaabbb"), (1, 2, "aaabbb"), (2, 3, "ccc"), (3, 4, "dd d")]
    assert A.opcode_spans("a b c".split(), "a x y".split()) == [(0, 1, "a"), (1, 2, "x"), (2, 3, "y")]
    assert A.opcode_spans("a b c d".split(), "a x d".split()) == [(0, 1, "a"), (1, 3, "x"), (3, 4, "d")]
    assert A.greedy_spans("aaa bbb kkkkk".split(), "aaabbb kkkkk".split()) == [(0, 2, "aaabbb"), (2, 3, "kkkkk")]
    assert A.reading_of("a b c d".split(), "a x y d".split(), 1, 3) == "x y" and A.reading_of("a b".split(), "a".split(), 1, 2) == ""
    assert A.compounds("aaa bbb ccc".split(), "aaabbb ccc".split()) == [(0, 2, 0)]


def test_pairing_inside_groups():
    groups = [([0, 1], [0, 1]), ([2], [2, 3]), ([3, 4], [4]), ([], [5])]
    assert A.pair_groups(groups, "ab cd e f g".split(), "cd ab e e fg z".split()) == [[1], [0], [2], [2], [3, 4], []]


def test_greedy_merges_and_uncrosses():
    got = G.match(["frā.", "mąm.", "yō."], ["frāmąm.", "yō."])
    assert [(r["canon_indexes"], r["our_indexes"], r["relation"]) for r in got] == [
        ([0], [0], "many-to-one"), ([0, 1], [0], "many-to-one (merged)"), ([1], [0], "many-to-one"), ([2], [1], "equal"),
    ]
    assert G.greedy_groups(got) == [([0, 1], [0]), ([0, 1], [0]), ([2], [1])]
    m = G.Matcher(["dafla", "kamna"], ["dafla", "kamna"])
    m.at = [1, 0]
    m.uncross()
    assert m.at == [0, 1]


def test_anchored_match_skips_noise():
    canon, our = "qqqq kkk lll mmm nnn ppp".split(), "zzzz xxxx kkk lll mmm junk nnn ppp".split()
    assert G.anchored(canon, our) == [(1, 2), (2, 3), (3, 4), (4, 6), (5, 7)]
    assert G.anchored("a b".split(), "c d".split()) == []


def test_atomic_differences():
    assert D.grapheme_ops("aōš", "ōš") == ["aō deleted", "ō inserted"] or D.grapheme_ops("aōš", "ōš") == ["ō→aō"]
    assert D.atomic_ops("ī", "ū") == ["ū→ī"]
    assert D.atomic_ops("ab cd", "ab") == ["c deleted", "d deleted"]
    assert D.token_feature("a b", "a b c") == "c inserted" and D.token_feature("a b", "a") == "b deleted" and D.token_feature("a x", "a y") == "y for x"
    assert D.inferred_feature("", "x") == "x inserted" and D.inferred_feature("x", "") == "deleted" and D.inferred_feature("abc", "abd") == "abd for abc"
    assert D.inferred_feature("a x", "a y", True, frozenset(["y→x"])) == "y→x"
    assert D.equivalent_ops("ii", "ī") == ["ī→ī"] or D.equivalent_ops("ii", "ī") == []
    assert D.concise_diphthong("zaōš", "zōx") == "aō→ō"


def test_graphemes_take_the_longest():
    assert T.graphemes("xᵛaōi z") == ["xᵛ", "aō", "i", " ", "z"]
    assert T.canonical_feature("a for b for c") == "a→b for c"


def test_trimming():
    assert P.trim_fused("abcd", "xxabcdyy") == "abcd" and P.trim_fused("ab cd", "xxabcdyy") == "xxabcdyy"
    assert P.best_window("ab cd", "zz ab cd") == "ab cd" and P.best_window("ab", "zz ab") == "zz ab"
    assert P.trim_by_segments(["ab.", "cd."], "zz.ab.cd.ef.") == "ab. cd."
    assert P.drop_neighbours("xx ab yy", ["ab"], [["xx"]], [["yy"]]) == "ab" and P.drop_neighbours("", ["ab"], [], []) == ""


def test_long_lines_are_aligned_in_seconds():
    """Two lines of 700 words took 12 seconds cell by cell."""
    import random
    import time

    rng = random.Random(4)
    words = ["".join(rng.choice("abdeghimnorst") for _ in range(rng.randint(2, 8))) for _ in range(120)]
    a = [rng.choice(words) for _ in range(700)]
    b = [w for w in a if rng.random() > 0.05]
    start = time.process_time()
    ops, (groups, score) = A.align(a, b), A.needleman(a, b)
    assert time.process_time() - start < 6
    assert [x for op in ops for x in range(op[1], op[2])] == list(range(len(a))) and [x for op in ops for x in range(op[3], op[4])] == list(range(len(b)))
    assert sum(len(c) for c, _ in groups) == len(a) and score > 600



@settings(max_examples=60)
@given(st.lists(st.text("abcā😀", max_size=9), min_size=1, max_size=6), st.lists(st.text("aābc", max_size=70), min_size=1, max_size=6))
def test_ratios_in_step_are_those_one_by_one(few, many):
    alphabet = R.Alphabet([*few, *many])
    for x, y in ((few, many), (many, few)):
        a, b = R.Strings(x, alphabet), R.Strings(y, alphabet)
        i, j = (k.ravel() for k in np.indices((len(a.strings), len(b.strings))))
        want = [SequenceMatcher(None, a.strings[p], b.strings[q]).ratio() for p, q in zip(i, j, strict=True)]
        assert R.ratios(a, b, i, j).tolist() == want
        some = R.ratios(a, b, i, j, 0.5)
        assert all(s == w if w >= 0.5 else s <= w for s, w in zip(some, want, strict=True))
        for lo, both in R.common(a, b):
            for p, row in enumerate(both, lo):
                assert row.tolist() == [sum((Counter(a.strings[p]) & Counter(s)).values()) for s in b.strings]


def test_ratios_of_whole_words_of_bits():
    x, y = ["a" * 64, "b" + "a" * 63, "a" * 63 + "b", "a" * 65], ["a" * 64, "a", "ba", "ab", ""]
    alphabet = R.Alphabet(x + y)
    a, b = R.Strings(x, alphabet), R.Strings(y, alphabet)
    i, j = (k.ravel() for k in np.indices((len(x), len(y))))
    assert R.ratios(a, b, i, j).tolist() == [SequenceMatcher(None, x[p], y[q]).ratio() for p, q in zip(i, j, strict=True)]
    assert R.ratios(b, a, j, i).tolist() == [SequenceMatcher(None, y[q], x[p]).ratio() for p, q in zip(i, j, strict=True)]
