"""Queries that SQL can't express, against plain loops over the collected inputs."""

from collections import Counter

import pytest

from variorum import queries as Q
from variorum.kernels import align, greedy, post
from variorum.kernels.gestalt import ratio
from variorum.kernels.text import stanza_token
from variorum.operators import apparatus
from variorum.plans import collate

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stanzas(spark):
    return {r.xml_id: (list(r.canon), list(r.our)) for r in Q._stanzas(spark, SF).collect()}


@pytest.fixture(scope="module")
def segments(spark):
    lemma, wits = Q.collation(spark, SF)
    lem = {r.ab_id: r.text.split() for r in lemma.collect()}
    return lem, {(r.ab_id, r.witness): r.text.split() for r in wits.collect() if r.ab_id in lem}


def plain_entries(lem, wit):
    """(ab_id, a, b): fused or split spans, then differing or spaced single tokens outside them, else all tokens."""
    many, ones, seen = set(), set(), set()
    for (ab, _), words in wit.items():
        lemma = lem[ab]
        seen.add(ab)
        if lemma == words:
            continue
        ops = align.align(lemma, words)
        cover = align.coverage(ops, len(lemma))
        for a, b, surface in align.surfaces(ops, lemma, words):
            inside = cover[a:b]
            if b - a > 1 and ((len({tuple(x) for x in inside}) == 1 and len(inside[0]) == 1) or any(len(x) > 1 for x in inside)):
                many.add((ab, a, b))
            if b - a == 1 and " " in surface.strip():
                ones.add((ab, a, b))
        ones |= {(ab, i, i + 1) for i in align.differing(lemma, words)}
    out = many | {(ab, a, b) for ab, a, b in ones if not any(m == ab and x <= a and b <= y for m, x, y in many)}
    return out | {(ab, i, i + 1) for ab in seen - {x[0] for x in out} for i in range(len(lem[ab]))}


def plain_readings(lem, wit):
    out = Counter()
    for ab, a, b in plain_entries(lem, wit):
        for (other, w), words in wit.items():
            if other == ab:
                cover = [[i] for i in range(len(words))] if lem[ab] == words else align.coverage(align.align(lem[ab], words), len(lem[ab]))
                at = sorted({i for x in cover[a:b] for i in x})
                out[f"app-{ab}-{a}-{b}", w, " ".join(lem[ab][a:b]), " ".join(words[i] for i in at)] += 1
    return out


def test_entry_spans(spark, segments):
    assert {(r.ab_id, r.a, r.b) for r in Q.QUERIES["align_dp_spans"](spark, SF).collect()} == plain_entries(*segments)


def test_readings_and_their_groups(spark, segments):
    want = plain_readings(*segments)
    assert Counter((r.app_id, r.witness, r.lem, r.rdg) for r in Q._readings(spark, SF).collect()) == want
    groups = {}
    for app, w, _, rdg in want:
        groups.setdefault((app, rdg), []).append(w)
    assert {(r.app_id, r.rdg): r.wits for r in Q.QUERIES["readings_grouped"](spark, SF).collect()} == {k: " ".join(sorted(v)) for k, v in groups.items()}


def plain_type(lem, rdg, before, after):
    """The ladder, rung by rung."""
    import re

    form = lambda t: re.sub("[※⁛]", "", t.strip(" \t\n\r\f\v").lower())
    core = lambda t: re.sub(r"\.$", "", (t or "").strip().lower())
    a, b = form(lem), form(rdg)
    solid = lambda t: len(t.replace(".", "").replace(" ", ""))
    if not rdg.strip():
        return "missing"
    r = core(rdg)
    joined = (core(after) and core(lem) + core(after) == r) or (core(before) and core(before) + core(lem) == r)
    if a == b or ("." not in r and joined) or any(re.sub(p, "#", a) == re.sub(p, "#", b) for p in Q.PATTERNS):
        return "trivial"
    if (solid(a) and solid(b) / solid(a) < 0.6) or solid(b) > 1.5 * solid(a):
        return "meaningful"
    import unicodedata

    from variorum.functions.text import VOWELS

    bare = lambda t: "".join(c for c in unicodedata.normalize("NFD", t.translate({46: None, 32: None})) if unicodedata.category(c) != "Mn" and c not in VOWELS)
    x, y = bare(a), bare(b)
    if x != y and ratio(x, y) < 0.8:
        return "meaningful"
    return None  # left to the rules


def test_types_of_all_readings(spark, segments):
    """Every reading by itself, its neighbours those of the document, over the ends of lines too."""
    want = plain_readings(*segments)
    rows = Q.QUERIES["apparatus_types"](spark, SF).collect()
    assert Counter((r.app_id, r.witness, r.lem, r.rdg) for r in rows) == want
    apps = sorted({(int(ab.split("_")[0]), int(ab.split("_")[1]), a, b, ab) for ab, a, b in plain_entries(*segments)})
    lemma = lambda x: " ".join(segments[0][x[4]][x[2] : x[3]])
    near = {}
    for k, x in enumerate(apps):
        side = [lemma(apps[j]) if 0 <= j < len(apps) and apps[j][0] == x[0] else None for j in (k - 1, k + 1)]
        near[f"app-{x[4]}-{x[2]}-{x[3]}"] = tuple(side)
    ruled = 0
    for r in rows:
        assert near[r.app_id] == (r.before, r.after)
        plain = plain_type(r.lem, r.rdg, r.before, r.after)
        ruled += plain is None
        assert r.type == plain if plain else r.type in ("trivial", "meaningful"), r
    assert ruled < len(rows)


def test_greedy_relations(spark, stanzas):
    want = {(x, k): (m["canon_indexes"], m["our_indexes"], m["relation"], m["matched"]) for x, (c, o) in stanzas.items() for k, m in enumerate(greedy.match(c, o))}
    assert {(r.xml_id, r.k): (r.canon_indexes, r.our_indexes, r.relation, r.matched) for r in Q.QUERIES["align_greedy"](spark, SF).collect()} == want


def plain_gate(canon, our):
    key = lambda t: stanza_token(t).replace(".", "")
    ms = [m for m in greedy.match(canon, our) if "merged" not in m["relation"]]
    subs = [m for m in ms if m["relation"] == "substitution"]
    low = sum(ratio(key(m["canon_word"]), key(m["our_word"])) < 0.75 for m in subs)
    gone = sum(m["relation"] == "insert" for m in ms)
    short = sum(m["our_word"] != "" and len(key(m["our_word"])) <= 3 for m in ms)
    rate = (len(subs) + gone) / max(1, len(canon))
    return len(subs), low, gone, short, rate, low >= 6 or rate >= 0.20 or short >= 6


def test_gate(spark, stanzas):
    got = {r.xml_id: (r.subs_total, r.subs_low, r.unmatched, r.short_tokens, r.error_rate, r.flagged) for r in Q.QUERIES["dp_gate"](spark, SF).collect()}
    assert got == {k: plain_gate(c, o) for k, (c, o) in stanzas.items()}


def test_chosen_alignment(spark, stanzas):
    def relation(cs, canon, word):
        return "unmatched" if not cs else "many-to-one" if len(cs) > 1 else "equal" if stanza_token(canon[cs[0]]) == stanza_token(word) else "substitution"

    want = {}
    for k, (canon, our) in stanzas.items():
        by: list[set] = [set() for _ in our]
        for m in greedy.match(canon, our):
            if m["canon_indexes"] and len(m["our_indexes"]) == 1:
                by[m["our_indexes"][0]] |= set(m["canon_indexes"])
        dp = align.pair_groups(align.needleman(canon, our)[0], canon, our) if plain_gate(canon, our)[-1] else None
        for i, word in enumerate(our):
            g = relation(sorted(by[i]), canon, word)
            d = relation(dp[i], canon, word) if dp else None
            want[k, i] = (g, d, "both" if d == g else "dp" if d else "greedy", d or g)
    rows = collate.chosen_alignment(Q._stanzas(spark, SF)).collect()
    assert {(r.xml_id, r.our_index): (r.greedy_relation, r.dp_relation, r.final_choice, r.final_relation) for r in rows} == want
    rows = Q.QUERIES["chosen_alignment"](spark, SF).collect()
    assert {(r.xml_id, r.our_index): (r.greedy_relation, r.dp_relation, r.final_choice, r.final_relation) for r in rows} == want and len(rows) == len(want)


def test_global_groups_are_exported(spark, stanzas):
    want = Counter()
    for k, (canon, our) in stanzas.items():
        groups, done = align.needleman(canon, our)[0], set()
        for cs, os in groups:
            done |= set(os)
            if len(cs) == len(os) and cs:
                want.update((k, str(o), str(c)) for c, o in zip(cs, os, strict=True))
            elif cs or os:
                want[k, ";".join(map(str, os)), ";".join(map(str, cs))] += 1
        want.update((k, str(i), "") for i in range(len(our)) if i not in done)
    assert Counter((r.xml_id, r.our_index, r.canon_indexes) for r in Q.QUERIES["align_nw_groups"](spark, SF).collect()) == want


def test_trimmed_readings(spark):
    rows = [r.asDict() for r in Q.token_pairs(spark, SF).collect()]
    lemmas = {}
    for r in rows:
        lemmas.setdefault((r["ab_id"], r["witness"]), {})[r["pos"]] = r["lem"]
    want = Counter()
    for r in rows:
        rdg = " ".join(x for x in (r["before"], r["rdg"], r["after"]) if x is not None)
        line = lemmas[r["ab_id"], r["witness"]]
        near = lambda k: line.get(r["pos"] + k, "").split()
        if len(rdg.split()) > len(r["lem"].split()):
            rdg = post.drop_neighbours(rdg, r["lem"].split(), [near(-1), near(-2)], [near(1), near(2)])
        want[r["ab_id"], r["pos"], r["witness"], r["lem"], post.trim_fused(r["lem"], rdg)] += 1
    assert Counter(map(tuple, Q.QUERIES["trimmed_readings"](spark, SF).collect())) == want


def test_words_of_trimmed_readings_are_not_shuffled(spark):
    """Lines go to tasks whole: a window or join over their words wrote twenty times the input."""
    plan = Q.QUERIES["trimmed_readings"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("posexplode") == 3, plan  # lines of both sides, and the words at the end


def test_lines_that_differ_are_those_with_differing_words(spark):
    some = Q.token_pairs(spark, SF, False).where("lem <> rdg")
    assert Counter(map(tuple, some.collect())) == Counter(map(tuple, Q.token_pairs(spark, SF).where("lem <> rdg").collect()))


def test_aligned_rows_are_whole(spark, segments):
    lem, wit = segments
    rows = apparatus.aligned(*Q.collation(spark, SF)).collect()
    assert {(r.ab_id, r.witness) for r in rows} == set(wit) and len(rows) == len(wit)
    for r in rows:
        assert list(r.lt) == lem[r.ab_id] and list(r.wt) == wit[r.ab_id, r.witness] and len(r.cover) == len(r.lt)


def test_cascade(spark):
    from variorum.kernels.annotate import Annotator

    nations = {str(r.n_nationkey): r.r_name for r in Q.table(spark, SF, "nation").join(Q.table(spark, SF, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey").collect()}
    annotator = Annotator(Q.RULES, "", Q.FAMILIES, [], frozenset(["the"]), {}, frozenset(), True)
    want = Counter()
    for r in Q.token_pairs(spark, SF).where("lem <> rdg").collect():
        out = annotator.annotate(r.lem, r.rdg, [nations[r.witness]] if r.witness in nations else [])
        want[f"app-{r.ab_id}-{r.pos}", "#" + r.witness, r.lem, r.rdg, out["label"], out["rule"]] += 1
    assert Counter(map(tuple, Q.QUERIES["cascade"](spark, SF).collect())) == want


def test_stanzas_are_moved_once(spark):
    """Lists of words went with every word through joins, which made disk grow with the square of a stanza."""
    before = Q._stanzas(spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("Join")
    for name in ("dp_gate", "chosen_alignment", "align_nw_groups", "align_greedy"):
        plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == before and plan.count("ArrowEvalPython") <= 3 and "Union" not in plan, name
