import random

import pytest

from variorum.kernels import patterns
from variorum.kernels.annotate import rule_applies, rule_matches
from variorum.operators import rules as R

SCHEMA = "ord int, kind string, pattern string, label string, direction string, groups array<string>, exclude_groups array<string>"


@pytest.mark.parametrize("pattern, part", [
    ("abc", "abc"), ("^ab+cde$", "cde"), ("a|b", ""), ("(abc)d", "abcd"), ("(?:ab)?cd", "cd"), ("x[ab]yz", "yz"), ("(?i)abc", ""), ("a(?i:bc)de", "de"), ("(", None), ("", ""), (None, ""), ("a.b", "a"),
    (r"ab\b→", "ab→"), ("(?=abc)x", "x"), ("(a|b)cd", "cd"), ("a{3}b", "b"),
])
def test_what_a_pattern_demands(pattern, part):
    assert patterns.demanded(pattern) == part


def test_rules_as_a_table_equal_the_loop(spark):
    rng = random.Random(6)
    letters = "aeiouθ"
    rules = []
    for k in range(300):
        a, b, c = (rng.choice(letters) for _ in range(3))
        kind, pattern = rng.choice([("match", f"{a}→{b}"), ("match", f"{a} inserted"), ("match_regex", f"{a}.*{b}"), ("match_regex", f"[{a}{b}]→{c}$"), ("match_regex", f"^[{a}{b}]"), ("match_regex", f"({a}|{b})+→"), ("match_regex", "(")])
        groups, barred = (rng.sample("XYZ", rng.choice([0, 0, 0, 1, 2])) for _ in range(2))
        rules.append((k, kind, pattern, rng.choice(["trivial", "meaningful"]), rng.choice(["forward", "reverse", "either", None]), groups or None, barred or None))
    rng.shuffle(rules)
    ops = [f"{rng.choice(letters)}{x}{y}" for _ in range(80) for x, y in [("→", rng.choice(letters)), (" inserted", ""), ("e→u", "i"), ("qq", "")]] + [None, "", "→"]
    rows = [(i, op, None if i % 4 == 0 else rng.sample("XYZ", i % 3)) for i, op in enumerate(ops)]
    few = rules[:60]  # so that some operation has none
    got = {r.id: (r.ord, r.label) for r in R.first_rule(spark.createDataFrame(rows, "id int, op string, groups array<string>"), spark.createDataFrame(few, SCHEMA)).collect()}
    plain = [{"ord": o, "kind": k, "pattern": p, "label": v, "direction": d or "either", "groups": g or [], "exclude_groups": x or []} for o, k, p, v, d, g, x in sorted(few)]
    for i, op, groups in rows:
        want = next(((r["ord"], r["label"]) for r in plain if op is not None and rule_applies(r, set(groups or [])) and rule_matches(r, op)), (None, None))
        assert got[i] == want, (op, groups)
    assert len(got) == len(rows) and (None, None) in got.values()


def test_the_plan_does_not_grow_with_the_rules(spark):
    ops = spark.createDataFrame([("a→b", ["X"])], "op string, groups array<string>")
    sizes = []
    for n in (1, 500):
        rules = spark.createDataFrame([(k, "match_regex", f"z{k}", "trivial", "either", [], []) for k in range(n)], SCHEMA)
        out = R.first_rule(ops, rules)
        assert out.columns == ["op", "groups", "ord", "label"] and out.first().label is None
        sizes.append(len(out._jdf.queryExecution().optimizedPlan().toString().splitlines()))
    assert sizes[0] == sizes[1]
    assert not R.first_rule(ops.limit(0), rules).collect() and R.first_rule(ops, rules.limit(0)).count() == 1
