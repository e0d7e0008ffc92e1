"""Work that must not grow faster than the input, and results that stay what they were before."""

import cProfile
import hashlib
import pstats
import random

from variorum import queries as Q
from variorum import queries_features as QF
from variorum.kernels import align, book, greedy
from variorum.sources import xml

SF = "/root/testdata/sf0.001"


def some_lines(seed, n, size):
    """Lines with respelt, dropped, fused, split and moved words."""
    r = random.Random(seed)
    parts = "th er on an ii ai ə̄ u ō st n s š aō the .".split()
    word = lambda: "".join(r.choice(parts) for _ in range(r.randint(1, 4)))
    known = [word() for _ in range(size)]
    for _ in range(n):
        canon = [r.choice(known) for _ in range(r.randint(0, size))]
        our = []
        for w in canon:
            k = r.random()
            our += [] if k < 0.1 else [w[1:] or "a"] if k < 0.25 else [w, word()] if k < 0.35 else [w[:2], w[2:]] if k < 0.45 else [word()] if k < 0.6 else [w]
            if k > 0.9 and len(our) > 1:
                our[-2:] = [our[-2] + our[-1]] if k > 0.95 else our[-1:] + our[-2:-1]
        yield canon, our


def test_greedy_records_are_as_before():
    """The hash was taken from the matcher that looked through all equal tokens of a line."""
    out = hashlib.md5()
    for canon, our in some_lines(7, 400, 30):
        out.update(repr(greedy.match(canon, our)).encode())
    assert out.hexdigest() == "7e38e513e85a907a3b276c3a2d42bcd5"


def test_greedy_matching_takes_few_steps_a_word():
    def steps(n):
        r = random.Random(3)
        syllables = "th er on an in st ou ea he ti".split()
        line = lambda: ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n)]
        lines = line(), line()
        p = cProfile.Profile()
        p.enable()
        greedy.match(*lines)
        p.disable()
        return pstats.Stats(p).total_calls / n

    few = steps(300)
    assert few < 250 and steps(1200) < 1.15 * few


def test_stanzas_are_aligned_once(spark):
    """A size asked of the matches before they were exploded called the aligner a second time, below the shuffle that spreads its work."""
    for name in ("align_greedy", "align_nw_groups"):
        plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1, plan


def test_lists_are_filled_in_before_their_words_are_taken_apart(spark):
    """Else a line's list was made again for each of its words, which grew with the square of a line."""
    plan = Q.token_pairs(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("posexplode(wt", 1)
    assert "inline" in below and "array_repeat" not in above, plan


def test_large_clusters_are_dealt_to_many_tasks(spark, tmp_path, monkeypatch):
    text = " ".join(f"w{i}" for i in range(12))
    rows = [(i, f"{text} x{i % 3}\n{'same' if i % 2 else 'other'} line\n ") for i in range(40)] + [(100, "alone"), (101, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(Q, "TOGETHER", 8)
    d = str(tmp_path)
    lemma, wits = Q.collation(spark, d)
    want = sorted(map(tuple, wits.join(lemma.withColumnRenamed("text", "l"), "ab_id").select("ab_id", "witness", "l", "text").collect()))
    got = Q.line_pairs(spark, d)
    assert sorted(map(tuple, got.collect())) == want and len(want) == 78
    assert sorted(map(tuple, Q.line_pairs(spark, d, False).collect())) == [x for x in want if x[2] != x[3]]
    assert "part" in got._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[1].split("\n")[0]


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_typed_where_they_are(spark):
    """A join with the distinct open pairs moved every word of every line."""
    assert optimized(Q.QUERIES["ladder_full"](spark, SF)).count("Join") == optimized(Q.token_pairs(spark, SF)).count("Join")


def test_readings_are_annotated_without_a_join(spark):
    """Distinct readings were joined back with all of them."""
    plan = optimized(Q.QUERIES["cascade"](spark, SF))
    assert "<=>" not in plan and plan.count("ArrowEvalPython") == 1, plan


def test_changes_are_read_once(spark):
    """Changes were found again for each use, and words freed of marks before equal pairs had met."""
    assert "ArrowEvalPython" not in optimized(Q.QUERIES["changes_to_overrides"](spark, SF))


def test_files_grow_in_number_with_turns_not_with_conversations(spark, tmp_path, monkeypatch):
    """A folder and a file were written for each conversation, and ids that are null or negative were not found again."""
    rows = [(i // 3, i % 3) for i in range(900)] + [(-7, 0), (-7, 1), (None, 0), (None, None)] + [(1000, i) for i in range(700)]
    spark.createDataFrame([(*r, "user", "x") for r in rows], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    monkeypatch.setattr(QF, "TURNS", 200)
    found, read = [], xml._files

    def files(*args):
        out = read(*args)
        found.extend(r.path for r in out.select("path").collect())
        return out

    monkeypatch.setattr(xml, "_files", files)
    got = [r.conv_id for r in QF.files_once(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == {r[0] for r in rows}
    assert len(rows) / 200 <= len(found) == len(set(found)) <= len(rows) / 200 + 8  # 8 tasks
    spark.read.parquet(str(tmp_path / "conversations.parquet")).limit(0).write.parquet(str(tmp_path / "none/conversations.parquet"))
    assert not QF.files_once(spark, str(tmp_path / "none")).collect()


def test_a_file_under_two_paths_is_read_once(spark, tmp_path):
    spark.range(20).selectExpr("cast(id as string) value").repartition(4).write.text(str(tmp_path / "f"))
    paths = [str(tmp_path / "f"), f"{tmp_path}/f/*"]
    assert spark.read.option("pathGlobFilter", "*.txt").text(paths).count() == 40  # the reader alone takes both
    lines = [x for r in xml._files(spark, paths, "*.txt").collect() for x in bytes(r.content).decode().split()]
    assert sorted(map(int, lines)) == list(range(20))


def calls(f, *args):
    p = cProfile.Profile()
    p.enable()
    f(*args)
    p.disable()
    return pstats.Stats(p).total_calls


def test_aligners_compare_words_in_step():
    """Every pair of words or runs was compared by itself: 69 calls a cell for spans, 16 for groups, and 57 for the pairs of a group."""
    r = random.Random(5)
    syllables = "th er on an in st ou ea he ti".split()
    canon, our = (["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(100)] for _ in range(2))
    whole = [(list(range(100)), list(range(100)))]
    for f in (align.align, align.needleman, lambda a, b: align.pair_groups(whole, a, b)):
        assert calls(f, canon, our) < 3 * len(canon) * len(our)


def test_moves_between_matches_are_judged_in_step():
    """136 places were looked up for every match, one by one."""
    r = random.Random(8)
    canon, our = ([f"k{r.randint(0, 9)}" for _ in range(400)] for _ in range(2))
    rows = book.matching(canon, our)
    assert calls(book.chain, rows, (0, rows[0][0]), True, None) < 3 * sum(map(len, rows))
