from pathlib import Path

from variorum import session as S


def test_what_is_written_goes_with_the_scratch_around_it(spark):
    with S.scratch(spark):
        outer = S.written(spark.range(5).toDF("a"))
        with S.scratch(spark):
            inner = S.written(outer.where("a > 2"))
            assert inner.count() == 2
            there = Path(inner.inputFiles()[0].removeprefix("file://")).parent
            assert there.exists()
        assert not there.exists() and outer.count() == 5
        there = Path(outer.inputFiles()[0].removeprefix("file://")).parent
    assert not there.exists()


def test_only_small_tables_are_broadcast(spark):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(S.small(spark.range(10), 10)) and not hinted(S.small(spark.range(11), 10))
