from datetime import datetime

from variorum.streaming import curation


def test_newest_edit_wins_over_batches(spark, tmp_path):
    src, state, log = (str(tmp_path / x) for x in ("in", "state", "log"))
    cols = ["feature", "curator_label"]

    def put(name, rows):
        data = [(a, r, f, c, datetime(2024, 1, 1, 0, 0, s)) for a, r, f, c, s in rows]
        spark.createDataFrame(data, curation.EDITS).coalesce(1).write.mode("append").parquet(src)

    seen = []

    def run():
        edits = spark.readStream.schema(curation.EDITS).parquet(src)
        q = curation.follow(edits, state, log, ["app_id", "rdg_text"], "edited_at", cols, lambda df, n: seen.append((n, df.count())), interval=None)
        q.awaitTermination()
        assert q.exception() is None

    put("1", [("a1", "x", "f", "trivial", 1), ("a1", "x", "f", "meaningful", 5), ("a2", "y", "f", "meaningful", 2)])
    run()
    put("2", [("a1", "x", "f", "trivial", 3), ("a3", "z", "g", "trivial", 9)])
    run()
    assert seen == [(0, 2), (1, 3)]
    schema = "app_id string, rdg_text string, edited_at timestamp_ntz, feature string, curator_label string"
    got = curation.latest(spark, state, 1, schema)
    assert {r.app_id: r.curator_label for r in got.collect()} == {"a1": "meaningful", "a2": "meaningful", "a3": "trivial"}
    features, readings = curation.overrides(got)
    assert {r.feature: r.label_override for r in features.collect()} == {"f": "meaningful", "g": "trivial"} and readings.count() == 0


def test_batches_write_what_they_touch_and_old_versions_go(spark, tmp_path):
    src, state, log = (str(tmp_path / x) for x in ("in", "state", "log"))
    cols = ["feature", "curator_label"]
    for second in range(4):
        rows = [(f"a{i}", "x", "f", f"l{second}", datetime(2024, 1, 1, 0, 0, second)) for i in range(20 if not second else 1)]
        spark.createDataFrame(rows, curation.EDITS).coalesce(1).write.mode("append").parquet(src)
        edits = spark.readStream.schema(curation.EDITS).parquet(src)
        curation.follow(edits, state, log, ["app_id", "rdg_text"], "edited_at", cols, interval=None, parts=8).awaitTermination()
    parts = {n: sorted(p.name for p in (tmp_path / f"state/data/version={n}").glob("part=*")) for n in range(4)}
    assert len(parts[0]) > 2 and parts[1] == [] and len(parts[2]) == len(parts[3]) == 1
    schema = "app_id string, rdg_text string, edited_at timestamp_ntz, feature string, curator_label string"
    got = {r.app_id: r.curator_label for r in curation.latest(spark, state, 3, schema).collect()}
    assert got == {f"a{i}": "l3" if not i else "l0" for i in range(20)}


def test_edits_without_a_pause_give_one_run_and_only_changes_go_out(spark, tmp_path):
    from pyspark.sql import functions as F

    from variorum.streaming import debounce

    src, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    edits, quiet = [], 4.0

    def put(*rows):
        data = [(a, r, f, c, datetime(2024, 1, 1, 0, 0, s)) for a, r, f, c, s in rows]
        edits.extend(data)
        spark.createDataFrame(data, curation.EDITS).coalesce(1).write.mode("append").parquet(src)

    def decided():
        return sorted(((r.feature, r.app_id, r.label_override, r.run) for r in debounce.read(spark, out).collect()), key=str)

    put(("w1", "x", "w", "trivial", 1), ("w2", "x", "w", " Trivial ", 1), ("n1", "x", None, "meaningful", 1), ("n2", "x", None, "trivial", 1), ("n3", "x", "odd", "other", 1))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    query = debounce.start(spark.readStream.schema(curation.EDITS).parquet(src), out, log, quiet)
    try:
        debounce.settle(query, quiet)
        first = decided()
        assert first == sorted([("w", None, "trivial", 1), (None, "n1", "meaningful", 1), (None, "n2", "trivial", 1)], key=str)
        # two lots less than the pause apart: one run, the newest edit of a reading counts
        put(("f1", "x", "f", "trivial", 7), ("f2", "y", "f", "meaningful", 2))
        debounce.wait(query, 1)
        put(("f1", "x", "f", "meaningful", 9), ("f1", "x", "f", "trivial", 3))
        debounce.settle(query, quiet)
        second = [x for x in decided() if x not in first]
        assert second == [("f", None, "meaningful", 1)]
        # after a pause another: the feature is taken back, its readings decide; others stay as they were
        put(("f2", "y", "f", "trivial", 11))
        debounce.settle(query, quiet)
        third = [x for x in decided() if x not in (*first, *second)]
        assert third == sorted([("f", None, None, 2), ("f", "f1", "meaningful", 2), ("f", "f2", "trivial", 2)], key=str)
        assert query.exception() is None
    finally:
        query.stop()
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    newest = spark.createDataFrame(edits, curation.EDITS).groupBy("app_id", "rdg_text").agg(F.max_by(F.struct("feature", "curator_label"), "edited_at").alias("r")).select("app_id", "rdg_text", "r.*")
    rows = lambda dfs: [sorted(map(tuple, df.collect()), key=str) for df in dfs]
    assert rows(debounce.applied(debounce.read(spark, out))) == rows(curation.overrides(newest))
