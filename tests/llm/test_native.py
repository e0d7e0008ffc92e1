"""Sharding and mixing: the laws they promise, on documents and on odd tables."""

import zlib
from collections import Counter, defaultdict

import pytest

from variorum.llm import mixing, sharding

ODD = [(None, None, None, "x"), (None, "a b", None, "x"), (5, "", "s", "x"), (5, "", "s", "x"), (7, "w " * 30000, "t", "x")]
ODD += [(9, "same text here", "hot", "x")] * 400 + [(i, f"doc {i} é", "hot", "x") for i in range(100)]


def odd(spark, rows=ODD):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, shard string")


def check_shards(rows, docs, shards):
    size = lambda t: len((t or "").encode()) + 8
    want = Counter((r.doc_id, size(r.text), None if r.text is None else zlib.crc32(r.text.encode())) for r in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r.shard < shards and r.grown_shard is None and r.law == "bytes"
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sums = Counter()
    for r in rows:
        sums[r.shard] += r.size
    mean, most = sum(r.size for r in rows) / shards, max(r.size for r in rows)
    assert all(abs(sums[s] - mean) <= most + 0.01 * mean for s in range(shards))


def test_shards_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sharding.shard_documents(docs).collect()
    check_shards(rows, docs.collect(), 24)
    again = sharding.shard_documents(docs.repartition(5)).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)


def test_shards_of_odd_tables(spark):
    rows = sharding.shard_documents(odd(spark)).collect()
    assert len(rows) == len(ODD)
    check_shards(rows, odd(spark).collect(), 24)
    assert not sharding.shard_documents(odd(spark, [])).collect()
    assert [(r.slot, r.size) for r in sharding.shard_documents(odd(spark, ODD[:1])).collect()] == [(0, 8)]


def test_small_groups_are_not_cut(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, f"text {i // 3}") for i in range(6000)], "id long, t string")
    got = sharding.histogram_shards(df, 8, F.lit(1), F.col("t"), F.col("id"), tolerance=0.01).collect()
    groups = defaultdict(set)
    for r in got:
        groups[r.t].add(r.shard)
    sizes = Counter(r.shard for r in got)
    assert all(len(s) == 1 for s in groups.values()) and max(abs(n - 750) for n in sizes.values()) <= 15


def fill(stock, share, repeats):
    """Resharing as told: give by weight, stop at the cap, share the excess among the rest, again."""
    want, full, weights = share * sum(stock.values()), {}, {}
    for i, s in enumerate(sorted(stock, key=lambda x: (x is None, x))):
        weights[s] = (5, 2, 1)[i % 3]
    while True:
        rest = {s: w for s, w in weights.items() if s not in full}
        left = want - sum(full.values())
        target = {s: left * w / sum(rest.values()) for s, w in rest.items()} | full
        over = [s for s in rest if target[s] > repeats * stock[s]]
        if not over:
            return target
        full |= {s: repeats * stock[s] for s in over}


def seats_by_quotients(sizes, seats):
    got = dict.fromkeys(sizes, 0)
    for _ in range(seats):
        best = min((k for k in sizes if sizes[k] > 0), key=lambda k: (-sizes[k] / (2 * got[k] + 1), k))
        got[best] += 1
    return got


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 1001])
def test_seats(spark, seats):
    sizes = {f"s{i}": float(x) for i, x in enumerate([500, 300, 0, 1, 99, 99, 40, 3])}
    f = spark.createDataFrame([(1, k, v, seats) for k, v in sizes.items()], "g int, k string, v double, n int")
    got = {r.k: r.won for r in mixing.sainte_lague(f, ["g"], ["k"], "v", "n", "won").collect()}
    assert got == seats_by_quotients(sizes, seats)


@pytest.mark.parametrize("table", ["documents", "odd"])
def test_mix(spark, table):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet") if table == "documents" else odd(spark)
    docs = docs.select("doc_id", "text", "source")
    got = mixing.mix_documents(docs).collect()
    import re

    sized = Counter((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.collect())
    assert Counter((r.doc_id, r["size"]) for r in got) == sized
    stock = Counter()
    for r in docs.collect():
        stock[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    target = fill(stock, 1.5, 2)
    assert Counter(r.source_size for r in got) == Counter(stock[r.source] for r in docs.collect())
    taken, wanted = Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source_size] += r.taken
        wanted[r.source_size] = r.target
    for s, n in stock.items():
        assert abs(wanted[n] - target[s]) < 1e-6 * max(1, target[s])
        assert abs(taken[n] - target[s]) <= 64 + 0.01 * target[s]
    again = mixing.mix_documents(docs.repartition(3)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert not mixing.mix_documents(docs.limit(0)).collect()


def test_clashing_columns_stay_apart(spark):
    from pyspark.sql import functions as F

    rows = [(i, "x y z", "ab"[i % 2], 7, 8, 9, "t") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, hash int, _order int, target string")
    got = mixing.mix(df, F.col("source"), F.lit(3), [F.col("doc_id")])
    assert {(r.source, r.hash, r._order) for r in got.collect()} == {("a", 8, 9), ("b", 8, 9)} and got.columns.count("size") == 1
    whole = mixing.mixed_rows(df)
    assert whole.columns == df.columns and {(r.size, r.hash, r.target) for r in whole.collect()} == {(7, 8, "t")}


@pytest.mark.parametrize("size, shards", [(250_000, 20), (15, 800), (10**13, 20)])
def test_rare_sources_over_many_shards(spark, size, shards):
    """Sources of 150-word rows beside one of 20,000 rows: of billions of words, in shards smaller than a block, past the block limit."""
    from pyspark.sql import functions as F

    rows = {"a": (20_000, size), "b": (300, 150), "c": (900, 150), "d": (40, 15)}
    df = spark.createDataFrame([(s, i, n) for s, (k, n) in rows.items() for i in range(k)], "src string, id long, n long")
    got = mixing.mix(df, F.col("src"), F.col("n"), [F.col("id")], rows_per_shard=-(-21_240 // shards))
    sums = got.groupBy("src").agg(F.sum("taken"), F.first("target"), F.min("taken"), F.max(F.col("taken") / F.col("n"))).collect()
    assert len(sums) == len(rows)
    for src, taken, target, least, most in sums:
        assert abs(taken - target) <= 64 + 1e-6 * target and least >= 0 and most <= 2, (src, taken, target)
