"""Matching of whole books word by word: seeds, a chain of anchors, and exact programmes between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kernels import book as B
from ..session import spread, written

APART = 300  # words between two anchors at which a book is cut, at least
FILLERS = ("W", "Y")


def _numbered(words: str) -> Column:
    """Words that are no filler, with their places."""
    return F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: ~F.coalesce(x["w"].isin(*FILLERS), F.lit(False)))


def _seeds(books: DataFrame, words: str, place: str) -> DataFrame:
    """Runs of three words that a side holds once: ``book, key`` and their place."""
    at = lambda k: F.get(F.col(words), F.col(place) + k)
    w = lambda k: at(k)["w"]
    runs = books.select("book", words, F.explode(F.sequence(F.lit(0), F.greatest(F.size(words) - 3, F.lit(0)))).alias(place))
    runs = runs.select("book", place, F.xxhash64(w(0), w(1), w(2)).alias("key"), (at(2)["i"] - at(0)["i"] == 2).alias("whole")).where("whole")
    return runs.groupBy("book", "key").agg(F.min(place).alias(place), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


def match_books(books: DataFrame, apart: int = APART) -> DataFrame:
    """``book, c, o``: places of the words that match, from ``book, canon, our`` (word lists, of any length).

    The match begins where three words in a row match. From there on it holds as many words as can match in
    order when no more than 15 words, of both sides together, are passed between two matches; of
    equal ones it takes fewest moves of up to ten words. It ends where nothing goes on. Fillers W and Y are passed freely.

    Runs of three words that both sides hold exactly once, in a longest chain, cut a book in stretches
    of ``apart`` words or more; stretches are matched by themselves, each between two such
    anchors, and joined up to the first that can't be crossed. Books without such runs are one stretch.
    Null word lists are empty; repeated ``book`` ids are not allowed; an empty table gives no rows.
    """
    lists = {"canon": F.coalesce("canon", F.array().cast("array<string>")), "our": F.coalesce("our", F.array().cast("array<string>"))}
    books = written(books.select("book", *[c.alias(n) for n, c in lists.items()]).withColumns({"canon": _numbered("canon"), "our": _numbered("our")}))
    seeds = _seeds(books, "canon", "c").join(_seeds(books, "our", "o"), ["book", "key"])
    # a book's seeds are no more than its words
    seeds = seeds.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("c", "o"))).alias("seeds"))
    # whole lists: a hundred rows at a time, as an Arrow batch of ten thousand fills a worker
    pick = F.udf(lambda xs: [{"c": c, "o": o} for c, o in B.cuts([(x["c"], x["o"]) for x in xs], apart)], "array<struct<c:int,o:int>>", useArrow=False)
    cut = books.join(seeds.select("book", pick("seeds").alias("cuts")), "book", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<struct<c:int,o:int>>")))
    parts = cut.select("book", "canon", "our", "cuts", F.explode(F.sequence(F.lit(0), F.size("cuts"))).alias("part"))
    at = lambda side, k, other: F.coalesce(F.get("cuts", F.col("part") + k)[side], other)
    # the words of the next anchor belong to a stretch too
    for side, words in (("c", "canon"), ("o", "our")):
        parts = parts.withColumns({f"{side}0": at(side, -1, F.lit(0)), f"{side}1": at(side, 0, F.size(words) - 3) + 3})
    def taken(words: str, side: str, field: str) -> Column:
        part = F.slice(words, F.col(f"{side}0") + 1, F.greatest(F.col(f"{side}1") - F.col(f"{side}0"), F.lit(0)))
        return F.transform(part, lambda x: F.coalesce(x["w"], F.lit("")) if field == "w" else x["i"])

    sides = [taken(words, side, field).alias(f"{side}_{field}") for words, side in (("canon", "c"), ("our", "o")) for field in "wi"]
    parts = parts.select("book", "part", "c0", "o0", *sides, (F.col("part") == F.size("cuts")).alias("last"))
    find = F.udf(lambda *a: B.stretch(*a), "struct<pairs:array<struct<c:int,o:int>>,arrived:boolean>", useArrow=False)
    # dealt one by one: a stretch costs by its words, not by its bytes
    parts = written(spread(parts, "book", "part").withColumn("m", find("c_w", "o_w", "c_i", "o_i", F.col("part") == 0, "last")).select("book", "part", "c0", "o0", "m"))
    end = parts.where("not m.arrived").groupBy("book").agg(F.min("part").alias("end"))
    pairs = parts.join(end, "book").where("part <= end").select("book", "part", "c0", "o0", F.posexplode("m.pairs").alias("k", "p"))
    # the first match of a stretch is the last of the one before
    pairs = pairs.where("part = 0 or k > 0").select("book", (F.col("c0") + F.col("p.c")).alias("c"), (F.col("o0") + F.col("p.o")).alias("o"))
    names = books.select("book", F.posexplode("canon").alias("c", "x")).select("book", "c", F.col("x.i").alias("canon_place"))
    other = books.select("book", F.posexplode("our").alias("o", "x")).select("book", "o", F.col("x.i").alias("our_place"))
    return pairs.join(names, ["book", "c"]).join(other, ["book", "o"]).select("book", F.col("canon_place").alias("c"), F.col("our_place").alias("o"))
