"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. Targets: every source has a weight; together they want ``share`` times all
   words, but no source more than ``repeats`` times its own; what a full source
   can't take is reshared by weight.
2. The mix is counted in blocks of ``BLOCK`` words. Sources get integer numbers of
   blocks by the highest quotients target/(2k-1).
3. A source is one stream of words: its shards in turn, the rows of a shard in
   seeded order. The stream is cut in ``n`` blocks, of which only the last is
   shorter. Quota ``q = full * n + r`` takes every block ``full`` times and
   ``r`` blocks once more, chosen by seeded systematic sampling. The number of
   chosen blocks below any word is a closed formula, so a row's taken words need
   no join with blocks.

Only DataFrame functions: one window over (source, shard), whose size is bounded
by the number of shards that grows with the rows, and small tables of sources
and of (source, shard) pieces. The caller's columns travel in one struct, so that
no name of theirs can meet a name of ours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

BASE_WEIGHTS = (5, 2, 1)
BLOCK = 32  # words
MOST_BLOCKS = 10**9  # of a source, so that products of two counts stay longs; beyond, its blocks are several of BLOCK words


def words(text: Column) -> Column:
    """Number of words of the text; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(stock: DataFrame, share: float, repeats: int) -> DataFrame:
    """``source, weight, source_size`` to the same plus ``target``.

    A source is full once the common rate (words a unit of weight) reaches
    repeats * source_size / weight. In the order of that ratio, sources before
    the first that stays below it are full; the rest share what is left by
    weight. The rate rises while sources fill and falls after, so the greatest
    rate that its source can take is where repeated resharing ends.
    """
    order = Window.orderBy("_ratio", "source")
    cap = (F.lit(repeats) * F.col("source_size")).cast("double")
    every = Window.partitionBy()
    s = stock.withColumn("_cap", cap).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    s = s.withColumns(
        {
            "_want": F.lit(share) * F.sum("source_size").over(every),
            "_full": F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "_left": F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    )
    rate = (F.col("_want") - F.col("_full")) / F.col("_left")
    s = s.withColumn("_rate", F.max(F.when(F.col("_ratio") >= rate, rate)).over(every))
    target = F.when(F.col("_rate").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("weight") * F.col("_rate")))
    return s.select(*stock.columns, target.alias("target"))


def sainte_lague(frame: DataFrame, group: list[str], item: list[str], size: str, seats: str, name: str) -> DataFrame:
    """Adds ``name``: the seats of each item, ``seats`` (equal within a group) given by highest quotients size/(2k-1).

    Seats far below an item's even share are certain, so only about the number of
    items stands for election, whatever the number of seats. Ties go to the
    smaller item. Items of size 0 get none.
    """
    win = Window.partitionBy(*group)
    f = frame.withColumns({"_sum": F.sum(size).over(win).cast("double"), "_items": F.count(F.lit(1)).over(win)})
    part = F.when(F.col("_sum") > 0, F.col(size) / F.col("_sum")).otherwise(F.lit(0.0))
    f = f.withColumn("_even", F.floor(part * F.col(seats))).withColumn(
        "_span", F.ceil(part * (F.col("_items") / 2 + 1)) + 2
    )
    f = f.withColumn("_sure", F.when(F.col(size) > 0, F.greatest(F.lit(0), F.col("_even") - F.col("_span"))).otherwise(F.lit(0)))
    f = f.withColumn("_rest", F.col(seats) - F.sum("_sure").over(win))
    k = F.explode(F.sequence(F.col("_sure") + 1, F.col("_even") + F.col("_span") + 1)).alias("_k")
    run = f.where(F.col(size) > 0).select(*group, *item, size, "_rest", k)
    first = Window.partitionBy(*group).orderBy((F.col(size) / (2 * F.col("_k") - 1)).desc(), *item, "_k")
    won = run.withColumn("_rank", F.row_number().over(first)).where("_rank <= _rest")
    won = won.groupBy(*group, *item).agg(F.count(F.lit(1)).alias("_won"))
    keys = [*group, *item]
    won = won.toDF(*[f"_k{i}" for i in range(len(keys))], "_won")
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
    out = f.join(won, same, "left")
    return out.select(*frame.columns, (F.col("_sure") + F.coalesce(F.col("_won"), F.lit(0))).cast("long").alias(name))


def mix(
    df: DataFrame, source: Column, size: Column, order: list[Column], weights: tuple[int, ...] = BASE_WEIGHTS,
    share: float = 1.5, repeats: int = 2, seed: int = 17, rows_per_shard: int = 1000, max_shards: int = 4096,
) -> DataFrame:
    """All columns of ``df`` plus ``size, source_size, target, taken``.

    ``taken`` is how many words of the row the mix takes, repeats counted: at
    most ``repeats`` times ``size``. The rule depends on the values of ``source``,
    ``size`` and ``order`` alone, so reruns agree however rows are partitioned;
    rows equal in all three may swap their ``taken``. Null is a source of its own,
    ranked last; rows of size 0 take 0; an empty table gives no rows. The number
    of different sources must fit one task (a table of sources, not of rows).
    Columns of ``df`` named like the four added ones are replaced; all others stay,
    also ``source`` and those that begin with ``_``.

    ``rows_per_shard`` is the size of a window's group that is aimed at; beyond
    ``max_shards`` shards of a source the groups grow instead (4096 shards hold
    hundreds of millions of rows of a source in groups of 100,000). Neither
    changes how many words a source gives.
    """
    df = df.drop("size", "source_size", "target", "taken")
    kept = [F.col(f"`{c}`") for c in df.columns]
    own = materialize(
        df.select(
            F.struct(*kept).alias("row"), size.cast("long").alias("size"), source.alias("source"),
            F.array(*[c.cast("string") for c in order]).alias("order"), F.xxhash64(F.lit(seed), *order).alias("hash"),
        ),
        compact=True,
    )
    spec = materialize(_spec(own, weights, share, repeats))
    rows = spec.agg(F.sum("rows")).first()[0] or 0
    shards = max(1, min(max_shards, -(-rows // rows_per_shard)))
    own = own.withColumn("shard", F.pmod(F.xxhash64("hash"), F.lit(shards)).cast("int"))

    piece = own.groupBy("source", "shard").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    piece = piece.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0))).withColumnRenamed("source", "s")
    wide = F.greatest(F.lit(1), F.ceil(F.col("source_size") / (BLOCK * MOST_BLOCKS)))
    spec = spec.withColumn("wide", wide).withColumn("b", F.col("wide") * BLOCK)
    spec = spec.withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.col("b"))))
    spec = spec.withColumn("seats", F.least(F.round(F.col("quota") / F.col("wide")).cast("long"), F.col("n") * repeats))
    piece = piece.join(spec, F.col("s").eqNullSafe(F.col("source")))
    first = F.pmod(F.xxhash64(F.lit(seed), "source"), F.col("n"))
    piece = piece.select("s", F.col("shard").alias("p"), "source_size", "target", "start", "n", F.expr("seats div n").alias("full"),
                         F.expr("seats % n").alias("r"), first.alias("u"), "b")
    in_order = Window.partitionBy("source", "shard").orderBy("hash", "order", "size").rowsBetween(Window.unboundedPreceding, 0)
    out = own.withColumn("end", F.sum("size").over(in_order))
    out = out.join(piece, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("p")))
    extra = _chosen_below("(start + end)") - _chosen_below("(start + end - size)")
    taken = (F.col("size") * F.col("full") + extra).cast("long")
    return out.select(*[F.col("row")[c].alias(c) for c in df.columns], "size", "source_size", "target", taken.alias("taken"))


def _spec(own: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """``source, source_size, rows, target, quota`` of each source; windows over all sources see a table of sources."""
    by = materialize(own.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights)).cast("int") + 1)
    spec = targets(by.withColumn("weight", weight), share, repeats)
    blocks = F.round(F.sum("target").over(Window.partitionBy()) / BLOCK).cast("long")
    spec = spec.withColumns({"all": blocks, "one": F.lit(1)})
    return sainte_lague(spec, ["one"], ["source"], "target", "all", "quota").select("source", "source_size", "rows", "target", "quota")


def _chosen_below(at: str) -> Column:
    """Words of chosen blocks among the first ``at`` words of a source.

    Block j covers words [j * b, (j + 1) * b), the last one what is left; it is chosen
    if (j + u) * r div n rises at j, which happens r times over n blocks from any u.
    """
    j = f"({at} div b)"
    before = f"(({j} + u) * r div n - u * r div n)"
    chosen = f"(({j} + u + 1) * r div n > ({j} + u) * r div n)"
    return F.expr(f"{before} * b + if({chosen}, {at} - {j} * b, 0L)")


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """Digest for ``documents``: doc_id, size, source_size, target, taken. See :func:`mix`."""
    thin = docs.select("doc_id", "source", words(F.col("text")).alias("n_words"), F.crc32("text").alias("crc"))
    out = mix(thin, F.col("source"), F.col("n_words"), [F.col("doc_id"), F.col("crc")], **how)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def mixed_rows(docs: DataFrame, seed: int = 17, **how) -> DataFrame:
    """``docs`` (doc_id, text, source and more) as the mix takes them: rows dropped, kept or repeated whole.

    A row of which the mix takes a fraction is kept or dropped by a seeded draw with
    that chance, so sources hold the taken words on average and no text is cut.
    Null texts and texts without a word are not taken; a null source is a source of
    its own; an empty table gives no rows. The mix works on ids, sources, sizes and
    hashes; texts move once, to meet their number of copies. Rows equal in every
    column are one row as often as their copies together.
    """
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # names that can't meet the added ones
    doc, text = F.col(own["doc_id"]), F.col(own["text"])
    keyed = docs.toDF(*own.values()).withColumn("row", F.xxhash64(*own.values()))
    thin = keyed.select("row", doc.alias("doc"), F.col(own["source"]).alias("from"), words(text).alias("n_words"), F.crc32(text).alias("crc"))
    out = mix(thin, F.col("from"), F.col("n_words"), [F.col("doc"), F.col("crc")], seed=seed, **how)
    draw = F.pmod(F.xxhash64(F.lit(seed + 1), "doc", "crc"), F.lit(1 << 30)) / F.lit(1 << 30)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + draw)).otherwise(0).cast("int")
    copies = out.groupBy(F.col("row").alias("r"), F.col("doc").alias("d")).agg(F.sum(copies).cast("int").alias("copies"), F.count(F.lit(1)).alias("n"))
    copies = materialize(copies)
    if copies.where("n > 1").limit(1).count():
        keyed = keyed.dropDuplicates(["row", own["doc_id"]])
    found = keyed.join(copies.where("copies > 0").select("r", "d", "copies"), (F.col("row") == F.col("r")) & doc.eqNullSafe(F.col("d")))
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return found.select(*[F.col(n).alias(c) for c, n in own.items()])
