"""Sharding by histogram sort.

Rows get a 192-bit key (hash of the group value, id, row tie-breaker) written as
48 hex digits, so that text order is key order. A few rounds count the exact
bytes below candidate boundaries over all partitions (one partial aggregate of
at most ``PROBES`` groups each), put new probes between the least and greatest
key of the bins that still hold a wanted boundary, and stop when every splitter
meets its tolerance. Only then do the rows move, once, to their pieces.

Everything is built-in expressions; the driver sees bin totals only.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

PROBES = 512
DIGITS = 48
TOP = 1 << 4 * DIGITS


def _hex(x: int) -> str:
    return f"{x:0{DIGITS}x}"


def _ordered(c: Column) -> Column:
    """A long as 16 hex digits in the order of the numbers; null as the least."""
    least = F.lit(-(2**63)).cast("long")
    return F.lpad(F.lower(F.hex(F.coalesce(c.cast("long"), least).bitwiseXOR(least))), 16, "0")


def below(df: DataFrame, key: str, bounds: list[str], name: str) -> DataFrame:
    """Adds ``name``: how many of the sorted bounds are at or below the key (binary search in the plan)."""
    steps = 1
    while steps <= len(bounds):
        steps *= 2
    at = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<string>")
    df = df.withColumn(name, F.lit(0))
    while steps > 1:
        steps //= 2
        nxt = F.col(name) + steps
        df = df.withColumn(
            name, F.when((nxt <= len(bounds)) & (F.get(at, nxt - 1) <= F.col(key)), nxt).otherwise(F.col(name))
        )
    return df


def splitters(keyed: DataFrame, parts: int, tolerance: float, align: int = 0) -> tuple[list[str], int, int]:
    """Boundaries that cut the bytes of ``keyed`` (_key, _size) in ``parts`` near-equal parts.

    Each boundary's exact byte count is within ``tolerance`` of a part's mean
    size of its target, or no finer cut exists. With ``align``, a boundary moves to an
    edge between keys that differ in their first ``align`` digits where one lies within
    the tolerance. Returns (boundaries, bytes, rows);
    fewer boundaries than ``parts - 1`` when there are fewer rows than parts.
    """
    probes = [TOP * i // PROBES for i in range(1, PROBES)]
    done: dict[int, int] = {}
    known: dict[int, int] = {}
    total = rows = 0
    while True:
        bounds = sorted(set(probes) | set(known))
        found = (
            below(keyed.select("_key", "_size"), "_key", [_hex(b) for b in bounds], "_bin")
            .groupBy("_bin")
            .agg(F.sum("_size"), F.min("_key"), F.max("_key"), F.count(F.lit(1)))
            .collect()
        )
        bins = {b: (s, int(lo, 16), int(hi, 16)) for b, s, lo, hi, _ in found}
        rows = sum(x[4] for x in found)
        total = sum(s for s, _, _ in bins.values())
        if not rows:
            return [], 0, 0
        under = [0]  # bytes below the lower end of each bin
        for i in range(len(bounds) + 1):
            under.append(under[-1] + bins.get(i, (0,))[0])
        slack = tolerance * total / parts
        open_bins: set[int] = set()
        for t in range(1, parts):
            if t in done:
                continue
            want = total * t / parts
            i = bisect_left(under, want)  # under[i-1] < want <= under[i]; bin i-1 spans it
            ends = [(abs(under[j] - want), j) for j in (i - 1, i) if 1 <= j <= len(bounds)]
            gap, j = min(ends, default=(float("inf"), 0))
            size, lo, hi = bins.get(i - 1, (0, 0, 0))
            if j and gap <= slack:
                done[t] = bounds[j - 1]
            elif lo == hi:  # one row: it goes to the nearer side
                done[t] = lo if want - under[i - 1] < under[i] - want else lo + 1
            else:
                open_bins.add(i - 1)
        if not open_bins:
            return sorted({_hex(b) for b in (_aligned(keyed, done, total / parts, slack, align) if align else done.values())}), total, rows
        each = max(2, (PROBES - 1) // len(open_bins))
        known = {b: 1 for b in done.values()}
        probes = []
        for i in open_bins:
            _, lo, hi = bins[i]
            # both ends of what the bin holds stay, so that the next counts cover it exactly
            probes += [lo, hi, hi + 1, *(lo + (hi - lo) * k // (each + 1) for k in range(1, each + 1))]


def _aligned(keyed: DataFrame, done: dict[int, int], mean: float, slack: float, digits: int) -> list[int]:
    """Boundaries by their number, each at the nearer edge of the group that it cuts if exact bytes allow; counted once over all."""
    unit = 1 << 4 * (DIGITS - digits)
    edges = {t: (b // unit * unit, -(-b // unit) * unit) for t, b in done.items()}
    bounds = sorted({e for pair in edges.values() for e in pair if 0 < e < TOP})
    bins = dict(below(keyed.select("_key", "_size"), "_key", [_hex(e) for e in bounds], "_bin").groupBy("_bin").agg(F.sum("_size")).collect())
    under, at = {}, 0
    for k, e in enumerate(bounds):
        at += bins.get(k, 0)
        under[e] = at
    best = {t: min((abs(under[e] - t * mean), e) for e in pair if e in under) for t, pair in edges.items() if any(e in under for e in pair)}
    return [best[t][1] if t in best and best[t][0] <= slack else b for t, b in done.items()]


def histogram_shards(
    df: DataFrame, shards: int, size: Column, group: Column, row_id: Column, tolerance: float = 0.002, rows_per_piece: int = 8_000_000
) -> DataFrame:
    """All columns of ``df`` plus ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 in each shard).

    Shards hold near-equal sums of ``size`` and follow one global order by
    (hash of ``group``, ``row_id``, row), so rows of equal group value stand
    next to each other; a group is cut only where keeping it whole would miss the
    tolerance, as one larger than a shard must be.

    ``df`` is written once to the shared folder, as later rounds must see the
    same rows; give it thin rows where the payload is large. Nulls in ``group``
    or ``row_id`` sort as a value of their own; repeated rows are split by a
    stored row number; an empty table gives no rows; fewer rows than shards
    leave shards empty. Columns named ``shard``, ``slot`` or ``_*`` of ``df``
    are replaced.
    """
    key = F.concat(_ordered(F.xxhash64(group)), _ordered(row_id), _ordered(F.monotonically_increasing_id()))
    kept = materialize(df.drop("shard", "slot").withColumns({"_size": size.cast("long"), "_key": key}), compact=True)
    cuts, _, rows = splitters(kept, shards, tolerance, 16)
    # pieces within the shards only bound the rows that one sort task sees; their sizes may vary
    many = max(16, -(-rows // (shards * rows_per_piece)))
    fine, _, _ = splitters(kept, shards * many, 0.4)
    bounds = sorted({*cuts, *fine})
    placed = below(below(kept, "_key", bounds, "_piece"), "_key", cuts, "shard")
    counts = {(s, p): n for s, p, n in placed.groupBy("shard", "_piece").count().collect()}
    first: list[int] = [0] * (len(bounds) + 1)
    at: dict[int, int] = {}
    for s, p in sorted(counts):
        first[p] = at.get(s, 0)
        at[s] = first[p] + counts[s, p]
    order = F.row_number().over(Window.partitionBy("_piece").orderBy("_key"))
    starts = F.array(*[F.lit(x).cast("long") for x in first])
    return placed.withColumn("slot", F.get(starts, F.col("_piece")) + order - 1).drop("_key", "_size", "_piece")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Digest of the sharding of ``documents``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the UTF-8 bytes of the text plus 8 (null text: 8, crc32 null).
    """
    thin = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32("text").cast("long").alias("text_crc32"),
        F.xxhash64("text").alias("_group"),
    )
    out = histogram_shards(thin, shards, F.col("size"), F.col("_group"), F.col("doc_id"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
