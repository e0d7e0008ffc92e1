"""Approximate nearest neighbours over learned partitions.

1. A bounded sample gives a neighbour graph (exact inner products within the sample).
2. The graph is cut in balanced partitions: repeated halving along the slow direction
   of its adjacency, then swaps that take edges out of the cut.
3. A small softmax network learns, from each sample vector, where its neighbours lie.
4. Every row goes to its likeliest partition; a query goes to as many likeliest
   partitions as reach the wanted recall on queries of the sample, and is compared
   there with all original vectors in double precision.

Rows move once, to their partition; queries are sent to the partitions that they
ask, and only each partition's best come back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectors as V
from .common import materialize
from .language import _schema

SAMPLE = 6000  # rows that the index is fitted on, as an expected number
NEIGHBOURS = 16
LEARNED = 16  # sample rows of a partition at least: more partitions need a larger sample
RECALL = 0.95  # on the sample; sample neighbours lie farther than those among all rows
HIDDEN = 96
CHUNK, QUERIES, BLOCK = 4096, 2048, 256  # rows and queries of a comparison at most, on average; queries at once


@dataclass
class Router:
    """Softmax network over direction and length of a vector; one for each vector length."""

    longest: float  # of the sample; a query is a vector without the length feature
    layers: list[np.ndarray]
    probes: int

    def scores(self, x: np.ndarray, query: bool) -> np.ndarray:
        return _forward(self.layers, lifted(x, self.longest, query))[1]


def lifted(x: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Unit vectors with one more dimension, whose cosine orders rows by inner product with a query."""
    size = np.linalg.norm(x, axis=1, keepdims=True)
    if query:
        return np.hstack([x / size, np.zeros_like(size)])
    x, size = x / longest, size / longest
    over = np.maximum(1, size)  # rows longer than any of the sample keep their direction
    return np.hstack([x / over, np.sqrt(np.maximum(0, 1 - (size / over) ** 2))])


def _forward(layers: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hidden layer and class probabilities; the last weights lead past the hidden layer."""
    w1, b1, w2, b2, direct = layers
    hidden = np.maximum(0, x @ w1 + b1)
    z = hidden @ w2 + b2 + x @ direct
    z = np.exp(z - z.max(1, keepdims=True))
    return hidden, z / z.sum(1, keepdims=True)


def graph(x: np.ndarray, k: int) -> np.ndarray:
    """Nearest ``k`` other rows of each row of unit vectors."""
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 512):
        near = x[a : a + 512] @ x.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -np.inf
        out[a : a + 512] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def halve(near: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Side (0 or 1) of each of ``rows``: halves of equal size with few graph edges between."""
    n = len(rows)
    inside = np.full(near.shape[0], -1)
    inside[rows] = np.arange(n)
    to = inside[near[rows]]
    a, b = np.repeat(np.arange(n), near.shape[1])[to.ravel() >= 0], to.ravel()[to.ravel() >= 0]
    a, b = np.concatenate((a, b)), np.concatenate((b, a))
    degree = np.maximum(1, np.bincount(a, minlength=n))

    def spread(v: np.ndarray) -> np.ndarray:
        return np.bincount(a, v[b], n) / degree

    v = rng.standard_normal(n)
    for _ in range(60):
        v = v - (v * degree).sum() / degree.sum()
        v = 0.5 * v + 0.5 * spread(v)
        v /= np.linalg.norm(v) + 1e-300
    side = np.zeros(n, np.int64)
    side[np.argsort(v, kind="stable")[n // 2 :]] = 1
    for _ in range(8):  # swap pairs whose move takes edges out of the cut
        across = spread(side.astype(float)) * degree
        gain = np.where(side == 0, across - (degree - across), degree - across - across)
        zero, one = (np.flatnonzero(side == s) for s in (0, 1))
        zero, one = zero[np.argsort(-gain[zero], kind="stable")], one[np.argsort(-gain[one], kind="stable")]
        m = min(len(zero), len(one))
        better = np.flatnonzero(gain[zero[:m]] + gain[one[:m]] > 2)
        if not len(better):
            break
        move = better[: max(1, len(better) // 2)]
        side[zero[move]], side[one[move]] = 1, 0
    return side


def partition(near: np.ndarray, parts: int) -> np.ndarray:
    """Balanced parts (a power of two) of a neighbour graph."""
    rng = np.random.default_rng(5)
    groups = [np.arange(len(near))]
    while len(groups) < parts:
        groups = [g[s == k] for g in groups for s in [halve(near, g, rng)] for k in (0, 1)]
    label = np.empty(len(near), np.int64)
    for k, g in enumerate(groups):
        label[g] = k
    return label


def learn(x: np.ndarray, near: np.ndarray, label: np.ndarray, parts: int) -> list[np.ndarray]:
    """Network from vectors to the parts of their neighbours and themselves."""
    rng = np.random.default_rng(6)
    d = x.shape[1]
    want = np.zeros((len(x), parts))
    for k in range(near.shape[1]):
        np.add.at(want, (np.arange(len(x)), label[near[:, k]]), 0.5 / near.shape[1])
    want[np.arange(len(x)), label] += 0.5
    layers = [
        rng.standard_normal((d, HIDDEN)) * np.sqrt(2 / d), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) * np.sqrt(1 / HIDDEN),
        np.zeros(parts), np.zeros((d, parts)),
    ]
    m, v, step = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    for epoch in range(24):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 256):
            rows = order[a : a + 256]
            hidden, p = _forward(layers, x[rows])
            g = (p - want[rows]) / len(rows)
            back = (g @ layers[2].T) * (hidden > 0)
            grads = [x[rows].T @ back, back.sum(0), hidden.T @ g, g.sum(0), x[rows].T @ g]
            step += 1
            rate = 0.01 * (1 - epoch / 24)
            for w, dw, mm, vv in zip(layers, grads, m, v, strict=True):
                mm += 0.1 * (dw - mm)
                vv += 0.01 * (dw**2 - vv)
                w -= rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-8)
    return layers


def partitions(rows: int, sample: int, k: int) -> int:
    """How many: about a quarter of the root of the rows, as long as a part holds twice ``k`` rows and ``LEARNED`` of the sample."""
    parts = 1
    while parts < rows**0.5 / 4 and 2 * parts * max(2 * k, 1) <= rows and 2 * parts * LEARNED <= sample:
        parts *= 2
    return parts


def fit(sample: np.ndarray, parts: int, k: int) -> Router:
    """Router from sample rows; ``k`` is the number of neighbours whose recall sets the probes. One part takes all."""
    sample = sample[np.lexsort(sample.T)]
    longest = float(np.linalg.norm(sample, axis=1).max())
    if parts == 1:
        d = sample.shape[1] + 1
        return Router(longest, [np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), np.zeros((d, 1))], 1)
    base = lifted(sample, longest, False)
    near = graph(base, min(NEIGHBOURS, len(base) - 1))
    label = partition(near, parts)
    router = Router(longest, learn(base, near, label, parts), parts)
    asked = np.random.default_rng(7).permutation(len(sample))[:500]
    truth = sample[asked] @ sample.T
    truth[np.arange(len(asked)), asked] = -np.inf
    best = np.argpartition(-truth, min(k, len(sample) - 2), axis=1)[:, :k]
    placed = router.scores(sample, False).argmax(1)
    rank = np.argsort(np.argsort(-router.scores(sample[asked], True), axis=1, kind="stable"), axis=1)
    needs = np.take_along_axis(rank, placed[best], 1)
    recall = [(needs < m).mean() for m in range(1, parts + 1)]
    router.probes = int(np.argmax(np.array(recall) >= RECALL)) + 1
    return router


def _route(routers: dict[int, Router], at: int, held: dict[tuple[int, int], int] | None = None, least: int = 0):
    """Adds ``parts``: the likeliest partition of a row; with ``held`` (rows by length and partition), those that a query asks.

    A query asks on until its partitions hold ``least`` rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                b = whole.slice(a, 1024)
                lens = b.column(at).value_lengths().to_numpy(zero_copy_only=False)
                out = np.empty(b.num_rows, object)
                for d in np.unique(lens).tolist():
                    rows, r = np.flatnonzero(lens == d), routers[d]
                    p = r.scores(V.matrix(b.column(at).take(pa.array(rows))), held is not None)
                    order = np.argsort(-p, axis=1, kind="stable").astype(np.int32)
                    ask = np.ones(len(rows), int)
                    if held is not None:
                        there = np.cumsum(np.array([held.get((d, k), 0) for k in range(p.shape[1])])[order], axis=1)
                        ask = np.minimum(np.maximum(r.probes, 1 + (there < least).sum(1)), p.shape[1])
                    for i, o, m in zip(rows, order, ask.tolist(), strict=True):
                        out[i] = o[:m]
                parts = pa.array(out.tolist(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.columns, parts], [*b.schema.names, "parts"])

    return run


def best(qid: np.ndarray, q: np.ndarray, rid: np.ndarray, r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, row ids (given in ascending order) and scores of each query's ``k`` best rows but its own, ties to the smaller id."""
    rough = q @ r.T
    rough[qid[:, None] == rid[None, :]] = -np.inf
    m = min(len(r), k + 8)
    if m < len(r):
        at = np.sort(np.argpartition(-rough, m - 1, axis=1)[:, :m], axis=1)
    else:
        at = np.broadcast_to(np.arange(m), (len(q), m))
    near = np.take_along_axis(rough, at, 1)
    exact = np.where(np.isinf(near), near, (r[at] * q[:, None, :]).sum(-1))  # the same sum for equal vectors wherever they stand
    first = np.argsort(-exact, axis=1, kind="stable")[:, :k]
    ids, scores = rid[np.take_along_axis(at, first, 1)], np.take_along_axis(exact, first, 1)
    if m < len(r):  # where rows as near as the last one may have been left out, all such are looked at
        last = np.partition(rough, len(r) - k, axis=1)[:, len(r) - k]
        slack = 1e-9 * (1 + np.abs(np.where(np.isinf(last), 0, last)))
        for i in np.flatnonzero((rough >= (last - slack)[:, None]).sum(1) > m).tolist():
            every = np.flatnonzero((rough[i] >= last[i] - slack[i]) & ~np.isinf(rough[i]))
            s = (r[every] * q[i]).sum(-1)
            top = np.argsort(-s, kind="stable")[:k]
            ids[i, : len(top)], scores[i, : len(top)], scores[i, len(top) :] = rid[every][top], s[top], -np.inf
    got = ~np.isinf(scores)
    return np.repeat(qid, got.sum(1)), ids[got], scores[got]


def _search(k: int, number: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                qid, rid = V.longs(batch["qid"][n]), V.longs(batch["rid"][n])
                q, r = V.doubles(batch["qv"][n], len(qid), number), V.doubles(batch["rv"][n], len(rid), number)
                for a in range(0, len(q), BLOCK):
                    found = best(qid[a : a + BLOCK], q[a : a + BLOCK], rid, r, k)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of largest inner product found for each query, nearest first.

    Ties go to the smaller id; rows with the query's own id are left out; a query whose
    partitions hold too few rows asks further ones, so it gets ``k`` rows, or all other
    rows of its length if they are fewer. Vectors that are null, empty, zero or hold
    null or non-finite components, and rows without an id, take no part. Repeated rows
    are separate candidates; of repeated query ids the least vector is asked. Empty
    tables give no rows.
    """
    base = rows.select(F.col(row_id).cast("long").alias("id"), F.col(vector).alias("v"))
    base = base.where(V.usable("v") & F.col("id").isNotNull()).withColumn("dims", F.size("v"))
    asked = queries.select(F.col(row_id).cast("long").alias("id"), F.col(vector).alias("v"))
    asked = asked.where(V.usable("v") & F.col("id").isNotNull()).groupBy("id").agg(F.min("v").alias("v"))
    sizes = dict(base.groupBy("dims").count().collect())
    routers = {}
    for d, n in sizes.items():
        unit = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 30)) / F.lit(1 << 30)
        sample = base.where((F.col("dims") == d) & (unit < min(1.0, SAMPLE / n))).select("v").collect()
        sample = np.array([r.v for r in sample], float).reshape(-1, d) if sample else np.ones((1, d))
        routers[d] = fit(sample, partitions(n, len(sample), k), k)
    placed = base.mapInArrow(_route(routers, 1), _schema(base, "parts array<int>"))
    placed = materialize(placed.withColumn("part", F.col("parts")[0]).drop("parts"))
    held = {(d, p): n for d, p, n in placed.groupBy("dims", "part").count().collect()}  # as many as partitions
    pieces = rows.sparkSession.createDataFrame([(d, p, -(-n // CHUNK)) for (d, p), n in held.items()], "dims int, part int, pieces int")
    pieces, by = F.broadcast(pieces), ["dims", "part", "salt"]
    salted = placed.join(pieces, ["dims", "part"]).withColumn("salt", F.pmod(F.xxhash64("id", "v"), F.col("pieces")).cast("int"))
    packed = V.packed_chunks(salted, by, ["id"], "v", k + 1).toDF(*by, "rid", "rv")  # of equal vectors only k + 1 can come among the k nearest
    asked = materialize(asked.withColumn("dims", F.size("v")).where(F.col("dims").isin(*routers) if routers else F.lit(False)))
    heaps = -(-asked.count() // QUERIES) or 1
    sent = asked.mapInArrow(_route(routers, 1, held, k + 1), _schema(asked, "parts array<int>"))
    sent = sent.withColumn("part", F.explode("parts")).join(pieces, ["dims", "part"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    sent = sent.withColumn("heap", F.pmod(F.xxhash64("id"), F.lit(heaps)))
    asked = V.packed_chunks(sent, [*by, "heap"], ["id"], "v").toDF(*by, "heap", "qid", "qv")
    work = asked.join(packed, by).select("qid", "qv", "rid", "rv")
    found = work.mapInArrow(_search(k, V.kind(base, "v")), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_embeddings(table: DataFrame) -> DataFrame:
    """The 20 nearest rows of every row whose vec_id is divisible by 20.

    Vectors that are null, zero or not finite, and null ids, ask for nothing and are not found; an empty table gives no rows; further columns go.
    """
    return nearest(table, table.where(F.col("vec_id") % 20 == 0), 20)
