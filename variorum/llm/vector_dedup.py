"""Embedding near-duplicates by randomised-rotation binary codes.

A unit vector o, rotated at random, is kept as the signs of its components and the
correction factor f = <signs / sqrt(D), o>. For a rotated unit vector q,
<signs / sqrt(D), q> / f is an unbiased estimate of <o, q>; its error is
sqrt(1 - <o, q>^2) * sqrt(1 - f^2) / f times one component of a random unit vector
in D - 1 dimensions. A pair whose estimate lies below the threshold by more than
``SIGMAS`` of that error can't be a link (chance below 1e-8); all others are
computed again from the original vectors in double precision.

Equal vectors are one node. Nodes are gathered around a few pivots, cut in chunks
which hold codes, factors and original vectors, and chunk pairs are compared whole unless the angle between their centres proves
that no link joins them. A comparison gives counts and a spanning forest, no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from .common import connected_components, join_skewed, materialize
from .simhash import forest

SIGMAS = 6.0
PIVOTS = 256  # at most; they only group what lies together
CHUNK = 8192  # nodes of a chunk on average: what is sent falls with it
ROWS, COLS = 512, 2048  # of a comparison at once


@cache
def rotation(dims: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs and correction factors of rotated unit vectors."""
    return np.packbits(unit > 0, axis=1), np.abs(unit).sum(1) / np.sqrt(unit.shape[1])


def estimates(query: np.ndarray, bits: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the inner products of rotated queries with coded vectors."""
    d = query.shape[1]
    signs = np.unpackbits(bits, axis=1, count=d).astype(np.float32) * 2 - 1
    signs /= (np.sqrt(d) * factor)[:, None].astype(np.float32)
    return query.astype(np.float32) @ signs.T


def floors(factor: np.ndarray, threshold: float, dims: int) -> np.ndarray:
    """The least estimate that a pair at or above the threshold can show, by the correction factor."""
    spread = np.sqrt(np.maximum(0, 1 - factor**2)) / factor * SIGMAS / np.sqrt(max(1, dims - 1))
    c = np.linspace(threshold, 1, 65)[:, None]
    return (c - np.sqrt(np.maximum(0, 1 - c**2)) * spread[None, :]).min(0) - 1e-4


def links(
    x: np.ndarray, y: np.ndarray, bits: np.ndarray, factor: np.ndarray, threshold: float, same: bool
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of ``x`` and ``y`` (original vectors; codes and factors of the latter) with cosine at or above the threshold; i < j if same."""
    d = x.shape[1]
    unit = [z / np.linalg.norm(z, axis=1, keepdims=True) for z in ((x,) if same else (x, y))]
    x, y = unit[0], unit[-1]
    query = x @ rotation(d)
    least = floors(factor, threshold, d).astype(np.float32)
    for b in range(0, len(y), COLS):
        for a in range(0, len(x), ROWS):
            if same and b + COLS <= a:
                continue
            qa, yb = slice(a, a + ROWS), slice(b, b + COLS)
            i, j = np.nonzero(estimates(query[qa], bits[yb], factor[yb]) >= least[yb])
            if same:
                up = i + a < j + b
                i, j = i[up], j[up]
            if not len(i):
                continue
            if len(i) > 20_000:
                cosine = (x[qa] @ y[yb].T)[i, j]
            else:
                cosine = np.einsum("ij,ij->i", x[qa][i], y[yb][j])
            hit = cosine >= threshold
            if hit.any():
                yield i[hit] + a, j[hit] + b


def _code(number: str):
    """Adds ``bits`` and ``factors`` of a chunk's vectors, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[], []]
            for node, v in zip(b["node"], b["vectors"], strict=True):
                x = V.doubles(v, len(V.longs(node)), number)
                bits, factor = codes(x / np.linalg.norm(x, axis=1, keepdims=True) @ rotation(x.shape[1]))
                out[0].append(bits.tobytes())
                out[1].append(factor.tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(o, pa.binary()) for o in out)], [*b.schema.names, "bits", "factors"])

    return run


def _compare(threshold: float, number: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                same = batch["same"][k].as_py()
                x_node, x_copies = V.longs(batch["xn"][k]), V.longs(batch["xm"][k])
                x = V.doubles(batch["xv"][k], len(x_node), number)
                if same:
                    node, copies, y, shift = x_node, x_copies, x, 0
                else:
                    node = np.concatenate((x_node, V.longs(batch["yn"][k])))
                    copies = np.concatenate((x_copies, V.longs(batch["ym"][k])))
                    y, shift = V.doubles(batch["yv"][k], len(node) - len(x_node), number), len(x_node)
                bits = np.frombuffer(batch["yb"][k].as_buffer(), np.uint8).reshape(len(y), -1)
                factor = np.frombuffer(batch["yf"][k].as_buffer(), np.float64)
                n = np.zeros(len(node), np.int64)

                def counted(x=x, y=y, bits=bits, factor=factor, same=same, n=n, copies=copies, shift=shift):
                    for i, j in links(x, y, bits, factor, threshold, same):
                        np.add.at(n, i, copies[j + shift])
                        np.add.at(n, j + shift, copies[i])
                        yield i, j + shift

                member, root = forest(len(node), counted())
                up = np.arange(len(node))
                up[member] = root
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (node[some], n[some], node[up[some]])], ["node", "n", "root"])

    return run


def _placed(vector: str, at: int, pivots: dict[int, np.ndarray]):
    """Nearest pivot of each vector, and the angle to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                b = whole.slice(k, 1024)
                cell, angle = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
                lens = b.column(at).value_lengths().to_numpy(zero_copy_only=False)
                for d in np.unique(lens).tolist():
                    rows = np.flatnonzero(lens == d)
                    x = V.matrix(b.column(at).take(pa.array(rows)))
                    cosine = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ pivots[d].T
                    cell[rows], angle[rows] = cosine.argmax(1), np.arccos(np.clip(cosine.max(1), -1, 1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(angle)], [*b.schema.names, "cell", "angle"])

    return run


def near_vectors(df: DataFrame, row_id: str = "vec_id", vector: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every row of ``df``.

    ``n_links`` counts other rows at cosine ``threshold`` or more; ``component_id``
    is the least id reachable over links, and ``kept`` tells whether it is the row's own.
    Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing; vectors of different lengths don't link. Equal vectors all link.
    Repeated rows count as separate vectors; a null id stays null and is its own
    component unless a link reaches an id; an empty table gives no rows.
    """
    from .language import _schema

    rows = df.select(F.col(row_id).cast("long").alias("id"), F.col(vector).alias("v"), V.usable(vector).alias("ok"))
    nodes = rows.where("ok").groupBy("v").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    nodes = materialize(nodes.withColumns({"node": F.monotonically_increasing_id(), "dims": F.size("v")}))
    sizes = dict(nodes.groupBy("dims").count().collect())
    pivots = {}
    for d, n in sizes.items():
        k = max(1, min(PIVOTS, n // CHUNK))
        some = nodes.where(F.col("dims") == d).orderBy(F.xxhash64("node")).limit(k).select("v").collect()
        p = np.array([r.v for r in some], float)
        pivots[d] = p / np.linalg.norm(p, axis=1, keepdims=True)
    placed = nodes.select("node", "copies", "dims", "v")
    placed = materialize(placed.mapInArrow(_placed("v", 3, pivots), _schema(placed, "cell int, angle double")))
    counts = placed.groupBy("dims", "cell").count().collect()  # at most PIVOTS rows for each length
    first, total = {}, 0
    for d, c, n in sorted(counts):
        first[d, c] = (total, -(-n // CHUNK))
        total += -(-n // CHUNK)
    plan = df.sparkSession.createDataFrame(
        [(d, c, a, k) for (d, c), (a, k) in first.items()], "dims int, cell int, base long, parts long"
    )
    placed = placed.join(F.broadcast(plan), ["dims", "cell"])
    placed = placed.withColumn("chunk", F.col("base") + F.pmod(F.xxhash64("node"), F.col("parts")))
    number = V.kind(placed, "v")
    chunks = V.packed_chunks(placed, ["chunk"], ["node", "copies"], "v")
    chunks = materialize(chunks.mapInArrow(_code(number), _schema(chunks, "bits binary, factors binary")))
    reach = placed.groupBy("chunk", "dims", "cell").agg(F.max("angle").alias("reach"))
    pairs = chunk_pairs(reach, pivots, total, threshold)
    x = chunks.select("chunk", "node", "copies", "vectors").toDF("i", "xn", "xm", "xv")
    y = chunks.toDF("j", "yn", "ym", "yv", "yb", "yf")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = pairs.join(x, "i").join(y, "j").repartition(n, "i", "j")
    same = F.col("i") == F.col("j")
    both = both.select("xn", "xm", "xv", *[F.when(~same, F.col(c)).alias(c) for c in ("yn", "ym", "yv")], "yb", "yf", same.alias("same"))
    found = materialize(both.mapInArrow(_compare(threshold, number), "node long, n long, root long"), compact=True)
    comp = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("node").agg(F.sum("n").alias("n"))
    nodes = nodes.join(linked, "node", "left").join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
    n_links = (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links")
    nodes = materialize(nodes.select("v", "least", "root", n_links, F.col("copies").alias("n")))
    least = nodes.groupBy("root").agg(F.min("least").alias("component"))
    nodes = materialize(nodes.join(least, "root").select("v", "n_links", "component", "n"))
    out = join_skewed(rows.where("ok").select("id", "v"), nodes, ["v"]).select("id", "n_links", "component")
    out = out.unionByName(rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component")))
    component = F.coalesce("component", "id")
    return out.select("id", "n_links", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def chunk_pairs(reach: DataFrame, pivots: dict[int, np.ndarray], total: int, threshold: float) -> DataFrame:
    """Pairs ``(i, j)``, i <= j, of chunks of equal vector length that a link may join.

    Angles obey the triangle inequality: a link between members of two chunks
    needs an angle between their pivots of at most both reaches plus the link's own.
    """
    spark = reach.sparkSession
    near = [
        (d, a, b, float(np.arccos(np.clip(p[a] @ p[b], -1, 1)))) for d, p in pivots.items() for a in range(len(p)) for b in range(len(p))
    ]  # at most PIVOTS ** 2 rows for each length
    between = F.broadcast(spark.createDataFrame(near, "dims int, cell int, cell2 int, between double"))
    one = reach.select("dims", "cell", F.col("chunk").alias("i"), F.col("reach").alias("r1"))
    two = reach.select("dims", F.col("cell").alias("cell2"), F.col("chunk").alias("j"), F.col("reach").alias("r2"))
    own = float(np.arccos(threshold)) + 1e-6
    return (
        one.join(between, ["dims", "cell"])
        .join(two, ["dims", "cell2"])
        .where("i <= j")
        .where(F.col("between") <= F.col("r1") + F.col("r2") + own)
        .select("i", "j")
    )


def dedup_embeddings(table: DataFrame) -> DataFrame:
    """Digest for ``embeddings``: vec_id, n_links, component_id, kept.

    Vectors that are null, zero or not finite stay, without links; an empty table gives no rows; further columns go.
    """
    out = near_vectors(table)
    return out.withColumnRenamed("id", "vec_id")


#: DuckDB SQL for :func:`dedup_embeddings`
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  ok AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
  link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
  reach(id, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT id, b FROM reach JOIN link ON a = r),
  n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT id AS vec_id, coalesce(max(n), 0) AS n_links, min(r) AS component_id, id = min(r) AS kept FROM reach LEFT JOIN n ON a = id GROUP BY id"""
