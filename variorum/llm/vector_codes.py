"""Vector codes: parts of vectors replaced by the nearest entry of a codebook, in exact integers.

Assignment is an Exponion search. A part starts at the entry it had before, at squared
distance U. Any entry as near lies within twice that distance of the start, so of the
start's neighbours, sorted by distance, only those up to a squared distance of 4 U are
scanned; ties go to the lower index. All rows of a block step through their lists
together, those whose radius is passed drop out.

Codebooks (``ENTRIES`` x length of a vector, whatever the rows) travel with the tasks.
Each task returns one sum and count an entry; sums of all tasks give the next codebook.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_skewed, materialize

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
MOST = 1 << 23  # whole numbers are held within +-MOST, so that sums of squares over 8,192 components fit 63 bits
BLOCK = 1 << 14  # rows searched together


@dataclass
class Codebooks:
    """Entries of all parts, (part, entry, component), and for each entry its part's entries by distance."""

    entries: np.ndarray

    def __post_init__(self) -> None:
        parts, n, size = self.entries.shape
        self.flat = self.entries.reshape(parts * n, size)
        self.order = np.empty((parts * n, n), np.int64)
        self.apart = np.empty((parts * n, n), np.int64)
        for p, e in enumerate(self.entries):
            d = ((e[:, None] - e[None]) ** 2).sum(-1)
            by = np.argsort(d, axis=1, kind="stable")
            self.order[p * n : (p + 1) * n] = by + p * n
            self.apart[p * n : (p + 1) * n] = np.take_along_axis(d, by, 1)

    def search(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest entry and squared distance of every part of rows ``x`` (row, part, component), from entries ``start`` (row, part).

        Also gives how many distances it took.
        """
        rows, parts, size = x.shape
        n = self.entries.shape[1]
        offset = np.tile(np.arange(parts) * n, rows)
        x, first = x.reshape(rows * parts, size), start.reshape(-1).astype(np.int64) + offset
        best, least = first.copy(), ((x - self.flat[first]) ** 2).sum(-1)
        reach = 4 * least
        alive, taken = np.arange(rows * parts), rows * parts
        for step in range(n):
            alive = alive[self.apart[first[alive], step] <= reach[alive]]
            if not len(alive):
                break
            entry = self.order[first[alive], step]
            d = ((x[alive] - self.flat[entry]) ** 2).sum(-1)
            taken += len(alive)
            nearer = (d < least[alive]) | ((d == least[alive]) & (entry < best[alive]))
            won = alive[nearer]
            best[won], least[won] = entry[nearer], d[nearer]
        return (best - offset).reshape(rows, parts), least.reshape(rows, parts), taken

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.flat.reshape(-1).tolist())).encode()).hexdigest()


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(256 x) of finite numbers, held within +-``MOST``."""
    return np.clip(np.floor(x.astype(np.float64) * SCALE), -MOST, MOST).astype(np.int64)


def takes_part(vector: str) -> Column:
    """Vectors that aren't null and hold no null or non-finite component."""
    inf = float("inf")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(inf)))
    return F.coalesce(F.col(vector).isNotNull() & ~bad, F.lit(False))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of up to ``BLOCK``, whatever size Spark sends them in."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= BLOCK:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches(BLOCK)
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches(BLOCK)


def _numbers(b: pa.RecordBatch, width: int) -> np.ndarray:
    """Packed whole numbers of the rows as (row, part, component)."""
    flat = np.frombuffer(b"".join(b["numbers"].to_pylist()), "<i4")
    return flat.reshape(b.num_rows, PARTS, width // PARTS).astype(np.int64)


def _packed(rows: np.ndarray) -> pa.Array:
    """Each row's bytes as one cell."""
    flat = np.ascontiguousarray(rows)
    size = flat[0].nbytes if len(flat) else 0
    offsets = np.arange(len(flat) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


_ROWS = "vec_id long, label_key long, no_label boolean, numbers binary, codes binary"
_KEPT = ["vec_id", "label_key", "no_label"]


def _to_numbers(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            v = b["vector"]
            lens = v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            out = np.zeros((b.num_rows, width), "<i4")
            row = np.repeat(np.arange(b.num_rows), lens)
            at = np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens)
            out[row, at] = whole_numbers(v.flatten().to_numpy(zero_copy_only=False))
            codes = np.zeros((b.num_rows, PARTS), np.uint8)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in _KEPT), _packed(out), _packed(codes)], [*_KEPT, "numbers", "codes"])

    return run


def _codes(b: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(b["codes"].to_pylist()), np.uint8).reshape(b.num_rows, PARTS)


def _assign(books: Codebooks, width: int, last: bool):
    """Rows with their new codes, or at last their codes as text and their errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            best, least, _ = books.search(_numbers(b, width), _codes(b))
            codes = best.astype(np.uint8)
            if last:
                text = codes.tobytes().hex()
                text = [text[k : k + 2 * PARTS] for k in range(0, len(text), 2 * PARTS)]
                cells = {"code": pa.array(text, pa.string()), "error": pa.array(least.sum(1), pa.int64())}
            else:
                cells = {"numbers": b["numbers"], "codes": _packed(codes)}
            yield pa.RecordBatch.from_arrays([*(b[c] for c in _KEPT), *cells.values()], [*_KEPT, *cells])

    return run


def _sums(n: int, width: int):
    """One row an entry in use: how many parts it has in this task, and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(PARTS * n, np.int64), np.zeros((PARTS * n, width // PARTS), np.int64)
        for b in _blocks(batches):
            entry = (_codes(b).astype(np.int64) + np.arange(PARTS) * n).reshape(-1)
            x = _numbers(b, width).reshape(len(entry), -1)
            count += np.bincount(entry, minlength=PARTS * n)
            np.add.at(total, entry, x)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], ["entry", "n", "sums"])

    return run


def _updated(rows: DataFrame, books: Codebooks, width: int) -> Codebooks:
    """Each entry replaced by the floor of the mean of its parts; entries without parts stay."""
    n = books.entries.shape[1]
    sums = rows.select("numbers", "codes").mapInArrow(_sums(n, width), "entry int, n long, sums array<long>")
    sums = sums.select("entry", "n", F.posexplode_outer("sums").alias("at", "x")).groupBy("entry", "at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    flat = books.flat.copy()
    for r in sums.collect():  # entries x components of a part, whatever the rows
        if r["at"] is not None:
            flat[r["entry"], r["at"]] = int(r["x"]) // int(r["n"])
    return Codebooks(flat.reshape(books.entries.shape))


def compress_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector that is not null and all finite.

    Codebooks start at the vectors of the ``ENTRIES`` least ids (fewer vectors: as many
    entries; ids that repeat: by vector; null ids last). Whole numbers beyond
    +-``MOST`` are held there. Vectors shorter than the longest, or of a length that
    ``PARTS`` does not divide, count as filled with zeros. Repeated rows stay repeated, a
    null label is a label of its own, further columns go; an empty table, or one without
    a usable vector, gives no rows.
    """
    key = F.coalesce(F.col(label).cast("long"), F.lit(0))
    kept = df.where(takes_part(vector)).select(
        F.col(vec_id).cast("long").alias("vec_id"), key.alias("label_key"), F.col(label).isNull().alias("no_label"), F.col(vector).alias("vector")
    )
    longest = kept.agg(F.max(F.size("vector"))).first()[0]
    width = -(-(longest or 0) // PARTS) * PARTS
    first = kept.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).collect()
    start = np.zeros((len(first), width), np.int64)
    for k, r in enumerate(first):
        start[k, : len(r["vector"])] = whole_numbers(np.array(r["vector"], np.float64))
    books = Codebooks(np.ascontiguousarray(start.reshape(len(first), PARTS, width // PARTS).transpose(1, 0, 2)))
    rows = kept.mapInArrow(_to_numbers(width), _ROWS)
    for _ in range(ROUNDS if first else 0):
        rows = materialize(rows.mapInArrow(_assign(books, width, False), _ROWS))
        books = _updated(rows, books, width)
    out = rows.mapInArrow(_assign(books, width, True), "vec_id long, label_key long, no_label boolean, code string, error long")
    out = materialize(out)
    labels = out.groupBy("label_key", "no_label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    out = join_skewed(out, materialize(labels, compact=True), ["label_key", "no_label"])
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def oracle() -> str:
    """The digest of ``embeddings`` as SQL, for vectors whose length ``PARTS`` divides."""

    def assign(codebook: str, name: str) -> str:
        d = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"
        return f""", {name}d AS (SELECT r, part, x, entry, coalesce({d}, 0) AS d FROM parts JOIN {codebook} USING (part)),
{name} AS (SELECT r, part, any_value(x) AS x, arg_min(entry, [d, entry]) AS entry, min(d) AS d FROM {name}d GROUP BY r, part)"""

    def update(codebook: str, assigned: str, name: str) -> str:
        return f""", {name}s AS (SELECT part, entry, i, sum(x[i])::HUGEINT AS s, count(*) AS n FROM {assigned}, unnest(range(1, len(x) + 1)) AS u(i) GROUP BY part, entry, i),
{name}m AS (SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS m FROM {name}s GROUP BY part, entry),
{name} AS (SELECT part, entry, coalesce(m, c) AS c FROM {codebook} LEFT JOIN {name}m USING (part, entry))"""

    return f"""WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda v: floor(v::DOUBLE * {SCALE})::BIGINT) AS v, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
parts AS (SELECT r, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS x FROM kept, unnest(range({PARTS})) AS p(part)),
c0 AS (SELECT part, r - 1 AS entry, x AS c FROM parts WHERE r <= {ENTRIES})
{assign("c0", "a1")}{update("c0", "a1", "c1")}{assign("c1", "a2")}{update("c1", "a2", "c2")}{assign("c2", "a3")},
coded AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a3 GROUP BY r),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), books"""
