"""Vector tables: which rows count, and chunks of packed vectors for numpy kernels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 4096


def usable(vector: str) -> Column:
    """Whether a vector takes part: not null, not empty, not all zero, every component finite."""
    inf = float("inf")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(inf))
    some = F.exists(vector, lambda x: x != 0) & ~F.exists(vector, bad)
    return F.coalesce(F.col(vector).isNotNull() & some, F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths, as float64."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def kind(df: DataFrame, vector: str) -> str:
    """Numpy type in which the column's numbers travel unchanged."""
    return "<f4" if df.schema[vector].dataType.elementType.simpleString() == "float" else "<f8"


def first_of_equal(ids: np.ndarray, vectors: np.ndarray, keep: int) -> np.ndarray:
    """Rows in order of id, of equal vectors only the ``keep`` first."""
    _, group = np.unique((vectors + 0.0).view(np.dtype((np.void, vectors.shape[1] * vectors.itemsize))).ravel(), return_inverse=True)
    order = np.lexsort((ids, group))
    start = np.flatnonzero(np.diff(group[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(start, np.diff(start, append=len(order)))
    rows = order[rank < keep]
    return rows[np.argsort(ids[rows], kind="stable")]


def packed_chunks(df: DataFrame, by: list[str], ids: list[str], vector: str, keep: int | None = None) -> DataFrame:
    """Rows of each value of ``by`` (which must bound their number) as one row: packed ids and vectors of type :func:`kind`.

    Gives ``by`` columns plus a binary per id column and ``vectors``. With ``keep``,
    rows stand by the first id, and of equal vectors only so many.
    """
    fields, number = [*ids, vector], kind(df, vector)
    rows = df.groupBy(*by).agg(F.collect_list(F.struct(*fields)).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):  # one at a time: a row is a whole chunk
                s = b["rows"][k].values
                names = [s.field(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in ids]
                m = s.field(vector).flatten().to_numpy(zero_copy_only=False).astype(number).reshape(len(s), -1)
                if keep is not None:
                    at = first_of_equal(names[0], m, keep)
                    names, m = [x[at] for x in names], m[at]
                cells = [pa.array([x.tobytes()], pa.binary()) for x in (*names, m)]
                yield pa.RecordBatch.from_arrays([*(b[c].slice(k, 1) for c in by), *cells], [*by, *ids, "vectors"])

    types = dict(df.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in by), *(f"{c} binary" for c in ids), "vectors binary"])
    return rows.mapInArrow(run, schema)


def longs(cell: pa.Scalar) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), np.int64)


def doubles(cell: pa.Scalar, n: int, number: str) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), number).reshape(n, -1).astype(np.float64)
