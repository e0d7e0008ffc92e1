"""Byte-level BPE over a global shuffle of distinct words.

1. Blocks: a task cuts its rows in blocks of about ``BLOCK`` characters or ``TOKENS``
   pre-tokens and notes every pre-token as (row, position, code), the code pointing to
   the block's own list of distinct words. A hot word so leaves a block once, however
   often it occurs. Blocks are written to a bucketed table before anything reads them:
   word lists and reassembly see the same blocks whatever task is run again.
2. Words go to buckets by their crc32; a bucket sees all blocks' copies of a word and
   encodes it once.
3. Ids return to their blocks, which stay where their bucket is; positions take them up
   again, and rows get their ids, in slices of about ``SLICE`` ids.
4. Decoding joins ids with the token-byte table, an array lookup as ids are dense
   (the table is a vocabulary's: bounded whatever the corpus).

Word lists, codes and ids travel packed, so table and shuffles stay below the size of the input.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed
from .language import _schema
from .pretoken import each_piece, pieces

RANKS = "byte_bpe_50k.tiktoken"
BLOCK, TOKENS = 6_000_000, 2_000_000  # characters and pre-tokens of a block at most, but for the row that crosses them
SLICE = 1 << 18  # ids of the rows that are returned together, but for the row that crosses it
LONG = 1 << 20  # characters or ids of a text from which on it is taken in parts
MOST_BUCKETS = 1 << 14  # of words: a block's list for a bucket should not shrink to single words


@cache
def encoding(name: str):
    """Encoder of one piece (no special tokens), of the vocabulary file ``name``."""
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(name), special_tokens={})


@cache
def ranks(name: str) -> dict[bytes, int]:
    with open(public_tokenizers.path(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def token_bytes(name: str) -> tuple[np.ndarray, np.ndarray]:
    """Token-byte table by id: where each token's bytes start (one more at the end), and all bytes."""
    table = ranks(name)
    tokens: list[bytes] = [b""] * (max(table.values()) + 1)
    for token, i in table.items():
        tokens[i] = token
    return np.concatenate(([0], np.cumsum([len(t) for t in tokens]))), np.frombuffer(b"".join(tokens), np.uint8)


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of the runs [start, start + len), one after the other."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    full = lens > 0
    starts, lens = starts[full], lens[full]
    step = np.ones(total, np.int64)
    ends = np.cumsum(lens)
    step[0] = starts[0]
    step[ends[:-1]] = starts[1:] - starts[:-1] - lens[:-1] + 1
    return np.cumsum(step)


def decoded(ids: np.ndarray, name: str = RANKS) -> Iterator[bytes]:
    """Bytes of the ids by the token-byte table, in parts of bounded size."""
    at, data = token_bytes(name)
    for k in range(0, len(ids), LONG):
        i = ids[k : k + LONG].astype(np.int64)
        yield data[ragged(at[i], at[i + 1] - at[i])].tobytes()


def decode(ids: np.ndarray, name: str = RANKS) -> bytes:
    """Bytes of the ids, by the token-byte table."""
    return b"".join(decoded(ids, name))


def _decoded_sha256(ids: np.ndarray, name: str) -> str:
    h = hashlib.sha256()
    for part in decoded(ids, name):
        h.update(part)
    return h.hexdigest()


class _Codes(dict):
    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        return code


def _planes(a: np.ndarray) -> bytes:
    """Bytes of 32-bit numbers by significance: they pack better apart."""
    return zstandard.compress(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unplanes(b: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(b), np.uint8) if b else np.zeros(0, np.uint8)
    return np.ascontiguousarray(flat.reshape(4, -1).T).reshape(-1).view("<u4")


def _strings(words: list[bytes]) -> bytes:
    return zstandard.compress(np.array([len(words), *map(len, words)], "<u4").tobytes() + b"".join(words), 1)


def _unstrings(b: bytes) -> list[bytes]:
    raw = zstandard.decompress(b)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4)) + 4 * (n + 1)
    starts = [4 * (n + 1), *ends[:-1].tolist()]
    return [raw[a:b] for a, b in zip(starts, ends.tolist(), strict=True)] if n else []


_BLOCKS = "block long, rows binary, counts binary, codes binary, buckets binary, words array<struct<bucket:int,words:binary>>"
_WORDS = pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.binary())]))


def spark_hash(x: np.ndarray) -> np.ndarray:
    """Spark's hash (Murmur3 of 32 bits, seed 42) of longs, as it deals rows to partitions and buckets."""

    def turned(a: np.ndarray, by: int) -> np.ndarray:
        return a << np.uint32(by) | a >> np.uint32(32 - by)

    x = x.astype(np.int64).view(np.uint64)
    h = np.full(len(x), 42, np.uint32)
    for half in (x, x >> np.uint64(32)):
        k = half.astype(np.uint32) * np.uint32(0xCC9E2D51)
        h = turned(h ^ turned(k, 15) * np.uint32(0x1B873593), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> np.uint32(shift)) * np.uint32(by)
    return (h ^ h >> np.uint32(16)).view(np.int32)


def block_names(part: int, n: int) -> Iterator[int]:
    """Names for a task's blocks, all of one bucket of ``n``: a task writes one file, and tasks spread evenly over the buckets."""
    for at in range(part << 40, (part + 1) << 40, 8 * n):
        names = np.arange(at, at + 8 * n)
        yield from names[spark_hash(names) % n == part % n].tolist()


def _to_blocks(at: int, buckets: int, parts_out: int):
    def pack(block: int, codes: _Codes, rows: list[pa.RecordBatch], parts: list[np.ndarray]) -> pa.RecordBatch:
        words = [w.encode() for w in codes]
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.uint32, len(words))
        order = np.argsort(bucket, kind="stable")
        ends = np.flatnonzero(np.diff(bucket[order], append=-1)) + 1
        lists, a = [], 0
        for b in ends.tolist() if len(order) else ():
            lists.append({"bucket": int(bucket[order[a]]), "words": _strings([words[i] for i in order[a:b]])})
            a = b
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for r in rows:
                out.write_batch(r)
        counts = np.array([len(p) for p in parts], np.uint32)
        every = np.concatenate([*parts, np.zeros(0, np.uint32)])
        cells = [[block], [sink.getvalue().to_pybytes()], [_planes(counts)], [_planes(every)], [_planes(bucket)], [lists]]
        types = [pa.int64(), *[pa.binary()] * 4, _WORDS]
        names = ["block", "rows", "counts", "codes", "buckets", "words"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names = block_names(TaskContext.get().partitionId(), parts_out)
        codes, rows, parts, size, tokens = _Codes(), [], [], 0, 0
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                done = 0
                for i, t in enumerate(b.column(at)):
                    text = t.as_py() or ""
                    size += len(text)
                    if len(text) < LONG:
                        found = pieces(text)
                        parts.append(np.fromiter(map(codes.__getitem__, found), np.uint32, len(found)))
                    else:
                        parts.append(np.fromiter(map(codes.__getitem__, each_piece(text)), np.uint32))
                    tokens += len(parts[-1])
                    if size >= BLOCK or tokens >= TOKENS:
                        rows.append(b.slice(done, i + 1 - done).remove_column(at))
                        yield pack(next(names), codes, rows, parts)
                        codes, rows, parts, size, tokens, done = _Codes(), [], [], 0, 0, i + 1
                if done < b.num_rows:
                    rows.append(b.slice(done).remove_column(at))
        if rows:
            yield pack(next(names), codes, rows, parts)

    return run


def _encode(name: str):
    """Word lists (sorted by bucket) to their ids; a word is encoded once in its bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, known, now = encoding(name), {}, None
        single = enc._encode_single_piece
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                b, ids = whole.slice(k, 512), []
                for bucket, words in zip(b["bucket"].to_pylist(), b["words"], strict=True):
                    if bucket != now:
                        known, now = {}, bucket
                    lens, flat = [], []
                    for w in _unstrings(words.as_py()):
                        got = known.get(w)
                        if got is None:
                            got = known[w] = tuple(single(w))
                        lens.append(len(got))
                        flat += got
                    ids.append(_planes(np.array([len(lens), *lens, *flat], np.uint32)))
                yield pa.RecordBatch.from_arrays([b["block"], b["bucket"], pa.array(ids, pa.binary())], ["block", "bucket", "ids"])

    return run


def _taken(codes: np.ndarray, start: np.ndarray, length: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Ids of the words that ``codes`` name, one after the other."""
    out = [ids[ragged(start[c], length[c])] for k in range(0, len(codes), LONG) for c in (codes[k : k + LONG],)]
    return out[0] if len(out) == 1 else np.concatenate([*out, np.zeros(0, np.uint32)])


def _reassemble(name: str, finish, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from block(*(batch[c][k] for c in ("rows", "counts", "codes", "buckets", "lists")))

    def block(rows, counts, codes, buckets, lists) -> Iterator[pa.RecordBatch]:
        bucket = _unplanes(buckets.as_py())
        order = np.argsort(bucket, kind="stable")
        held = lists.values
        lens, ids = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
        for i in np.argsort(held.field("bucket").to_numpy(zero_copy_only=False)).tolist() if held is not None else ():
            a = _unplanes(held.field("ids")[i].as_py())
            lens.append(a[1 : 1 + a[0]])
            ids.append(a[1 + a[0] :])
        lens, ids = np.concatenate(lens).astype(np.int64), np.concatenate(ids)
        if len(lens) != len(bucket):
            raise ValueError("a block's words and ids differ in number")
        first = np.cumsum(lens) - lens
        start, length = np.empty_like(first), np.empty_like(lens)  # by code
        start[order], length[order] = first, lens
        codes, n = _unplanes(codes.as_py()), _unplanes(counts.as_py()).astype(np.int64)
        ends = np.cumsum(n)
        size = np.concatenate(([0], np.cumsum(np.concatenate([length[codes[k : k + LONG]] for k in range(0, len(codes), LONG)] or [lens[:0]]))))
        size = size[ends] - size[ends - n]  # ids of each row
        rows = pa.ipc.open_stream(rows.as_buffer()).read_all().combine_chunks()
        a = 0
        while a < len(n):
            b = max(a + 1, int(np.searchsorted(np.cumsum(size[a:]), SLICE, "right")) + a)
            docs = [_taken(codes[e - m : e], start, length, ids) for e, m in zip(ends[a:b].tolist(), n[a:b].tolist(), strict=True)]
            out = finish(rows.slice(a, b - a), docs, name)
            yield from out.select(names).combine_chunks().to_batches()
            a = b

    return run


def _joined(df: DataFrame, text: str, name: str, finish, more: str) -> DataFrame:
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = _schema(df.drop(text), more)
    buckets = min(4 * n, MOST_BUCKETS)
    blocks = bucketed(df.mapInArrow(_to_blocks(df.columns.index(text), buckets, n), _BLOCKS), "block", n)
    lists = blocks.select("block", F.explode("words").alias("w")).select("block", "w.bucket", "w.words")
    lists = lists.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_encode(name), "block long, bucket int, ids binary")
    lists = lists.groupBy("block").agg(F.collect_list(F.struct("bucket", "ids")).alias("lists"))
    # a block without a word (of empty texts) has no list
    both = blocks.drop("words").join(lists, "block", "left").select("rows", "counts", "codes", "buckets", "lists")
    return both.mapInArrow(_reassemble(name, finish, schema.names), schema)


def _with_ids(rows: pa.Table, ids: list[np.ndarray], name: str) -> pa.Table:
    offsets = np.cumsum([0, *map(len, ids)])
    flat = np.concatenate([*ids, np.zeros(0, np.uint32)])
    return rows.append_column("ids", pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int32))))


def encode_texts(df: DataFrame, text: str = "text", name: str = RANKS) -> DataFrame:
    """All columns of ``df`` but ``text``, plus ``ids`` (array<int>), the text's token ids without special tokens.

    Equal to encoding every match of the pattern separately. Null and empty
    texts give no ids; repeated rows stay repeated; a column ``ids`` is replaced;
    an empty table gives no rows. Row order is not kept. ``df`` is read when this
    is called: its blocks are written to the shared folder.
    """
    return _joined(df.drop("ids"), text, name, _with_ids, "ids array<int>")


def decode_ids(df: DataFrame, ids: str = "ids", name: str = RANKS) -> DataFrame:
    """``df`` with ``ids`` replaced by ``bytes``; null ids give no bytes, an empty table no rows; other columns stay but ``bytes`` is replaced."""
    df = df.select(*[c for c in df.columns if c != "bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                at = b.schema.names.index(ids)
                out = [decode(x.values.to_numpy(zero_copy_only=False), name) if x.is_valid else b"" for x in b.column(at)]
                yield pa.RecordBatch.from_arrays(
                    [*(c for i, c in enumerate(b.columns) if i != at), pa.array(out, pa.binary())], [*(c for c in b.schema.names if c != ids), "bytes"]
                )

    return df.mapInArrow(run, _schema(df.drop(ids), "bytes binary"))


def _digests(rows: pa.Table, ids: list[np.ndarray], name: str) -> pa.Table:
    rows = rows.append_column("n_tokens", pa.array([len(x) for x in ids], pa.int64()))
    rows = rows.append_column("ids_sha256", pa.array([hashlib.sha256(x.astype("<u4", copy=False)).hexdigest() for x in ids], pa.string()))
    return rows.append_column("decoded_sha256", pa.array([_decoded_sha256(x, name) for x in ids], pa.string()))


def tokenize_documents(docs: DataFrame, name: str = RANKS) -> DataFrame:
    """Digest for ``documents``: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no ids and the hashes of nothing; repeated rows and null ids stay; an empty table gives no rows.
    """
    return _joined(docs.select("doc_id", "text"), "text", name, _digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _training_rows(rows: pa.Table, ids: list[np.ndarray], name: str) -> pa.Table:
    out = _with_ids(rows, ids, name).append_column("n_tokens", pa.array([len(x) for x in ids], pa.int64()))
    return out.append_column("decoded_sha256", pa.array([_decoded_sha256(x, name) for x in ids], pa.string()))


def training_rows(docs: DataFrame, text: str = "text", name: str = RANKS) -> DataFrame:
    """All columns of ``docs`` but ``text``, plus ids, n_tokens and decoded_sha256, the hash of the decoded bytes.

    Null and empty texts give no ids and the hash of nothing; repeated rows stay
    repeated; columns of the three names are replaced; an empty table gives no rows.
    """
    docs = docs.drop("ids", "n_tokens", "decoded_sha256")
    return _joined(docs, text, name, _training_rows, "ids array<int>, n_tokens long, decoded_sha256 string")
