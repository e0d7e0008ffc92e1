"""Token-id files of patched frame-of-reference blocks.

A file row is a segment: whole documents in order, their ids cut in blocks of
``BLOCK``. A block keeps its minimum, packs the differences at a width that covers
``QUANTILE`` of them, and lists positions and values of those that don't fit. The
segment's index holds the byte start of each block, so any block is read alone.

Segments stand in Parquet files (one binary column), because only Spark's writers
reach every store and commit a task's files once. Rows are exchanged once, by range
of the id; totals of the written parts give every document's global start.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path
from .token_counts import _byte_letters

VOCABULARY = "byte_bpe_50k.json"
END = 0  # id after each document
BLOCK = 8192
QUANTILE = 0.95
SEGMENT = 1 << 18  # ids after which a segment ends, with a document
AT_ONCE = 1 << 18  # characters of the texts that the library gets in one call, but for a single longer one
LONG = 1 << 20  # characters beyond which a text is split as the file says, so that merges over it stay small
MAGIC = b"PFR1"
_HEAD = struct.Struct("<4sQI")  # magic, ids, blocks
_BLOCK = struct.Struct("<IIBI")  # minimum, ids, width, exceptions
#: the file's split, for which ``unsplit`` was made
_SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: bytes of ASCII and of U+00C0 to U+027F, which are letters but for U+00D7 and U+00F7
_PLAIN = bytes([*range(0xC0), *range(0xC3, 0xCA)])
#: apostrophes before a contraction's letters that aren't a contraction, or one with a letter behind it
_ACROSS = re.compile(r"'(?:(?<![^\W_]')[stvlmdr]|(?:[stmd]|re|ve|ll)[^\W\d_]|v(?!e)|l(?!l)|r(?!e))")


def _bits(rows: np.ndarray, width: int) -> np.ndarray:
    """Each row's values, least bit first, as one stream of ``width`` bits a value; eight values fill ``width`` bytes."""
    n = rows.shape[1]
    if not width:
        return np.zeros((len(rows), 0), np.uint8)
    eights = np.zeros((len(rows), -(-n // 8) * 8), np.uint64)
    eights[:, :n] = rows
    eights = np.ascontiguousarray(np.moveaxis(eights.reshape(len(rows), -1, 8), 2, 0))
    out = np.zeros((width, *eights.shape[1:]), np.uint8)
    for k in range(8):
        byte, shift = divmod(k * width, 8)
        value = eights[k] << np.uint64(shift)
        for i in range((shift + width + 7) // 8):
            out[byte + i] |= (value >> np.uint64(8 * i)).astype(np.uint8)
    return np.moveaxis(out, 0, 2).reshape(len(rows), -1)[:, : (n * width + 7) // 8]


def _values(rows: np.ndarray, width: int, n: int) -> np.ndarray:
    """The ``n`` values of each row of bytes that ``_bits`` made."""
    if not width:
        return np.zeros((len(rows), n), np.uint32)
    every = np.zeros((len(rows), -(-n // 8) * width), np.uint8)
    every[:, : rows.shape[1]] = rows
    every = every.reshape(len(rows), -1, width)
    out = np.empty((*every.shape[:2], 8), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for k in range(8):
        byte, shift = divmod(k * width, 8)
        value = np.zeros(every.shape[:2], np.uint64)
        for i in range((shift + width + 7) // 8):
            value |= every[:, :, byte + i].astype(np.uint64) << np.uint64(8 * i)
        out[:, :, k] = value >> np.uint64(shift) & mask
    return out.reshape(len(rows), -1)[:, :n]


def _packed(rows: np.ndarray) -> list[bytes]:
    """Blocks of equal length, packed; those of equal width at once."""
    low = rows.min(1)
    off = rows - low[:, None]
    at = int(np.ceil(QUANTILE * (rows.shape[1] - 1)))
    width = np.array([int(x).bit_length() for x in np.partition(off, at, axis=1)[:, at]])
    out: list[bytes] = [b""] * len(rows)
    for w in np.unique(width).tolist():
        same = np.flatnonzero(width == w)
        over = off[same] >> np.uint64(w) if w < 32 else np.zeros_like(off[same])
        bits = _bits(np.where(over, 0, off[same]), w)
        for i, high, b in zip(same.tolist(), over, bits, strict=True):
            where = np.flatnonzero(high)
            out[i] = b"".join((
                _BLOCK.pack(int(low[i]), rows.shape[1], w, len(where)), where.astype("<u4").tobytes(), off[i, where].astype("<u4").tobytes(), b.tobytes(),
            ))
    return out


def pack(ids: np.ndarray) -> bytes:
    """A segment: head, byte start of each block, blocks. A block: head, places and values of what exceeds its width, packed differences."""
    whole = len(ids) // BLOCK * BLOCK
    ids = ids.astype(np.uint32)
    blocks = _packed(ids[:whole].reshape(-1, BLOCK)) if whole else []
    blocks += _packed(ids[None, whole:]) if len(ids) > whole else []
    first = _HEAD.size + 8 * len(blocks)
    starts = first + np.cumsum([0, *map(len, blocks)])[:-1]
    return _HEAD.pack(MAGIC, len(ids), len(blocks)) + starts.astype("<u8").tobytes() + b"".join(blocks)


def unpack(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of a segment, or of its blocks ``first`` to ``last`` (exclusive) alone."""
    magic, _, n = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token-id segment")
    starts = np.frombuffer(data, "<u8", n, _HEAD.size)[first:last].tolist()
    heads = [_BLOCK.unpack_from(data, s) for s in starts]
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(heads)
    kinds: dict[tuple[int, int], list[int]] = {}
    for i, (_, size, width, _) in enumerate(heads):
        kinds.setdefault((size, width), []).append(i)
    for (size, width), same in kinds.items():
        at = [starts[i] + _BLOCK.size + 8 * heads[i][3] for i in same]
        rows = np.array([np.frombuffer(data, np.uint8, (size * width + 7) // 8, a) for a in at])
        for i, values in zip(same, _values(rows, width, size), strict=True):
            low, _, _, over = heads[i]
            values[np.frombuffer(data, "<u4", over, starts[i] + _BLOCK.size)] = np.frombuffer(data, "<u4", over, starts[i] + _BLOCK.size + 4 * over)
            out[i] = values + np.uint32(low)
    return np.concatenate([*out, np.zeros(0, np.uint32)])


@cache
def tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def crossed(tokens: Iterable[bytes]) -> set[bytes]:
    """Pairs of neighbouring bytes inside tokens between which the file's split may cut a plain text, but for letters after a contraction."""
    kinds = {b: "letter" if b > 127 or chr(b).isalpha() else "number" if chr(b).isdigit() else "other" for b in (*range(0x21, 0x7F), *range(0x80, 0x100))}
    pairs = {t[i : i + 2] for t in tokens if not t.translate(None, _PLAIN) for i in range(len(t) - 1)}
    return {p for p in pairs if p[1] not in kinds or p[0] != 0x20 and kinds.get(p[0]) != kinds[p[1]]}


@cache
def unsplit(name: str):
    """The tokenizer of the file without its split into words, which takes the library more time than the merges; None
    where other ids than the file's could come out for ``plain`` texts.

    A cut of the split changes ids only where a token lies across it. Such tokens begin with a contraction's
    apostrophe (``plain`` looks for them) or are two line feeds: the last before other text is cut off here as the file's split does it.
    """
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        file = json.load(f)
    model = file["model"]
    vocab, merges = model.pop("vocab"), model.pop("merges")
    if file["normalizer"] or file["post_processor"] or file["pre_tokenizer"] != _SPLIT or model.pop("type") != "BPE" or any(model.values()):
        return None
    of = {c: b for b, c in enumerate(_byte_letters())}
    if not crossed(bytes(map(of.__getitem__, t)) for t in vocab) <= {b"\n\n", *(b"'%c" % c for c in b"stvlmdr")}:
        return None
    t = Tokenizer(models.BPE(vocab, [tuple(m if isinstance(m, list) else m.split(" ")) for m in merges], cache_capacity=0))
    t.add_special_tokens([x for _, x in sorted(tokenizer(name).get_added_tokens_decoder().items())])
    cut = pre_tokenizers.Split(Regex(r"\n(?=\S)"), "isolated")
    t.pre_tokenizer = pre_tokenizers.Sequence([cut, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return t if t.get_vocab() == tokenizer(name).get_vocab() else None


def plain(text: str) -> bool:
    """Whether a text holds ASCII and Latin letters up to U+027F alone, and no apostrophe at which a token could lie across a cut."""
    if not text.isascii() and ("×" in text or "÷" in text or text.encode().translate(None, _PLAIN)):
        return False
    return len(text) <= LONG and not ("'" in text and _ACROSS.search(text))


def encode(texts: list[str], name: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of whole texts by the library's own call, each with the end id, and how many each has; some texts at a time."""
    whole, k = unsplit(name), 0
    while k < len(texts):
        to = k + 1
        size = len(texts[k])
        while to < len(texts) and size + len(texts[to]) <= AT_ONCE:
            size += len(texts[to])
            to += 1
        some = texts[k:to]
        found: list[list[int]] = [[]] * len(some)
        easy = [whole is not None and plain(x) for x in some]
        for t, kind in ((whole, True), (tokenizer(name), False)):
            if at := [i for i, e in enumerate(easy) if e == kind]:
                for i, x in zip(at, t.encode_batch_fast([some[i] for i in at], add_special_tokens=False), strict=True):
                    found[i] = x.ids
        ids = array("I")  # takes a list several times as fast as numpy does
        for x in found:
            ids.fromlist(x)
            ids.append(END)
        yield np.frombuffer(ids, np.uint32), np.array([len(x) + 1 for x in found], np.int64)
        k = to


_SEGMENT = "part int, first long, n_ids long, doc_ids array<long>, n_tokens array<long>, ids binary"


def _write(name: str):
    types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    names = ["part", "first", "n_ids", "doc_ids", "n_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, first = TaskContext.get().partitionId(), 0
        docs, lens, held, size = [], [], [], 0

        def segment() -> pa.RecordBatch:
            cells = [part, first, size, docs, np.concatenate(lens), pack(np.concatenate(held))]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types, strict=True)], names)

        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                names_of, done = b["doc_id"].to_pylist(), 0
                for ids, n in encode([t or "" for t in b["text"].to_pylist()], name):
                    docs += names_of[done : done + len(n)]
                    done += len(n)
                    lens.append(n)
                    held.append(ids)
                    size += len(ids)
                    if size >= SEGMENT:
                        yield segment()
                        first += size
                        docs, lens, held, size = [], [], [], 0
        if docs:
            yield segment()

    return run


def write_tokens(df: DataFrame, path: str, name: str = VOCABULARY) -> None:
    """Write the ids of ``text`` in ascending order of ``doc_id`` under ``path``.

    Null texts are empty, null ids come first, rows of equal id stand by the hash
    of their text and keep all their copies; an empty table writes no segment.
    Other columns are not read.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"_h": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_first(), "_h", "_row"]
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    rows.mapInArrow(_write(name), _SEGMENT).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, finish, schema: str) -> DataFrame:
    """Rows that ``finish(doc_ids, starts, list of ids)`` makes, as Arrow arrays, of each segment under ``path``.

    Repeated and null doc_ids come back as they were written, documents without ids
    not at all (each holds an end id); files without a segment give no rows.
    """
    files = spark.read.schema(_SEGMENT).parquet(path)
    totals = sorted(tuple(r) for r in files.groupBy("part").agg(F.sum("n_ids")).collect())  # as many as write tasks
    ends = np.cumsum([n for _, n in totals], dtype=np.int64)
    before = {p: int(e) - n for (p, n), e in zip(totals, ends, strict=True)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, first, docs, lens, ids in zip(b["part"], b["first"], b["doc_ids"], b["n_tokens"], b["ids"], strict=True):
                n = np.array(lens.as_py(), np.int64)
                to = np.cumsum(n)
                every = unpack(ids.as_buffer().to_pybytes())
                each = [every[e - k : e] for e, k in zip(to, n, strict=True)]
                yield pa.RecordBatch.from_arrays(*finish(docs.as_py(), before[part.as_py()] + first.as_py() + to - n, each))

    return files.select("part", "first", "doc_ids", "n_tokens", "ids").mapInArrow(run, schema)


def _digest(docs, starts, ids):
    cells = [
        pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array([len(x) for x in ids], pa.int64()),
        pa.array([zlib.crc32(x.astype("<u4", copy=False)) for x in ids], pa.int64()),
    ]
    return cells, ["doc_id", "start", "n_tokens", "ids_crc32"]


def _rows(docs, starts, ids):
    lists = pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))
    return [pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), lists], ["doc_id", "start", "ids"]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, ids`` (array<long>, the end id included) of the files under ``path``."""
    return read_tokens(spark, path, _rows, "doc_id long, start long, ids array<long>")


def token_files_of_documents(docs: DataFrame, path: str | None = None, name: str = VOCABULARY) -> DataFrame:
    """Digest read back from the files: doc_id, start, n_tokens, ids_crc32. ``path`` defaults to a new shared folder.

    Null texts are empty and hold the end id alone; rows of equal id keep all their
    copies, null ids come first; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_tokens(docs, path, name)
    return read_tokens(spark, path, _digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
