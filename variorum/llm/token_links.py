"""Alignment of two tokenizers' tokens over the same bytes, and how often ids are linked in a corpus.

Token ends of each side are bits, one a byte, packed in 64-bit words. The AND of both
sides holds the shared cuts; cumulated popcounts give the tokens before a cut (rank),
so each group between two cuts is a range of tokens on either side. Links are all pairs of
a group's two sides, expanded in bounded pieces.

Counts over the corpus: documents are packed in blocks, each with its own list of distinct
pairs. Only such lists are shuffled (a pair that occurs everywhere leaves a block
once), and their counts return to the blocks, which stay in a bucketed table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import _planes, _unplanes, block_names, encoding, token_bytes
from .common import bucketed, join_skewed, materialize
from .language import _schema

SIDE_A, RANKS_A, SIDE_B = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
TEXTS, CHARACTERS = 256, 1 << 20  # texts aligned together at most, and their characters, but for the text that crosses them
LINKS = 1 << 20  # links expanded at once
BLOCK = 1 << 21  # distinct pairs of documents in a block, but for the document that crosses it

#: texts for the plain library: characters on which the two split patterns' engines could differ, and runs of white space beyond the faster one's stack
_ODD = re.compile("[\x1c-\x1f\x85\xa0\xb2\xb3\xb9\xbc-\xbeɐ-\U0010ffff]|\\s{500}")


class Sides:
    """Both tokenizers, and the bytes of each of their ids."""

    def __init__(self) -> None:
        import sentencepiece

        self._plain = Tokenizer.from_file(public_tokenizers.path(SIDE_A))
        self._plain.encode_special_tokens = True
        self._fast = encoding(RANKS_A)  # the same vocabulary and ids, several times faster
        self._b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(SIDE_B))
        at, data = token_bytes(RANKS_A)
        raw = data.tobytes()
        self.bytes_a = [raw[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        pieces = [(self._b.id_to_piece(i), self._b.is_byte(i)) for i in range(self._b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in pieces]
        self.lens_a, self.lens_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))

    def a(self, text: str) -> list[int]:
        if _ODD.search(text):
            return self._plain.encode(" " + text, add_special_tokens=False).ids
        return self._fast.encode_ordinary(" " + text)

    def both(self, text: str | None) -> tuple[list[int], list[int], int]:
        """Ids of both sides and the number of bytes; no ids where either side's bytes are not those of a space and the text."""
        if not text:
            return [], [], 0
        a, b, want = self.a(text), self._b.encode(text, num_threads=1), b" " + text.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != want or b"".join(map(self.bytes_b.__getitem__, b)) != want:
            return [], [], 0
        return a, b, len(want)


@cache
def sides() -> Sides:
    return Sides()


def ends_as_bits(lens: np.ndarray, words: int) -> np.ndarray:
    """Bit set (64-bit words, least bit first) of the last byte of each token."""
    marks = np.zeros(words * 64, np.uint8)
    marks[np.cumsum(lens) - 1] = 1
    return np.packbits(marks, bitorder="little").view("<u8")


def ranks_of(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bits are set up to each position, itself included."""
    before = np.concatenate(([0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)))
    word, bit = at >> 6, (at & 63).astype(np.uint64)
    after = bits[word] >> bit >> np.uint64(1)  # bits behind the position
    return before[word + 1] - np.bitwise_count(after)


def shared_cuts(lens_a: np.ndarray, lens_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes at which tokens of both sides end, and the number of tokens of each side up to there."""
    words = -(-int(lens_a.sum()) // 64)
    a, b = ends_as_bits(lens_a, words), ends_as_bits(lens_b, words)
    cuts = np.flatnonzero(np.unpackbits((a & b).view(np.uint8), bitorder="little"))
    return cuts, ranks_of(a, cuts), ranks_of(b, cuts)


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of their times."""
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(times, first) if len(first) else times[:0]


def linked_pairs(a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, A id, B id) as one number, 16 bits for each id, and how many links each has.

    ``to_a`` and ``to_b`` are the groups' ends in tokens, ``doc`` each group's document.
    """
    n_a, n_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
    size = n_a * n_b
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for g in np.flatnonzero(size > LINKS).tolist():  # a long stretch without a cut: by distinct ids
        x, n_x = np.unique(a[to_a[g] - n_a[g] : to_a[g]], return_counts=True)
        y, n_y = np.unique(b[to_b[g] - n_b[g] : to_b[g]], return_counts=True)
        key = int(doc[g]) << 32 | x.astype(np.int64)[:, None] << 16 | y.astype(np.int64)
        found.append((key.ravel(), (n_x[:, None] * n_y).ravel()))
    size = np.where(size > LINKS, 0, size)
    upto, g = np.cumsum(size), 0
    while g < len(size):
        done = upto[g] - size[g]
        h = max(g + 1, int(np.searchsorted(upto, done + LINKS, "right")))
        k = np.repeat(np.arange(g, h), size[g:h])  # each link's group
        within = np.arange(len(k)) - (upto[k] - size[k] - done)
        left = a[to_a[k] - n_a[k] + within // n_b[k]].astype(np.int64)
        right = b[to_b[k] - n_b[k] + within % n_b[k]].astype(np.int64)
        key = np.sort(doc[k] << 32 | left << 16 | right)
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
        found.append((key[first], np.diff(first, append=len(key))))
        g = h
    if len(found) == 1:
        return found[0]
    none = np.zeros(0, np.int64)
    return _summed(np.concatenate([none, *(x for x, _ in found)]), np.concatenate([none, *(n for _, n in found)]))


@cache
def _numbered() -> list[str]:
    """Ids as text with what may follow them: another of its side, the other side, the next group."""
    return [f"{i}{after}" for after in ",|;" for i in range(1 << 16)]


class Aligned:
    """Groups and links of some texts, which are aligned together: each text's end is a shared cut."""

    def __init__(self, texts: list[str | None]):
        found = [sides().both(t) for t in texts]
        self.n_a, self.n_b, size = (np.array([x if k == 2 else len(x) for x in col], np.int64) for k, col in enumerate(zip(*found, strict=True)))
        self.a, self.b = (np.fromiter(chain.from_iterable(x[k] for x in found), np.int32, int(n.sum())) for k, n in ((0, self.n_a), (1, self.n_b)))
        del found
        cuts, self.to_a, self.to_b = shared_cuts(sides().lens_a[self.a], sides().lens_b[self.b])
        self.doc = np.searchsorted(np.cumsum(size), cuts, "right")
        self.n_groups = np.bincount(self.doc, minlength=len(texts))
        self.keys, self.times = linked_pairs(self.a, self.b, self.to_a, self.to_b, self.doc)
        self.n_pairs = np.bincount(self.keys >> 32, minlength=len(texts))

    def written(self) -> list[str]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
        idx = np.empty(len(self.a) + len(self.b), np.int64)
        from_b = np.concatenate(([0], self.to_b))[:-1]
        n_a, n_b = np.diff(self.to_a, prepend=0), np.diff(self.to_b, prepend=0)
        at_a = np.arange(len(self.a)) + np.repeat(from_b, n_a)
        at_b = np.arange(len(self.b)) + np.repeat(self.to_a, n_b)
        idx[at_a], idx[at_b] = self.a, self.b
        idx[at_a[self.to_a - 1]] += 1 << 16
        idx[at_b[self.to_b - 1]] += 2 << 16
        strings, out, k = _numbered(), [], 0
        for n in (self.n_a + self.n_b).tolist():
            out.append("".join(map(strings.__getitem__, idx[k : k + n].tolist()))[:-1])
            k += n
        return out


def aligned_texts(texts: Iterator[str | None]) -> Iterator[Aligned]:
    """Texts aligned in slices of bounded size."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if len(held) >= TEXTS or size >= CHARACTERS:
            yield Aligned(held)
            held, size = [], 0
    if held:
        yield Aligned(held)


def align_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with a_ids, b_ids and groups, an array of (a_end, b_end): how many tokens of each side lie before each shared cut.

    Texts that are null, empty or not given back byte for byte by both sides have no
    tokens and no groups. Repeated rows stay repeated; columns of the three names are
    replaced; an empty table gives no rows.
    """
    df = df.drop("a_ids", "b_ids", "groups")
    at = df.columns.index(text)
    pair = pa.struct([("a_end", pa.int32()), ("b_end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for found in aligned_texts(x.as_py() for x in b.column(at)):
                n = len(found.n_a)
                ends_a, ends_b, ends_g = (np.cumsum(np.concatenate(([0], x))) for x in (found.n_a, found.n_b, found.n_groups))
                groups = pa.StructArray.from_arrays(
                    [pa.array((to - ends[found.doc]).astype(np.int32)) for to, ends in ((found.to_a, ends_a), (found.to_b, ends_b))], fields=list(pair)
                )
                lists = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), x) for e, x in ((ends_a, pa.array(found.a)), (ends_b, pa.array(found.b)), (ends_g, groups))]
                yield pa.RecordBatch.from_arrays([*b.slice(done, n).columns, *lists], [*b.schema.names, "a_ids", "b_ids", "groups"])
                done += n

    return df.mapInArrow(run, _schema(df, "a_ids array<int>, b_ids array<int>, groups array<struct<a_end:int,b_end:int>>"))


_DOC = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_pairs"]
_BLOCKS = "block long, docs binary, hashes array<string>, which binary, times binary, pairs binary, pair_docs binary"


def _to_blocks(parts_out: int):
    def pack(block: int, docs: list[np.ndarray], valid: list[np.ndarray], hashes: list[str], keys: list[np.ndarray], times: list[np.ndarray]) -> pa.RecordBatch:
        pairs, which, seen = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        times = np.concatenate(times)
        rows = np.concatenate([np.concatenate(docs, axis=1), np.concatenate(valid)[None]])
        cells = [[block], [rows.astype("<i8").tobytes()], [hashes], [_planes(which)], [times.astype("<i8").tobytes()], [_planes(pairs)], [_planes(seen)]]
        types = [pa.int64(), pa.binary(), pa.list_(pa.string()), *[pa.binary()] * 4]
        names = [c.split()[0] for c in _BLOCKS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names = block_names(TaskContext.get().partitionId(), parts_out)
        held: tuple[list, ...] = ([], [], [], [], [])
        size = 0
        for b in batches:
            done = 0
            for found in aligned_texts(x.as_py() for x in b["text"]):
                n = len(found.n_a)
                ids = b["doc_id"].slice(done, n)
                done += n
                links = np.bincount(found.keys >> 32, found.times, n).astype(np.int64) if len(found.keys) else np.zeros(n, np.int64)
                rows = [ids.fill_null(0).to_numpy(zero_copy_only=False), found.n_a, found.n_b, found.n_groups, links, found.n_pairs]
                held[0].append(np.array(rows, np.int64))
                held[1].append(ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64))
                held[2].extend(hashlib.sha256(x.encode()).hexdigest() if x else "" for x in found.written())
                held[3].append((found.keys & 0xFFFFFFFF).astype(np.uint32))
                held[4].append(found.times)
                size += len(found.keys)
                if size >= BLOCK or len(held[2]) >= BLOCK >> 5:
                    yield pack(next(names), *held)
                    held, size = ([], [], [], [], []), 0
        if held[2]:
            yield pack(next(names), *held)

    return run


def _pair_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for block, pairs, docs in zip(b["block"].to_pylist(), b["pairs"], b["pair_docs"], strict=True):
            pair, seen = _unplanes(pairs.as_py()).astype(np.int64), _unplanes(docs.as_py()).astype(np.int64)
            for k in range(0, len(pair), 1 << 16):
                cells = [pair[k : k + (1 << 16)], seen[k : k + (1 << 16)]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells[0]), block, np.int64)), *map(pa.array, cells)], ["block", "pair", "docs"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):  # one at a time: a row is a whole block
            docs = np.frombuffer(batch["docs"][k].as_buffer(), "<i8").reshape(len(_DOC) + 1, -1)
            pairs, which = _unplanes(batch["pairs"][k].as_py()).astype(np.int64), _unplanes(batch["which"][k].as_py())
            times, got = np.frombuffer(batch["times"][k].as_buffer(), "<i8"), batch["counts"][k].values
            count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
            if got is not None:
                at = np.searchsorted(pairs, got.field("pair").to_numpy(zero_copy_only=False))
                count[at] = got.field("docs").to_numpy(zero_copy_only=False)
                best[at] = got.field("best").to_numpy(zero_copy_only=False)
            if not count.all():
                raise ValueError("a block's pairs and counts differ in number")
            upto = np.concatenate(([0], np.cumsum(docs[5])))
            sums = []
            for value in (best, count):
                s = np.concatenate(([0], np.cumsum(value[which] * times)))
                sums.append(s[upto[1:]] - s[upto[:-1]])
            ids = pa.array(docs[0], mask=docs[6] == 0)
            cells = [ids, *map(pa.array, (*docs[1:5], *sums)), batch["hashes"][k].values]
            yield pa.RecordBatch.from_arrays(cells, [*_DOC[:5], "n_best", "count_sum", "groups_sha256"])


def _counted(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, pair, docs) of each block, and (pair, docs, best, n) over all of them."""
    lists = blocks.select("block", "pairs", "pair_docs").mapInArrow(_pair_lists, "block long, pair long, docs long")
    counts = materialize(lists.groupBy("pair").agg(F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("n")), compact=True)
    of_a = F.shiftright("pair", 16).alias("a")
    most = counts.groupBy(of_a).agg(F.max("docs").alias("most"))
    return lists, counts.withColumn("a", of_a).join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"), "n")


def _blocks_of(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return bucketed(rows.mapInArrow(_to_blocks(n), _BLOCKS), "block", n)


def count_links(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(a, b, docs, best): in how many rows each pair of ids is linked, and whether no other B id is linked with the A id in more.

    Rows without tokens add nothing; repeated rows count each; an empty table gives no rows.
    """
    _, counts = _counted(_blocks_of(docs, text, doc_id))
    return counts.select(F.shiftright("pair", 16).cast("int").alias("a"), F.col("pair").bitwiseAND(0xFFFF).cast("int").alias("b"), "docs", "best")


def link_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    Texts that are null, empty or not given back byte for byte by both sides have zeros and
    an empty hash. Rows are documents, also where ids repeat or are null; further columns
    go; an empty table gives no rows. ``docs`` is read when this is called: its blocks
    are written to the shared folder.
    """
    blocks = _blocks_of(docs, text, doc_id)
    lists, counts = _counted(blocks)
    back = join_skewed(lists.select("block", "pair"), materialize(counts, compact=True), ["pair"])
    back = back.groupBy("block").agg(F.collect_list(F.struct("pair", "docs", "best")).alias("counts"))  # at most a block's pairs
    both = blocks.join(back, "block", "left").select("docs", "hashes", "which", "times", "pairs", "counts")
    return both.mapInArrow(_digests, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
