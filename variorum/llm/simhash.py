"""SimHash near-duplicates by tiled exact comparison.

1. Fingerprint (Arrow batches): XXH64 of every word shingle, majority per bit.
2. Rows of equal fingerprint become one node (partial aggregate), so copies are
   never paired.
3. Nodes go to tiles by the population counts of their four 16-bit words. Two
   fingerprints within ``radius`` bits have population counts whose differences
   add up to at most ``radius``, so all other tile pairs are skipped. Large tiles
   are cut in chunks of a bounded number of nodes by hash.
4. Each pair of chunks is compared whole with numpy exclusive-or and bit counts,
   and gives a spanning forest of its links rather than the links.
5. Connected components over the forests; ids join back by fingerprint.

:func:`similar_documents` links texts by the Jaccard similarity of their shingle sets, exactly.
Which pairs to look at:

1. Equal texts become one node. Distinct texts are packed in blocks; each block sends
   its distinct shingles once, and gets back those that occur in other texts too.
2. A text's shingles, rarest first: two texts of similarity s share one of each's first
   n - ceil(s n) + 1 (prefix filter). Texts whose first ones are all their own, by
   far most, have no partner and go no further.
3. Texts that share such a shingle form groups (a star for each shingle, not its pairs).
   Groups are dealt to chunks of a bounded number of shingles, large groups to several.
4. Inside a group, pairs of chunks are compared by fingerprints of 256 bits with
   exclusive-or and bit counts; population counts skip rows that are too far apart. What lies
   within a wide radius is counted exactly, all shared shingles of a tile at once.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucketed, connected_components, join_skewed, materialize, unlike

SEED = 42
WORDS = 4  # equal words of a fingerprint whose population counts name a tile
CHUNK = 4096  # nodes of a tile that one comparison holds at most, on average
BLOCK, COLS = 16, 4096  # of a comparison at once: what it holds stays in a core's cache
SIMILAR, SHINGLE = 0.8, 5  # of similar documents: Jaccard similarity, words of a shingle
PARTS = 4  # longs of a wide fingerprint
SLACK = 52  # bits beyond the mean at which pairs are still counted exactly: over six standard deviations
TEXTS = 1 << 22  # bytes of the texts of a block, but for the text that crosses them
BITS = 48  # of a shingle's hash by which it is counted
SHINGLES, EACH = 1 << 19, 512  # of a chunk on average, where each text counts for so many more
COLUMNS, ROWS, PAIRS = 4096, 1024, 1 << 19  # shingles, texts and pairs of texts counted at once


def _hashes(text: str, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles, repeats included, in parts of bounded size; fewer words are one shingle, none give nothing."""
    import xxhash

    # bytes.lower and bytes.split know A-Z and \x20 \x09-\x0D only, as wanted
    joined = b" ".join(text.encode().lower().split())
    if not joined:
        return
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(joined)]))
    n = max(1, len(starts) - shingle + 1)
    ends = ends[shingle - 1 :] if len(ends) >= shingle else ends[-1:]
    h = xxhash.xxh64_intdigest
    at, to = starts[:n].tolist(), ends.tolist()
    for k in range(0, n, 65536):
        yield np.fromiter((h(joined[a:b], SEED) for a, b in zip(at[k : k + 65536], to[k : k + 65536], strict=True)), np.uint64)


def _ones(h: np.ndarray) -> np.ndarray:
    """How many of the numbers have each of the 64 bits."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    # sums of up to 255 rows fit a byte, and bytes are added many at a time
    return sum((bits[k : k + 255].sum(0, dtype=np.uint8).astype(np.int64) for k in range(0, len(bits), 255)), np.zeros(64, np.int64))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash over word shingles (repeats included); no words give 0."""
    ones, n = np.zeros(64, np.int64), 0
    for h in _hashes(text or "", shingle):
        ones += _ones(h)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]) if n else 0


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th of several hashes made of one (SplitMix64); the first is itself."""
    if not k:
        return h
    h = h + np.uint64(0x9E3779B97F4A7C15 * k % 2**64)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """SimHash of ``PARTS`` times 64 bits of a set of shingle hashes."""
    ones = np.stack([_ones(_mixed(shingles, k)) for k in range(PARTS)])
    return np.packbits(2 * ones > len(shingles), axis=1, bitorder="little").view(np.uint64).ravel()


def radius_of(similarity: float) -> int:
    """Bits of a wide fingerprint in which texts of that Jaccard similarity differ on average."""
    cosine = 2 * similarity / (1 + similarity)
    return int(64 * PARTS * np.arccos(min(1.0, cosine)) / np.pi)


def _fingerprints(shingle: int, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(at)), np.uint64, b.num_rows)
            keep = [c for i, c in enumerate(b.columns) if i != at]
            names = [n for i, n in enumerate(b.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(fp.view(np.int64))], [*names, "fp"])

    return run


def fingerprints(df: DataFrame, row_id: str, text: str, shingle: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """``id`` (long), columns of ``carry``, ``fp`` (long): fp holds the 64 bits, null or wordless text gives 0."""
    from .language import _schema

    rows = df.select(F.col(row_id).cast("long").alias("id"), F.col(text).alias("_text"), *carry)
    return rows.mapInArrow(_fingerprints(shingle, 1), _schema(rows.drop("_text"), "fp long"))


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Of links between 0 to n-1, given in parts: every linked node but the roots, and its root."""
    root = np.arange(n)
    for i, j in links:
        while True:
            a, b = root[i], root[j]
            open_ = a != b
            if not open_.any():
                break
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
    node = np.flatnonzero(root != np.arange(n))
    return node, root[node]


def _close(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of fingerprints (a column for each 64 bits) within the radius; the right ones are counted on after the left ones unless they are the same."""
    parts = left.shape[1]
    left, right = np.ascontiguousarray(left.T), np.ascontiguousarray(right.T)
    shift, held, size = 0 if same else left.shape[1], [], 0
    for a in range(0, left.shape[1], BLOCK):
        for b in range(a // COLS * COLS if same else 0, right.shape[1], COLS):
            x, y = slice(a, a + BLOCK), slice(b, b + COLS)
            far = np.bitwise_count(left[0, x, None] ^ right[0, y])
            if parts > 1:  # half of the bits decide nearly all pairs
                far += np.bitwise_count(left[1, x, None] ^ right[1, y])
            near = far <= radius
            if not near.any():
                continue
            i, j = np.nonzero(near)
            if same:
                up = i + a < j + b
                i, j = i[up], j[up]
            if parts > 2 and len(i):
                more = np.bitwise_count(left[2:, i + a] ^ right[2:, j + b]).sum(0, dtype=np.int64) + far[i, j]
                i, j = i[more <= radius], j[more <= radius]
            held.append((i + a, j + b + shift))
            size += len(i)
            if size >= COLS:  # links are worked off some thousands at a time
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
    if size:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _fps(cell: pa.Scalar) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), np.int64).view(np.uint64).reshape(-1, 1)


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                same = batch["same"][r].as_py()
                left, names = _fps(batch["x_fps"][r]), np.frombuffer(batch["x_nodes"][r].as_buffer(), np.int64)
                right = left if same else _fps(batch["y_fps"][r])
                names = names if same else np.concatenate((names, np.frombuffer(batch["y_nodes"][r].as_buffer(), np.int64)))
                node, root = forest(len(names), _close(left, right, radius, same))
                yield pa.RecordBatch.from_arrays([pa.array(names[node]), pa.array(names[root])], ["a", "b"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """array<struct<node, fp>> to bytes, so that a chunk stays two buffers from here on."""
    for b in batches:
        for k in range(b.num_rows):
            rows = b["rows"][k].values
            cells = [pa.array([np.asarray(rows.field(c).to_numpy(), np.int64).tobytes()], pa.binary()) for c in ("node", "fp")]
            yield pa.RecordBatch.from_arrays([b["tile"].slice(k, 1), b["chunk"].slice(k, 1), *cells], ["tile", "chunk", "nodes", "fps"])


def _steps(radius: int) -> list[int]:
    """Tile differences (packed in base 512) that a radius allows, one of each two opposite ones."""
    out = []
    for d in itertools.product(range(-radius, radius + 1), repeat=WORDS):
        if sum(map(abs, d)) <= radius and d >= (0,) * WORDS:
            out.append(sum(x * 512**i for i, x in enumerate(reversed(d))))
    return out


def chunks_of(nodes: DataFrame) -> DataFrame:
    """``node, fp`` to ``tile, chunk, nodes, fps``: packed chunks of the tiles, which are named by the population counts of ``WORDS`` equal parts, written."""
    width = 64 // WORDS
    tile = sum((F.bit_count(F.shiftrightunsigned("fp", width * i).bitwiseAND(2**width - 1)) * F.lit(512**i).cast("long") for i in range(WORDS)), F.lit(0))
    tiled = nodes.withColumn("tile", tile.cast("long"))
    # at most 17 ** 4 tiles: safe to broadcast whatever the input
    sizes = tiled.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    chunks = tiled.join(F.broadcast(sizes), "tile").groupBy("tile", chunk.alias("chunk")).agg(F.collect_list(F.struct("node", "fp")).alias("rows"))
    return materialize(chunks.mapInArrow(_pack, "tile long, chunk int, nodes binary, fps binary"))


def pairs_of(chunks: DataFrame, radius: int) -> DataFrame:
    """``xt, xc, yt, yc``: tile and chunk of both sides of every pair that a link may join."""
    keys = chunks.select("tile", "chunk")
    near = F.explode(F.array(*[F.lit(s).cast("long") for s in _steps(radius)])).alias("step")
    x = keys.select(F.col("tile").alias("xt"), F.col("chunk").alias("xc"), near).withColumn("yt", F.col("xt") + F.col("step"))
    y = keys.select(F.col("tile").alias("yt"), F.col("chunk").alias("yc"))
    return x.join(y, "yt").where("xt <> yt or xc <= yc").select("xt", "xc", "yt", "yc")


def with_chunks(pairs: DataFrame, chunks: DataFrame, *cells: str) -> DataFrame:
    """Pairs with the chunks' ``cells`` (those of the left as ``x_``, of the right as ``y_``; null there if it is the same), dealt by pair.

    Each side goes to its pair by itself, so a chunk moves once for each pair that it is in.
    """
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["xt", "xc", "yt", "yc"]

    def side(of: DataFrame, name: str) -> DataFrame:
        own = chunks.select(F.col("tile").alias(f"{name}t"), F.col("chunk").alias(f"{name}c"), *[F.col(c).alias(f"{name}_{c}") for c in cells])
        return of.join(own, [f"{name}t", f"{name}c"]).select(*key, *[f"{name}_{c}" for c in cells]).repartition(n, *key)

    other = F.expr("xt <> yt or xc <> yc")
    return side(pairs, "x").join(side(pairs.where(other), "y"), key, "left").withColumn("same", ~other)


def links_between(nodes: DataFrame, radius: int) -> DataFrame:
    """Distinct fingerprints ``fp`` (long) to ``(a, b)``: forests of all links at ``radius`` or fewer bits."""
    chunks = chunks_of(nodes.select(F.col("fp").alias("node"), "fp"))
    both = with_chunks(pairs_of(chunks, radius), chunks, "fps", "nodes")
    return both.select("x_fps", "y_fps", "x_nodes", "y_nodes", "same").mapInArrow(_compare(radius), "a long, b long")


def _named(rows: DataFrame, nodes: DataFrame, key: list[str], node: str, edges: DataFrame) -> DataFrame:
    """``rows`` plus ``component_id``; ``nodes`` hold ``key``, ``node``, ``least`` id and ``n`` rows of each node."""
    comp = connected_components(edges).withColumnRenamed("node", node)
    found = nodes.join(comp, node, "left").withColumn("root", F.coalesce("root", node))
    least = found.groupBy("root").agg(F.min("least").alias("component_id"))
    return join_skewed(rows, materialize(found.join(least, "root").select(*key, "component_id", "n")), key)


def near_duplicates(
    df: DataFrame, row_id: str = "doc_id", text: str = "text", radius: int = 2, shingle: int = 3, carry: tuple[str, ...] = ()
) -> DataFrame:
    """``id``, columns of ``carry``, ``fp, component_id`` of every row: component_id is the least id reachable over links.

    Rows link at ``radius`` or fewer differing bits, wordless and null texts
    (fingerprint 0) like any other. Null ids keep their rows and take the
    component of their fingerprint; repeated rows come back repeated; an empty
    table gives no rows. Other columns of ``df`` are not read.
    """
    rows = materialize(fingerprints(df, row_id, text, shingle, carry), compact=True)
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    edges = links_between(nodes.select("fp"), radius)
    return _named(rows, nodes.withColumn("node", F.col("fp")), ["fp"], "node", edges).select("id", *carry, "fp", "component_id")


def shingle_set(text: str, words: int) -> np.ndarray:
    """Hashes of the text's distinct shingles, in order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *_hashes(text, words)]))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """128 bits of each text's words (A-Z lower-cased) instead of the text."""
    import xxhash

    for b in batches:
        keys = [xxhash.xxh128_digest(b" ".join((t.as_py() or "").encode().lower().split())) for t in b["text"]]
        k = np.frombuffer(b"".join(keys), ">i8").reshape(-1, 2).astype(np.int64)
        keep = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), *(pa.array(np.ascontiguousarray(x)) for x in k.T)], [*keep, *_KEY])


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with a word: their key, and the words compressed."""
    import xxhash
    import zstandard

    for b in batches:
        keys, texts = [], []
        for t in b["text"]:
            joined = b" ".join((t.as_py() or "").encode().lower().split())
            if joined:
                keys.append(xxhash.xxh128_digest(joined))
                texts.append(zstandard.compress(joined, 1))
        k = np.frombuffer(b"".join(keys), ">i8").reshape(-1, 2).astype(np.int64)
        yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x)) for x in k.T), pa.array(texts, pa.binary())], [*_KEY, "words"])


def _to_blocks(parts_out: int):
    """Texts of a task as blocks: nodes, and compressed words as a list."""
    import zstandard

    from .bpe import block_names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names = block_names(TaskContext.get().partitionId(), parts_out)
        nodes, texts, size = [], [], 0

        def pack() -> pa.RecordBatch:
            cells = [[next(names)], [nodes], [texts]]
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types, strict=True)], ["block", "nodes", "texts"])

        for b in batches:
            for node, t in zip(b["node"].to_pylist(), b["words"], strict=True):
                nodes.append(node)
                texts.append(t.as_py())
                size += zstandard.frame_content_size(texts[-1])
                if size >= TEXTS:
                    yield pack()
                    nodes, texts, size = [], [], 0
        if nodes:
            yield pack()

    return run


def _sets(texts: pa.ListScalar, words: int) -> Iterator[np.ndarray]:
    import zstandard

    return (shingle_set(zstandard.decompress(t.as_py()).decode(), words) for t in texts.values)


def _short(shingles: np.ndarray) -> np.ndarray:
    """The ``BITS`` by which shingles are counted over all texts: fewer travel, and two that share them only count as more frequent."""
    return shingles >> np.uint64(64 - BITS)


def _block_shingles(words: int):
    """(block, shingle, n): each distinct shingle of a block by its ``BITS``, and in how many of its texts it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, texts in zip(b["block"].to_pylist(), b["texts"], strict=True):
                shingle, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *map(_short, _sets(texts, words))]), return_counts=True)
                for k in range(0, len(n), 1 << 16):
                    s = slice(k, k + (1 << 16))
                    cells = [pa.array(np.full(len(n[s]), block)), pa.array(shingle[s].view(np.int64)), pa.array(n[s].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(cells, ["block", "shingle", "n"])

    return run


def prefix_length(n: np.ndarray, share: Fraction) -> np.ndarray:
    """So many of a set's ``n`` members, first in any order common to all sets, meet those of every set as similar as ``share``."""
    return n - -(-n * share.numerator // share.denominator) + 1


def _candidates(words: int, share: Fraction):
    """Of each block, with ``known`` (shingles of several texts and in how many they are): texts that may have a partner, their sets and first shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                known = b["known"][k].values
                shared = known.field("shingle").to_numpy(zero_copy_only=False).view(np.uint64)
                count = known.field("count").to_numpy(zero_copy_only=False)
                order = np.argsort(shared)
                shared, count = shared[order], count[order]
                out = []
                for node, own in zip(b["nodes"][k].as_py(), _sets(b["texts"][k], words), strict=True):
                    at = np.minimum(np.searchsorted(shared, _short(own)), len(shared) - 1)
                    held = np.flatnonzero(shared[at] == _short(own))
                    most = int(prefix_length(len(own), share)) - (len(own) - len(held))  # those that no other text has come first
                    if most > 0:
                        first = own[held[np.lexsort((own[held], count[at[held]]))[:most]]]
                        out.append((node, len(own), wide_fingerprint(own).tobytes(), own.tobytes(), first.view(np.int64)))
                cells = zip((pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())), zip(*out, strict=True) if out else [[]] * 5, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for t, c in cells], ["node", "size", "fp", "shingles", "first"])

    return run


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many members each set of the left shares with each of the right, by a product of incidence matrices."""
    sets = [*left, *right]
    row = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = n > 1
    column, row = (np.cumsum(often) - 1)[column][often[column]], row[often[column]]
    out = np.zeros((len(left), len(right)), np.float32)  # exact up to 2 ** 24 shared members
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    for k in range(0, int(often.sum()), COLUMNS):
        a, b = np.searchsorted(column, [k, k + COLUMNS])
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[row[a:b], column[a:b] - k] = 1
        out += held[: len(left)] @ held[len(left) :].T
    return out


def _gathered(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs, ``PAIRS`` or more at a time."""
    held, size = [], 0
    for ij in pairs:
        held.append(ij)
        size += len(ij[0])
        if size >= PAIRS:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _alike(left: tuple, right: tuple, radius: int, share: Fraction, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of similarity ``share`` or more; a side is its fingerprints and sets. Right rows are counted on after the left ones unless they are the same."""
    shift = 0 if same else len(left[1])
    for i, j in _gathered(_close(left[0], right[0], radius, same)):
        j = j - shift
        size = [np.array([len(s[k]) for k in at], np.int64) for s, at in ((left[1], i), (right[1], j))]
        if len(i) < 64:
            shared = np.array([len(np.intersect1d(left[1][a], right[1][b], assume_unique=True)) for a, b in zip(i, j, strict=True)])
        else:
            (x, at_x), (y, at_y) = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
            shared = np.concatenate([_overlaps([left[1][a] for a in x[k : k + ROWS]], [right[1][b] for b in y]) for k in range(0, len(x), ROWS)])[at_x, at_y].astype(np.int64)
        good = shared * (share.numerator + share.denominator) >= share.numerator * (size[0] + size[1])
        yield i[good], j[good] + shift


def _check(radius: int, share: Fraction):
    """Forests of the links between two chunks (or inside one), of texts of the same group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                same = batch["same"][r].as_py()
                sides = []
                for name in "x" if same else "xy":
                    v = batch[f"{name}_rows"][r].values
                    group, node = (v.field(c).to_numpy(zero_copy_only=False) for c in ("root", "node"))
                    sides.append((group, node, v.field("fp"), v.field("shingles")))
                links = [np.zeros((2, 0), np.int64)]
                groups = np.unique(sides[0][0]) if same else np.intersect1d(sides[0][0], sides[1][0])
                for g in groups.tolist():
                    rows = [(np.flatnonzero(s[0] == g), s) for s in sides]
                    packed = [(_fps_of(s[2], at), [np.frombuffer(s[3][k].as_buffer(), np.uint64) for k in at.tolist()]) for at, s in rows]
                    names = np.concatenate([s[1][at] for at, s in rows])
                    links.append(names[np.stack(forest(len(names), _alike(packed[0], packed[-1], radius, share, same)))])
                a, b = np.concatenate(links, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _fps_of(cells: pa.Array, at: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(cells.take(pa.array(at)).to_pylist()), np.uint64).reshape(-1, PARTS)


def groups_of(first: DataFrame) -> DataFrame:
    """(node, shingle) to (node, root): nodes that share a shingle, also over others, have one root. Nodes that share none are left out."""
    keyed = materialize(first.groupBy("shingle").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"), compact=True)
    stars = join_skewed(first, keyed, ["shingle"])
    return connected_components(stars.select(F.col("node").alias("a"), F.col("least").alias("b")))


def links_of_similar(nodes: DataFrame, similarity: float, words: int) -> DataFrame:
    """``node`` (long) and compressed ``words`` of distinct texts to ``(a, b)``: forests of all links of ``similarity`` or more."""
    share = Fraction(similarity).limit_denominator(1000)
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = bucketed(nodes.mapInArrow(_to_blocks(n), "block long, nodes array<long>, texts array<binary>"), "block", n)
    # each shingle of a block once, however many texts hold it
    listed = blocks.select("block", "texts").mapInArrow(_block_shingles(words), "block long, shingle long, n int")
    listed = listed.withColumn("count", F.sum("n").over(Window.partitionBy("shingle"))).where("count > 1")
    listed = listed.groupBy("block").agg(F.collect_list(F.struct("shingle", "count")).alias("known"))
    rows = blocks.join(listed, "block").select("nodes", "texts", "known").mapInArrow(
        _candidates(words, share), "node long, size long, fp binary, shingles binary, first array<long>"
    )
    rows = materialize(rows, compact=True)
    groups = materialize(groups_of(rows.select("node", F.explode("first").alias("shingle"))).join(rows.select("node", "size"), "node"), compact=True)
    # chunks by shingles: groups that fill one have chunks of their own, the others share
    sizes = groups.groupBy("root").agg(F.sum(F.col("size") + EACH).alias("weight"), F.count(F.lit(1)).alias("n"))
    total = sizes.where(F.col("weight") <= SHINGLES).agg(F.sum("weight")).first()[0] or 0
    own = F.col("weight") > SHINGLES
    tile = F.when(own, F.col("root")).otherwise(-1 - F.pmod(F.xxhash64("root"), F.lit(-(-total // SHINGLES) or 1)))
    sizes = sizes.select("root", "n", tile.alias("tile"), F.when(own, F.ceil(F.col("weight") / SHINGLES)).otherwise(1).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    places = join_skewed(groups.drop("size"), materialize(sizes, compact=True), ["root"]).select("root", "node", "tile", chunk.alias("chunk"))
    chunks = rows.join(places, "node").groupBy("tile", "chunk").agg(F.collect_list(F.struct("root", "node", "fp", "shingles")).alias("rows"))
    chunks = materialize(chunks)
    check = _check(radius_of(similarity) + SLACK, share)
    inside = chunks.select(F.col("rows").alias("x_rows"), F.lit(True).alias("same")).mapInArrow(check, "a long, b long")
    keys = chunks.where("tile >= 0").select("tile", "chunk")
    pairs = keys.toDF("xt", "xc").join(keys.toDF("yt", "yc"), F.expr("xt = yt and xc < yc"))
    return inside.union(with_chunks(pairs, chunks, "rows").select("x_rows", "y_rows", "same").mapInArrow(check, "a long, b long"))


_KEY = ["k0", "k1"]


def similar_documents(
    df: DataFrame, row_id: str = "doc_id", text: str = "text", similarity: float = SIMILAR, words: int = SHINGLE, carry: tuple[str, ...] = ()
) -> DataFrame:
    """``id``, columns of ``carry``, ``component_id`` of every row: the least id reachable over links.

    Two texts link if the Jaccard similarity of their sets of shingles of ``words`` words (A-Z
    lower-cased; a text of fewer words is one shingle) is ``similarity`` or more, and only
    then; a pair whose fingerprints differ in ``SLACK`` bits more than the mean of that
    similarity is taken to lie below it. Equal texts (but for the case of A-Z and white
    space) always link. Wordless and null texts are equal texts. Null ids keep their rows
    and take the component of their text; repeated rows come back repeated; an empty
    table gives no rows.
    """
    from .language import _schema

    names = [f"c{i}" for i in range(len(carry))]
    picked = df.select(F.col(row_id).cast("long").alias("id"), *[F.col(c).alias(n) for c, n in zip((text, *carry), ("text", *names), strict=True)])
    rows = materialize(picked.mapInArrow(_keys, _schema(picked.drop("text"), "k0 long, k1 long")), compact=True)
    nodes = rows.groupBy(*_KEY).agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()))
    texts = picked.select("text").mapInArrow(_compressed, "k0 long, k1 long, words binary").dropDuplicates(_KEY)
    texts = texts.join(nodes.select(*_KEY, "node"), _KEY).select("node", "words")
    out = _named(rows, nodes, _KEY, "node", links_of_similar(texts, similarity, words))
    return out.select("id", *[F.col(n).alias(c) for n, c in zip(names, carry, strict=True)], "component_id")


def drop_near_duplicates(df: DataFrame, row_id: str = "doc_id", text: str = "text", similarity: float = SIMILAR, words: int = SHINGLE) -> DataFrame:
    """``df`` with one row of each component of :func:`similar_documents`: the one of least id, and of least row hash among rows of that id.

    A component whose rows all lack an id keeps its row of least hash. Rows equal
    in every column are one row; null, empty and wordless texts are copies of one
    another; an empty table gives no rows; all columns stay, whatever their names.
    """
    row = unlike(df, "_row")
    hashed = df.withColumn(row, F.xxhash64(*df.columns))
    found = similar_documents(hashed, row_id, text, similarity, words, (row,)).toDF("id", "row", "component_id")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    keep = found.groupBy("component_id").agg(first).select(F.col("first.id").alias("kept_id"), F.col("first.row").alias("kept_row"))
    keep = materialize(keep)
    again = found.groupBy("id", "row").count().where("count > 1").limit(1).count()
    keep = keep.toDF(unlike(df, "_kept_id"), unlike(df, "_kept_row"))
    kept = hashed.join(keep, F.col(row_id).cast("long").eqNullSafe(keep[0]) & (F.col(row) == keep[1]), "left_semi")
    if again:
        kept = kept.dropDuplicates([row, row_id])
    return kept.select(*df.columns)


def dedup_documents(docs: DataFrame) -> DataFrame:
    """Digest for ``documents``: doc_id, fingerprint (16 hex digits), component_id."""
    out = near_duplicates(docs)
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
