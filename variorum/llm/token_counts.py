"""Token counts by byte-pair merging over a heap and a linked list, without token ids.

A word starts as its bytes, a linked list of symbols. A heap holds adjacent pairs that
merge, by rank and then place; the least is popped and merged until none is left. The
count is the number of bytes less the number of merges. Words repeat, so each task
counts a word once as long as it remembers it (``KNOWN`` words, then it starts afresh:
results don't depend on that). No row moves: there is no shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
KNOWN, LETTERS = 400_000, 40  # words a worker remembers, and how long they may be
LONG = 1 << 20  # characters from which on a text's words are taken one by one

#: characters on which Python's re and the library's patterns could differ (numbers that aren't digits, separators), or
#: beyond U+024F, where composing and lower case follow further rules; texts that hold one are split by the library
_ODD = re.compile("[\x1c-\x1f\x85\xa0\xb2\xb3\xb9\xbc-\xbeɐ-\U0010ffff]")
#: fixed values: the split in the file, and the same words by Python's re in lower-case texts without an odd character
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_FAST = re.compile(r"'(?:[stmd]|re|ve|ll)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


@cache
def _byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else the next free one from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b if b in prints else next(free)) for b in range(256)]


def merges_of(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> int:
    """How many merges the symbols take: always the adjacent pair of least rank, of equal ones the first.

    ``pairs`` gives rank and merged symbol by pair.
    """
    n = len(symbols)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(*pairs[p], i, p) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in pairs]
    heapify(heap)
    now: list[int] = list(symbols)  # -1: merged into its left neighbour
    done = 0
    while heap:
        _, merged, i, (a, b) = heappop(heap)
        j = right[i]
        if now[i] != a or j == n or now[j] != b:
            continue  # one of the two has changed since
        now[i], now[j] = merged, -1
        done += 1
        right[i] = k = right[j]
        if k < n:
            left[k] = i
            if (got := pairs.get(p := (merged, now[k]))) is not None:
                heappush(heap, (*got, i, p))
        if (h := left[i]) >= 0 and (got := pairs.get(p := (now[h], merged))) is not None:
            heappush(heap, (*got, h, p))
    return done


class Counter:
    """Counts as the vocabulary file gives them: its normaliser, split, special tokens and merges."""

    def __init__(self, name: str):
        path = public_tokenizers.path(name)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, vocab = file["model"], file["model"]["vocab"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError(f"{name} is not a byte-level BPE vocabulary")
        suffix = model.get("end_of_word_suffix") or ""
        letters = _byte_letters()
        self._first, self._last = [vocab[c] for c in letters], [vocab[c + suffix] for c in letters]
        self._bytes = {c: b for b, c in enumerate(letters)}
        self._pairs = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self._pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
        library = Tokenizer.from_file(path)
        self._normal, self._split = library.normalizer, library.pre_tokenizer
        special = [t["content"] for t in file["added_tokens"]]
        self._special = re.compile("|".join(map(re.escape, special))) if special else None
        steps = (file["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self._fast = steps[0].get("pattern") == {"Regex": _SPLIT} and file["normalizer"] is not None and [x["type"] for x in file["normalizer"].get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self._known: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Tokens of one word of the split."""
        n = self._known.get(word)
        if n is None:
            b = word.encode()
            n = len(b) - merges_of([*(self._first[x] for x in b[:-1]), self._last[b[-1]]], self._pairs)
            if len(word) <= LETTERS:
                if len(self._known) >= KNOWN:
                    self._known.clear()
                self._known[word] = n
        return n

    def _words(self, text: str) -> Iterator[str]:
        if self._fast and not _ODD.search(text):
            low = text.lower()
            return iter(_FAST.findall(low)) if len(low) < LONG else (m[0] for m in _FAST.finditer(low))
        whole = self._normal.normalize_str(text) if self._normal else text
        return (bytes(map(self._bytes.__getitem__, piece)).decode() for piece, _ in self._split.pre_tokenize_str(whole))

    def text(self, text: str) -> int:
        """Tokens of a text; special strings in it are one token each, as the library's default has it."""
        parts = self._special.split(text) if self._special else [text]
        return len(parts) - 1 + sum(sum(map(self.word, self._words(part))) for part in parts if part)


@cache
def counter(name: str) -> Counter:
    return Counter(name)


def count_tokens(df: DataFrame, text: str = "text", into: str = "n_tokens", name: str = VOCABULARY) -> DataFrame:
    """``df`` with ``into`` (long), the number of tokens of ``text`` by the vocabulary file ``name``.

    Null and empty texts have none; texts of any length count whole; repeated rows
    stay repeated; a column named ``into`` is replaced; an empty table gives no rows.
    """
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() != into.lower()])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(name).text
        for b in batches:
            # one text at a time: a batch may hold very long ones
            n = [tokens(t) if (t := x.as_py()) else 0 for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], [*b.schema.names, into])

    return df.mapInArrow(run, df.withColumn(into, F.lit(0).cast("long")).schema)


def token_counts_of_documents(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and whether these are more than ``limit``; null texts have neither, an empty table gives no rows."""
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return count_tokens(rows).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
