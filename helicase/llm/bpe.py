"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each pre-token is a linked list of its bytes. A bucket for each merge rank holds the positions of pairs with that
rank, leftmost first, and three levels of 64-bit words mark the buckets that aren't empty: finding the next rank is three
find-first-set steps, whatever the pre-token's length. Within a bucket positions are a
heap, so that the leftmost comes first. Entries whose pair has changed since are skipped as stale, so a merge costs a step in the
logarithm of its bucket's length, and very long pre-tokens take time about in proportion to their length.

Distinct pre-tokens are encoded once and remembered in a bounded table of each worker.

Edge cases: a null or empty text has no ids and decodes to the empty string; special tokens' strings are ordinary
text; an empty table gives an empty result; repeated rows are encoded alike; doc_id is carried as it is, null too; texts of any
length are encoded whole, in a step of their own; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import text
from .pretokens import Encoded


class RankQueue:
    """Positions in buckets of merge ranks; pop() gives the lowest rank's leftmost position."""

    def __init__(self, ranks: int):
        self._low, self._mid, self._top = [0] * (ranks // 64 + 1), [0] * (ranks // 4096 + 1), 0
        self._buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self._buckets.get(rank)
        if bucket is None:
            self._buckets[rank] = [position]
            self._low[rank >> 6] |= 1 << (rank & 63)
            self._mid[rank >> 12] |= 1 << (rank >> 6 & 63)
            self._top |= 1 << (rank >> 12)
        else:
            heappush(bucket, position)

    def pop(self) -> tuple[int, int] | None:
        top = self._top
        if not top:
            return None
        a = (top & -top).bit_length() - 1
        word = self._mid[a]
        b = a << 6 | (word & -word).bit_length() - 1
        word = self._low[b]
        rank = b << 6 | (word & -word).bit_length() - 1
        bucket = self._buckets[rank]
        position = heappop(bucket)
        if not bucket:
            del self._buckets[rank]
            self._low[b] &= ~(1 << (rank & 63))
            if not self._low[b]:
                self._mid[a] &= ~(1 << (b & 63))
                if not self._mid[a]:
                    self._top &= ~(1 << a)
        return rank, position


class Bpe:
    """Encodes single pre-tokens by ranks of byte strings; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self._queue = RankQueue(max(ranks.values()) + 1)
        self._longest = max(map(len, ranks))
        tokens = sorted((i, b) for b, i in ranks.items())
        size = np.zeros(tokens[-1][0] + 1, np.int64)
        size[[i for i, _ in tokens]] = [len(b) for _, b in tokens]
        self._size, self._first = size, np.cumsum(size) - size
        self._bytes = np.frombuffer(b"".join(b for _, b in tokens), np.uint8)

    def encode(self, word: bytes) -> list[int]:
        rank = self.ranks.get
        whole = rank(word)
        if whole is not None:
            return [whole]
        n = len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair: list[int | None] = [rank(word[i : i + 2]) for i in range(n - 1)]
        pair.append(None)
        queue, longest = self._queue, self._longest
        for i in range(n - 1):
            if pair[i] is not None:
                queue.push(pair[i], i)
        while (entry := queue.pop()) is not None:
            r, i = entry
            if pair[i] != r:
                continue  # stale
            j = after[i]
            k = after[j]
            after[i] = k
            pair[j] = None
            if k < n:
                before[k] = i
                new = rank(word[i : after[k]]) if after[k] - i <= longest else None
                pair[i] = new
                if new is not None:
                    queue.push(new, i)
            else:
                pair[i] = None
            p = before[i]
            if p >= 0:
                new = rank(word[p:k]) if k - p <= longest else None
                pair[p] = new
                if new is not None:
                    queue.push(new, p)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : after[i]]])
            i = after[i]
        return out

    def encode_all(self, words: list[bytes]) -> list[list[int]]:
        return [self.encode(w) for w in words]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows and their offsets."""
        size = self._size[ids]
        ends = np.concatenate(([0], np.cumsum(size)))
        return self._bytes[text.ranges(self._first[ids], size)], ends[np.concatenate(([0], np.cumsum(counts)))]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@functools.cache
def coder(path: str) -> tuple[Bpe, Encoded]:
    bpe = Bpe(read_ranks(path))
    return bpe, Encoded(bpe.encode_all)


def _cut(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column from bytes and offsets."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def encode(docs: DataFrame, path: str, decode: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers; with decode also `decoded`, the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, table = coder(path)
        for batch, data, at in text.steps(batches, text.STEP_BYTES // 2):
            ids, counts = table.encode(data, at)
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(counts), _cut(ids.astype("<u4").view(np.uint8), 4 * np.concatenate(([0], np.cumsum(counts))))]
            if decode:
                columns.append(_cut(*bpe.decode(ids, counts)))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"][: len(columns)])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary" + ", decoded binary" * decode)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, decoded) from the ids of encode()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = coder(path)
        for batch, data, at in text.steps(batches, text.STEP_BYTES, "ids"):
            ids = np.frombuffer(data.tobytes(), "<u4")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _cut(*bpe.decode(ids, np.diff(at) // 4))], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")
