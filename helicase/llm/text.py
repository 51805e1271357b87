"""Whole Arrow batches of texts as byte arrays: slices, hashes, words, lines.

All helpers work on UTF-8 bytes, many documents at a time, so that no Python code runs for each word.
A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
#: Bytes of text that one step holds at once; a longer document makes a step of its own.
STEP_BYTES = 1_000_000
#: Bytes up to which a range is hashed together with others.
SHORT = 32

_TABLE = np.random.default_rng(20240607).integers(0, 1 << 64, 256, dtype=U64)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h + U64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _join(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """Hashes of two neighbouring strings to that of both; not linear, so no arrangement of equal parts cancels."""
    h = a >> U64(29)
    h ^= a
    h *= U64((0xD6E8FEB86659FD93 + 2 * level * 0x2545F4914F6CDD1D) % (1 << 64) | 1)
    h += b
    return h


def rolling(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k bytes. They pick places and partitions; nothing is taken to be equal because of them."""
    if len(data) < k:
        return np.empty(0, U64)
    part, width, out, level, done = _TABLE[data], 1, None, 0, 0
    n = len(data) - k + 1
    while True:
        if k & width:
            out = part[:n] if out is None else _join(out, part[done : done + n], 64 + level)
            done += width
        if 2 * width > k:
            return mix(out, k)
        part = _join(part[:-width], part[width:], level)
        width, level = 2 * width, level + 1


def cut(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.LargeBinaryArray:
    """The byte ranges [start, stop) as a binary array."""
    length = stops - starts
    ends = np.concatenate(([0], np.cumsum(length)))
    body = data[ranges(starts, length)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(body)])


def distinct(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The number of each byte range among the different ones, and these; ranges are told apart by their bytes."""
    coded = cut(data, starts, stops).dictionary_encode()
    body, at = column_bytes(coded.dictionary)
    raw, at = body.tobytes(), at.tolist()
    return coded.indices.to_numpy(), [raw[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


def hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each byte range, independent of each other; neither is linear in the bytes.

    Short ranges are mixed eight bytes at a time, all ranges at once; longer ones go through xxHash.
    """
    length = stops - starts
    out = [mix(length.astype(U64), seed + i) for i in (101, 211)]
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    short = np.flatnonzero((length <= SHORT) & (length > 0))
    for j in range(0, SHORT, 8):
        short = short[length[short] > j]
        rest = np.minimum(length[short] - j, 8).astype(U64)
        word = words[starts[short] + j] & (~U64(0) >> (U64(64) - U64(8) * rest))
        for i in range(2):
            out[i][short] = mix(out[i][short] ^ word, 5 * j + i)
    long = np.flatnonzero(length > SHORT)
    if len(long):
        view, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_128_digest
        pair = np.frombuffer(b"".join([digest(view[i:j], seed) for i, j in zip(starts[long].tolist(), stops[long].tolist(), strict=True)]), U64)
        out[0][long], out[1][long] = pair[::2], pair[1::2]
    return out[0], out[1]


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    if column.null_count:
        column = column.fill_null(b"" if kind == pa.large_binary() else "")
    column = column.cast(kind)
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def steps(batches: Iterator[pa.RecordBatch], size: int = STEP_BYTES, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches that hold about `size` bytes of text: (rows, bytes, offsets)."""
    for batch in batches:
        data, at = column_bytes(batch.column(column))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + size, side="right")) - 1)
            yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]
            i = j


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all else as it is."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def is_space(data: np.ndarray) -> np.ndarray:
    """The six bytes of [\\x20\\x09-\\x0D]; in UTF-8 they never occur inside another character."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def runs(mask: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs of True, none of which crosses a row's border."""
    n = len(mask)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.concatenate(([False], mask[:-1]))
    after = np.concatenate((mask[1:], [False]))
    starts = np.flatnonzero(mask & (~before | edge[:-1]))
    stops = np.flatnonzero(mask & (~after | edge[1:])) + 1
    return starts, stops


def row_of(positions: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The row that holds each byte position."""
    return np.searchsorted(at, positions, side="right") - 1


def binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def text_rows(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A string column from bytes and offsets."""
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(s, s + n) for all pairs."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
