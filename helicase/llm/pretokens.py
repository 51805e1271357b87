"""Pre-tokens of whole batches of texts, and a table of the distinct ones already encoded.

The pattern ('s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+) cuts a text where the class
of its characters (letter, number, white space, other) changes, with three exceptions: a space joins the run after it,
a longer run of white space gives its last character away, and an apostrophe takes the letters of a contraction.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np

from . import text

_LETTER, _NUMBER, _SPACE = 1, 2, 3
#: Distinct pre-tokens that a worker remembers; then it starts afresh.
MEMO = 1_000_000


@functools.cache
def _classes() -> np.ndarray:
    """The class of every code point, asked from the regex library by class."""
    import regex

    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = m.span()
            shift = lambda i: i if i < 0xD800 else i + 0x800
            out[shift(a) : shift(b - 1) + 1] = kind
    out[0xD800:0xE000] = 0
    return out


def split(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where pre-tokens start and stop, row after row."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(lead)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = _classes()[code]
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(lead, at)] = True
    change = first[:-1].copy()
    change[1:] |= kind[1:] != kind[:-1]
    start = change.copy()
    begins = np.flatnonzero(change)
    ends = np.append(begins[1:], n)
    blank = np.flatnonzero(kind[begins] == _SPACE)
    stop = ends[blank]
    stop = stop[~first[stop]]
    start[stop - 1] = True
    start[stop[code[stop - 1] == 32]] = False
    quote = np.flatnonzero((code[begins] == 39) & (ends - begins == 1) & start[begins])
    quote = quote[quote + 1 < len(begins)]
    quote = quote[(kind[begins[quote + 1]] == _LETTER) & ~first[begins[quote + 1]]]
    if len(quote):
        a, limit = begins[quote + 1], ends[quote + 1]
        one, two = code[a], np.where(a + 1 < limit, code[np.minimum(a + 1, n - 1)], 0)
        taken = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        for pair in ("re", "ve", "ll"):
            taken = np.where((one == ord(pair[0])) & (two == ord(pair[1])), 2, taken)
        a, limit, taken = a[taken > 0], limit[taken > 0], taken[taken > 0]
        start[a] = False
        after = a + taken
        start[after[after < limit]] = True
    starts = lead[start]
    return starts, np.append(starts[1:], len(data))


class Encoded:
    """Ids of distinct pre-tokens: an open-addressing table over flat arrays.

    A pre-token's place comes from one hash of 64 bits and each entry keeps a second, independent one. A pre-token that
    agrees with an entry in the first alone is encoded by itself.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], bits: int = 21):
        self._encode, self._bits = encode, bits
        self._clear()

    def _clear(self) -> None:
        self._keys = np.zeros(1 << self._bits, np.uint64)
        self._slots = np.zeros(1 << self._bits, np.int32)
        self.first, self.size, self.second = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.uint64)
        self.flat = np.empty(0, np.uint32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        mask = (1 << self._bits) - 1
        slot = (h >> np.uint64(64 - self._bits)).astype(np.int64)
        held = self._keys[slot]
        out = np.where(held == h, self._slots[slot], -1)
        todo = np.flatnonzero((held != h) & (held != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & mask
            held = self._keys[slot[todo]]
            hit = held == h[todo]
            out[todo[hit]] = self._slots[slot[todo[hit]]]
            todo = todo[~hit & (held != 0)]
        return out

    def _add(self, h: np.ndarray, number: np.ndarray) -> None:
        mask = (1 << self._bits) - 1
        slot = (h >> np.uint64(64 - self._bits)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            free = todo[self._keys[slot[todo]] == 0]
            self._keys[slot[free]] = h[free]
            won = self._keys[slot[todo]] == h[todo]
            self._slots[slot[todo[won]]] = number[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & mask

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids, one after the other, and each row's number of ids."""
        starts, stops = split(data, at)
        n_rows = len(at) - 1
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(n_rows, np.int64)
        if len(self.first) > MEMO:
            self._clear()
        h, check = text.hashes(data, starts, stops, 21)
        h |= np.uint64(1)
        found = self._find(h)
        new = np.flatnonzero(found < 0)
        raw = memoryview(np.ascontiguousarray(data))

        def append(where: np.ndarray) -> np.ndarray:
            ids = self._encode([bytes(raw[a:b]) for a, b in zip(starts[where].tolist(), stops[where].tolist(), strict=True)])
            size = np.fromiter(map(len, ids), np.int32, len(ids))
            begin = len(self.flat) + np.cumsum(size) - size
            self.flat = np.concatenate((self.flat, np.fromiter((x for w in ids for x in w), np.uint32, int(size.sum()))))
            number = np.arange(len(self.first), len(self.first) + len(where), dtype=np.int32)
            self.first, self.size, self.second = np.concatenate((self.first, begin)), np.concatenate((self.size, size)), np.concatenate((self.second, check[where]))
            return number

        if len(new):
            fresh, where = np.unique(h[new], return_index=True)
            if len(self.first) + len(fresh) > (1 << self._bits) * 3 // 4:  # one step with a great many distinct pre-tokens
                self._bits = int(len(self.first) + len(fresh)).bit_length() + 1
                self._clear()
                new = np.arange(len(h))
                fresh, where = np.unique(h, return_index=True)
            self._add(fresh, append(new[where]))
            found[new] = self._find(h[new])
        clash = np.flatnonzero(self.second[found] != check)
        if len(clash):
            found[clash] = append(clash)
        size = self.size[found].astype(np.int64)
        flat = self.flat[text.ranges(self.first[found], size)]
        ends = np.concatenate(([0], np.cumsum(size)))
        cut = np.searchsorted(starts, at)
        return flat, ends[cut[1:]] - ends[cut[:-1]]
