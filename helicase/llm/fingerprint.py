"""Context-triggered piecewise hashing of documents.

A rolling hash over seven bytes ends a chunk wherever it is a multiple of the block size (3 * 2**k), and each
chunk adds one of 64 characters to the signature. The fingerprint holds the block size, the signature at it (up
to 64 characters) and at twice it (up to 32); the last character covers all bytes that are left, so whole texts
count. k is the least that gives at most about 64 chunks, lowered until there are at least 32.

Fingerprints are compared where their block sizes are compatible (equal, or one twice the other): one minus the
edit distance over the longer signature's length, and 0 where the two share no four characters in a row. Equal
fingerprints have likeness 1.

Edge cases: a null text is an empty one, whose fingerprint is "3::"; equal texts have equal fingerprints; a
single document is its own successor; rows whose doc_id is null are left out; an empty table gives an empty
result; rows with one doc_id follow each other in the order of their texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables, text

WINDOW, LONG, SHORT, LEVELS, GRAM = 7, 64, 32, 40, 4
# The characters of a signature.
_CHARS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


def _signature(data: np.ndarray, at: np.ndarray, row: np.ndarray, place: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes [rows, most] and lengths, from the chunk ends (`place`, the byte after each) of every row."""
    n_rows = len(at) - 1
    count = np.bincount(row, minlength=n_rows)
    first = np.cumsum(count) - count
    rank = np.arange(len(row)) - first[row]
    early = rank < most - 1
    row, place, rank = row[early], place[early], rank[early]
    start = at[row].copy()
    inner = rank > 0
    start[inner] = place[np.flatnonzero(inner) - 1]
    codes = np.full((n_rows, most), -1, np.int8)
    codes[row, rank] = (text.hashes(data, start, place, 9)[0] & np.uint64(63)).astype(np.int8)
    kept = np.minimum(count, most - 1)
    ends = at[:-1].copy()
    ends[row] = place  # rows come in order, so a row's last chunk end stays
    rest = np.flatnonzero(ends < at[1:])
    codes[rest, kept[rest]] = (text.hashes(data, ends[rest], at[1:][rest], 9)[0] & np.uint64(63)).astype(np.int8)
    kept[rest] += 1
    return codes, kept


class Prints:
    """Fingerprints of many texts: levels k, signature codes and lengths."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        size = np.diff(at)
        n_rows = len(size)
        # zeros before each row, so that its first windows depend on it alone
        padded = np.zeros(len(data) + n_rows * (WINDOW - 1), np.uint8)
        begin = at[:-1] + np.arange(n_rows) * (WINDOW - 1)
        padded[text.ranges(begin + WINDOW - 1, size)] = data
        roll = text.rolling(padded, WINDOW)[text.ranges(begin, size)] if len(data) else np.empty(0, np.uint64)
        spot = np.flatnonzero(roll % np.uint64(3) == 0)
        low = roll[spot] // np.uint64(3)
        zeros = np.full(len(low), LEVELS - 1)
        some = low != 0
        zeros[some] = np.minimum(np.log2((low[some] & (~low[some] + np.uint64(1))).astype(np.float64)).astype(np.int64), LEVELS - 1)
        row = text.row_of(spot, at)
        many = np.bincount(row * LEVELS + zeros, minlength=n_rows * LEVELS).reshape(n_rows, LEVELS)[:, ::-1].cumsum(1)[:, ::-1]
        self.k = np.ceil(np.log2(np.maximum(1, size / (3 * LONG)))).astype(np.int64)
        while (short := (self.k > 0) & (many[np.arange(n_rows), self.k] < LONG // 2)).any():
            self.k[short] -= 1
        self.codes, self.sizes = [], []
        for extra, most in ((0, LONG), (1, SHORT)):
            use = zeros >= self.k[row] + extra
            codes, kept = _signature(data, at, row[use], spot[use] + 1, most)
            self.codes.append(codes)
            self.sizes.append(kept)

    def strings(self) -> list[str]:
        parts = []
        for codes, kept in zip(self.codes, self.sizes, strict=True):
            chars = _CHARS[np.maximum(codes, 0)]
            parts.append([chars[i, : kept[i]].tobytes().decode() for i in range(len(kept))])
        return [f"{3 << int(k)}:{a}:{b}" for k, a, b in zip(self.k, *parts, strict=True)]

    def take(self, rows: np.ndarray) -> Prints:
        out = object.__new__(Prints)
        out.k, out.codes, out.sizes = self.k[rows], [c[rows] for c in self.codes], [s[rows] for s in self.sizes]
        return out


def edit_distance(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Levenshtein distances of many pairs of code rows (up to 64 codes, padded with -1), bit-parallel."""
    one = np.uint64(1)
    bits = one << np.arange(a.shape[1], dtype=np.uint64)
    plus, minus = np.full(len(a), ~np.uint64(0)), np.zeros(len(a), np.uint64)
    last = np.where(n > 0, one << np.maximum(n - 1, 0).astype(np.uint64), np.uint64(0))
    score = n.astype(np.int64).copy()
    for j in range(int(m.max(initial=0))):
        on = j < m
        same = ((a == b[:, j : j + 1]) & (a >= 0)) @ bits
        x = same | minus
        y = (((same & plus) + plus) ^ plus) | same
        up, down = minus | ~(y | plus), plus & y
        score += on * ((up & last) != 0).astype(np.int64) - on * ((down & last) != 0).astype(np.int64)
        up, down = (up << one) | one, down << one
        plus, minus = np.where(on, down | ~(x | up), plus), np.where(on, up & x, minus)
    return np.where(n == 0, m, score)


def _alike(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a))
    grams = []
    for codes in (a, b):
        value = np.full((len(codes), max(1, codes.shape[1] - GRAM + 1)), -1, np.int64)
        full = (codes[:, GRAM - 1 :] >= 0) if codes.shape[1] >= GRAM else np.zeros_like(value, bool)
        joined = sum(codes[:, i : i + value.shape[1]].astype(np.int64) << (6 * i) for i in range(GRAM))
        grams.append(np.where(full, joined, -1))
    left = np.sort(grams[0], 1)
    shared = np.zeros(len(a), bool)
    flat = (np.arange(len(a))[:, None] * (1 << 25) + left).ravel()
    for j in range(grams[1].shape[1]):
        want = grams[1][:, j]
        key = np.arange(len(a)) * (1 << 25) + want
        at = np.minimum(np.searchsorted(flat, key), max(0, len(flat) - 1))
        shared |= (want >= 0) & (flat[at] == key)
    # signatures of fewer than four characters must be equal
    whole = (n == m) & (n > 0) & (n < GRAM)
    whole[whole] = (a[whole][:, :GRAM] == b[whole][:, :GRAM]).all(1)
    use = np.flatnonzero(shared | whole)
    if len(use):
        out[use] = 1 - edit_distance(a[use], n[use], b[use], m[use]) / np.maximum(n[use], m[use])
    return out


def likeness(a: Prints, b: Prints) -> np.ndarray:
    """Likeness of each pair of fingerprints, 0 to 1."""
    out = np.zeros(len(a.k))

    def better(use: np.ndarray, i: int, j: int) -> None:
        rows = np.flatnonzero(use)
        for cut in range(0, len(rows), 2048):
            r = rows[cut : cut + 2048]
            out[r] = np.maximum(out[r], _alike(a.codes[i][r], a.sizes[i][r], b.codes[j][r], b.sizes[j][r]))

    level = a.k == b.k
    same = level.copy()
    for i in range(2):
        wide = min(a.codes[i].shape[1], b.codes[i].shape[1])
        same &= (a.codes[i][:, :wide] == b.codes[i][:, :wide]).all(1)
    better(level & ~same, 0, 0)
    better(level & ~same, 1, 1)
    better(a.k == b.k + 1, 0, 1)
    better(b.k == a.k + 1, 1, 0)
    out[same] = 1.0
    return out


def _edit(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts of all rows but the last with the last half of their code points taken from the next row; code points of every row."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    base = np.searchsorted(lead, at)
    chars = np.diff(base)
    half = chars[:-1] // 2
    lead = np.append(lead, len(data))
    cut = lead[base[:-2] + chars[:-1] - half]
    cut = np.where(half == 0, at[1:-1], cut)
    taken = np.minimum(half, chars[1:])
    until = np.where(taken == chars[1:], at[2:], lead[np.minimum(base[1:-1] + taken, len(lead) - 1)])
    starts = np.stack((at[:-2], at[1:-1]), 1).ravel()
    sizes = np.stack((cut - at[:-2], until - at[1:-1]), 1).ravel()
    new = data[text.ranges(starts, sizes)]
    return new, np.concatenate(([0], np.cumsum(sizes.reshape(-1, 2).sum(1)))), chars


_OUT = "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _print_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order; a ghost is a copy of the row that follows in another partition."""
    held: pa.RecordBatch | None = None
    for rows, _, _ in text.steps(batches, text.STEP_BYTES // 2):
        if held is not None:
            rows = pa.Table.from_batches([held, rows]).combine_chunks().to_batches(max_chunksize=1 << 30)[0]
        held = rows.slice(rows.num_rows - 1)
        if rows.num_rows < 2:
            continue
        data, at = text.column_bytes(rows.column("text"))
        own = Prints(data, at)
        body, cuts, chars = _edit(data, at)
        edited = Prints(body, cuts)
        real = np.flatnonzero(~rows.column("ghost").to_numpy(zero_copy_only=False)[:-1])
        mine, new, after = own.take(real), edited.take(real), own.take(real + 1)
        pick = pa.array(real)
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id").take(pick), pa.array(chars[real]), text.text_rows(body, cuts).take(pick), pa.array(mine.strings()), pa.array(new.strings()), pa.array(likeness(mine, new)), pa.array(likeness(mine, after))],
            ["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )


def _longs(values: list[int | None]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<long>")


def with_successors(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ghost) in runs of ascending doc_id, each run ended by a ghost copy of the row after it (after the last: the first).

    Runs are cut at quantiles of the ids; the driver holds one id for each run. A row finds its run in two steps, among the
    borders that begin a stretch of borders and within its stretch, so its cost grows with the root of the runs.
    """
    spark = docs.sparkSession
    runs = 4 * tables.shuffle_partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    cuts = sorted({int(x) for x in docs.approxQuantile("doc_id", [i / runs for i in range(1, runs)], 0.2 / runs)})
    cuts = [-(2**63), *(min(x, 2**63 - 1) for x in cuts)]
    step = math.isqrt(len(cuts) - 1) + 1
    stretches = [_longs(cuts[i : i + step]) for i in range(0, len(cuts), step)]
    upto = lambda borders: F.size(F.filter(borders, lambda x: x <= F.col("doc_id")))
    docs = docs.withColumn("stretch", upto(_longs(cuts[::step])))
    docs = docs.select("doc_id", "text", ((F.col("stretch") - 1) * step + upto(F.element_at(F.array(*stretches), F.col("stretch"))) - 1).alias("run"))
    firsts = {r["run"]: r["first"] for r in docs.groupBy("run").agg(F.min("doc_id").alias("first")).collect()}
    held = sorted(firsts)
    before = dict(zip(held, held[-1:] + held[:-1], strict=True))
    at = F.col("run") + 1
    earlier = F.when(F.col("doc_id") == F.element_at(_longs([firsts.get(i) for i in range(len(cuts))]), at), F.element_at(_longs([before.get(i) for i in range(len(cuts))]), at).cast("int"))
    own = F.array(F.struct("run", F.lit(False).alias("ghost")))
    places = F.when(earlier.isNull(), own).otherwise(F.array_union(own, F.array(F.struct(earlier.alias("run"), F.lit(True).alias("ghost")))))
    rows = docs.select("doc_id", "text", F.explode(places).alias("p")).select("doc_id", "text", "p.run", "p.ghost")
    return rows.repartition("run").sortWithinPartitions("run", "ghost", "doc_id", "text").select("doc_id", "text", "ghost")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text (the last half of its code points replaced by as many from the start of the next document), and the likeness of its own to the edited text's and to the next document's."""
    return with_successors(docs).mapInArrow(_print_rows, _OUT)
