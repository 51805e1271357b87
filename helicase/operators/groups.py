"""Pairs of blocks compared in groups: a block moves once for each group it meets, and its count vectors are made once there.

Blocks that follow each other are a group of bounded size. A pair of groups is one key of a shuffle; within a task the blocks of its left side are
held, and those of its right side pass by.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks

#: Blocks of the usual size, and times LETTERS, that a group holds at most.
BLOCKS, LETTERS = 8, 4
#: The largest k whose counts are kept as a matrix over all k-mers; longer ones are matched by their codes.
DENSE = 7
#: Share of a tile's cells up to which those that pass the screen are compared one by one.
FEW = 0.01
#: Cells compared at once.
STEP = 4096


def rows(left: int, right: int, parts: int, least: int, most: int) -> int:
    """Rows of a group, so that about `parts` pairs of groups hold all of two tables: what moves grows with the number of groups."""
    return max(least, min(most, math.isqrt(left * right // max(parts, 1))))


class Vectors:
    """k-mer counts of a block's sequences, at most 65,535 each; a matrix whose commonest columns come first, or codes and counts."""

    def __init__(self, seqs: list[str], k: int, canonical: bool) -> None:
        self.many, self.k = len(seqs), k
        self.row, self.code = blocks.kmer_codes(seqs, k, canonical)
        self.matrix = None

    def fill(self, places: np.ndarray | None) -> Vectors:
        """places: the column of each code; none for codes too many for a matrix."""
        if places is None:
            cell, n = np.unique(self.row << (2 * self.k) | self.code, return_counts=True)
            self.row, self.code, self.n = cell >> (2 * self.k), cell & ((1 << (2 * self.k)) - 1), np.minimum(n, 65_535).astype(np.float64)
            self.square = np.bincount(self.row, self.n**2, self.many)
            self.order = np.argsort(self.code, kind="stable")
            self.sorted = self.code[self.order]
            return self
        wide = int(places.max()) + 1
        counts = np.minimum(np.bincount(self.row * wide + places[self.code], minlength=self.many * wide), 65_535).reshape(self.many, wide)
        self.square = np.einsum("ij,ij->i", counts, counts).astype(np.float64)
        # whole numbers are exact in 32-bit floats below 2**24
        self.matrix = counts.astype(np.float32 if self.square.max(initial=0) < 1 << 23 else np.float64)
        self.head = self.matrix[:, : max(64, wide // 8)]
        self.own = np.einsum("ij,ij->i", self.head, self.head)
        self.rest = np.sqrt(np.maximum(self.square - self.own, 0)).astype(self.matrix.dtype)
        self.row = self.code = None
        return self


def places(held: list[Vectors], k: int, canonical: bool) -> np.ndarray | None:
    """Columns of all k-mers, those commonest in `held` first."""
    if k > DENSE:
        return None
    codes = np.arange(4**k)
    if canonical:
        back = np.zeros_like(codes)
        for i in range(k):
            back |= (3 - (codes >> (2 * i) & 3)) << (2 * (k - 1 - i))
        codes = codes[codes <= back]
    seen = sum((np.bincount(v.code, minlength=4**k) for v in held), np.zeros(4**k, np.int64))
    out = np.zeros(4**k, np.int64)
    out[codes[np.argsort(-seen[codes], kind="stable")]] = np.arange(len(codes))
    return out


def squared(a: Vectors, b: Vectors) -> np.ndarray:
    """Squared distances of all pairs."""
    if a.matrix is not None:
        dot = a.matrix @ b.matrix.T
    else:
        dot = np.zeros((a.many, b.many))
        ends = np.searchsorted(b.row, np.arange(b.many + 1))
        for j in range(b.many):  # a row of b at a time, so that no more is held than a has codes
            code, n = b.code[ends[j] : ends[j + 1]], b.n[ends[j] : ends[j + 1]]
            low = np.searchsorted(a.sorted, code)
            many = np.searchsorted(a.sorted, code, "right") - low
            at = a.order[np.repeat(low - np.cumsum(many) + many, many) + np.arange(int(many.sum()))]
            dot[:, j] = np.bincount(a.row[at], a.n[at] * np.repeat(n, many), a.many)
    return np.rint(a.square[:, None] + b.square - 2.0 * dot).astype(np.int64)


def some_squared(a: Vectors, b: Vectors, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs of rows i and j, one by one if they are few."""
    if a.matrix is None or len(i) > FEW * a.many * b.many:
        return squared(a, b)[i, j]
    sq = np.empty(len(i), np.int64)
    for at in range(0, len(i), STEP):
        x, y = i[at : at + STEP], j[at : at + STEP]
        dot = np.einsum("ij,ij->i", a.matrix[x], b.matrix[y])
        sq[at : at + STEP] = np.rint(a.square[x] + b.square[y] - 2.0 * dot)
    return sq


def within(a: Vectors, b: Vectors, most: np.ndarray | float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and squared distances of the pairs at no more than `most`, a number or one for each row of a.

    A pair is no nearer than by its commonest k-mers and the norms of its other counts. Only pairs that this allows are compared in full.
    """
    most = np.broadcast_to(np.asarray(most, np.float64), (a.many,))
    if a.matrix is not None:
        low = a.head @ b.head.T
        low *= -2
        low += a.own[:, None]
        low += b.own
        gap = a.rest[:, None] - b.rest
        gap *= gap
        low += gap
        i, j = np.nonzero(low <= (most + 0.5)[:, None].astype(low.dtype))  # distances are whole numbers
        if len(i) <= FEW * low.size:
            sq = some_squared(a, b, i, j)
            near = sq <= most[i]
            return i[near], j[near], sq[near]
    sq = squared(a, b)
    i, j = np.nonzero(sq <= most[:, None])
    return i, j, sq[i, j]


def meet(met: DataFrame, left: DataFrame, right: DataFrame, columns: list[str], r_columns: list[str], schema: str, work: type, *args: object) -> DataFrame:
    """The rows that `work` makes of pairs of blocks `met` (block, r_block), from left's and right's `columns`.

    work(*args) serves a task: left(row) gets each block of a pair's left group, right(row, blocks) each of the right group and the left ones it meets, both
    as dictionaries, and end() comes last. right and end yield record batches.
    """
    parts = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbers = met.join(left.select("block", "group"), "block").join(right.select(F.col("block").alias("r_block"), F.col("group").alias("r_group")), "r_block")
    empty = lambda df, names: [F.lit(None).cast(dict(df.dtypes)[c]).alias(n) for c, n in names]
    mine, theirs = [(c, f"l_{c}") for c in columns], [(c, f"r_{c}") for c in r_columns]
    asked = numbers.select("group", "r_group", "block").distinct()
    meets = numbers.groupBy("group", "r_group", "r_block").agg(F.collect_list("block").alias("meets"))
    held = asked.join(left.select("block", *(F.col(c).alias(n) for c, n in mine)), "block")
    held = held.select("group", "r_group", "block", F.lit(None).cast("array<bigint>").alias("meets"), *(n for _, n in mine), *empty(right, theirs))
    passing = meets.join(right.select(F.col("block").alias("r_block"), *(F.col(c).alias(n) for c, n in theirs)), "r_block")
    passing = passing.select("group", "r_group", F.col("r_block").alias("block"), "meets", *empty(left, mine), *(n for _, n in theirs))
    rows = held.union(passing).withColumn("side", F.col("meets").isNotNull())
    rows = rows.repartition(4 * parts, "group", "r_group").sortWithinPartitions("group", "r_group", "side", "block")
    names = (dict((n, c) for c, n in mine), dict((n, c) for c, n in theirs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, task = None, work(*args)
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                pair, side = (one.column("group")[0].as_py(), one.column("r_group")[0].as_py()), one.column("side")[0].as_py()
                if pair != now:
                    yield from task.end()
                    now, task = pair, work(*args)
                row = {c: one.column(n)[0].as_py() for n, c in names[side].items()} | {"block": one.column("block")[0].as_py()}
                if side:
                    yield from task.right(row, one.column("meets")[0].as_py())
                else:
                    task.left(row)
        yield from task.end()

    return rows.mapInArrow(run, schema)
