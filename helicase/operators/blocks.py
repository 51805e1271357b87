"""Sequences packed into blocks, so that distances of all pairs of two blocks are one matrix product.

Blocks hold a bounded number of sequences of like length; pairs of blocks are rows of a join, so the work spreads over
the cluster and no task or broadcast grows with the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import keep
from .derep import numbered

BLOCK = 1024
LETTERS = 1 << 20
#: Bases whose k-mers a task counts at once.
STEP = 1 << 18
_LETTER = np.full(256, 0, np.int64)
_LETTER[[67, 71, 84]] = [1, 2, 3]  # C, G, T


def kmer_codes(seqs: list[str], k: int, canonical: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row and code of every k-mer of the sequences."""
    raw = [s.encode() for s in seqs]
    size = np.array([len(r) for r in raw], np.int64)
    base = _LETTER[np.frombuffer(b"".join(raw), np.uint8)]
    many = np.maximum(size - k + 1, 0)
    row = np.repeat(np.arange(len(raw)), many)
    start = np.repeat(np.cumsum(size) - size, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    code = np.zeros(len(start), np.int64)
    back = np.zeros(len(start), np.int64)
    for i in range(k):
        b = base[start + i]
        code = code << 2 | b
        back |= (3 - b) << (2 * i)
    return row, np.minimum(code, back) if canonical else code


def sequence_cells(batches: Iterator[pa.RecordBatch], k: int, canonical: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of at most about STEP bases (a longer sequence alone), with the row, code and number of each distinct k-mer of each sequence; rows and codes rise."""
    for batch in batches:
        upto = np.cumsum(pc.binary_length(batch.column("seq")).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + STEP, "right")))
            part, at = batch.slice(at, stop - at), stop
            row, code = kmer_codes(part.column("seq").to_pylist(), k, canonical)
            cell, n = np.unique(row << (2 * k) | code, return_counts=True)
            yield part, cell >> (2 * k), cell & ((1 << (2 * k)) - 1), n


def kmer_texts(codes: np.ndarray, k: int) -> pa.Array:
    """The k-mers of numbers to base four."""
    letters = np.frombuffer(b"ACGT", np.uint8)[codes[:, None] >> (2 * np.arange(k - 1, -1, -1)) & 3]
    return pa.StringArray.from_buffers(len(codes), pa.py_buffer(np.arange(0, k * len(codes) + 1, k, dtype=np.int32)), pa.py_buffer(letters.tobytes()))


def count_matrices(left: list[str], right: list[str], k: int, canonical: bool) -> tuple[np.ndarray, np.ndarray]:
    """Count vectors of two lists over the k-mers that occur in either; exact in 32-bit floats up to 65,535 by 2**24 over the norms, so 64-bit beyond."""
    (ra, ca), (rb, cb) = kmer_codes(left, k, canonical), kmer_codes(right, k, canonical)
    names, at = np.unique(np.concatenate((ca, cb)), return_inverse=True)
    width = max(1, len(names))
    a = np.bincount(ra * width + at[: len(ca)], minlength=len(left) * width).reshape(len(left), width)
    b = np.bincount(rb * width + at[len(ca) :], minlength=len(right) * width).reshape(len(right), width)
    a, b = np.minimum(a, 65_535), np.minimum(b, 65_535)
    largest = max((a.astype(np.int64) ** 2).sum(1).max(initial=0), (b.astype(np.int64) ** 2).sum(1).max(initial=0))
    kind = np.float32 if largest < 1 << 23 else np.float64
    return a.astype(kind), b.astype(kind)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    wide = lambda m: (m.astype(np.float64) ** 2).sum(1)
    return np.rint(wide(a)[:, None] + wide(b) - 2.0 * (a @ b.T)).astype(np.int64)


def pack(df: DataFrame, key: str, columns: dict[str, str], size: int = BLOCK, by_length: bool = True) -> DataFrame:
    """(block, shortest, longest, key, ...): arrays of up to `size` rows and LETTERS bases (a longer sequence alone), in the order of length or key."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [key, *columns]
    order = [F.length("seq"), F.col(key)] if by_length else [F.col(key)]
    rows = df.select(*names).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id().cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            lengths = [len(s) for s in batch.column("seq").to_pylist()]
            at = 0
            while at < batch.num_rows:
                most = int(np.searchsorted(np.cumsum(lengths[at : at + size]), LETTERS, "right"))
                part, length = batch.slice(at, max(1, most)), lengths[at : at + max(1, most)]
                at += part.num_rows
                block = (part.column("__part")[0].as_py() << 32) + number
                number += 1
                arrays = [pa.array([part.column(c).to_pylist()], pa.list_(part.schema.field(c).type)) for c in names]
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([min(length)]), pa.array([max(length)]), *arrays], ["block", "shortest", "longest", *names])

    kinds = {key: dict(df.dtypes)[key], **columns}
    return rows.mapInArrow(run, "block long, shortest long, longest long, " + ", ".join(f"{c} array<{t}>" for c, t in kinds.items()))


def near_blocks(blocks: DataFrame, apart: int) -> DataFrame:
    """Pairs of blocks, the lower number first, with lengths that may differ by no more than `apart`: an equi-join on length bands."""
    band = max(1, apart)
    low, high = F.floor(F.col("shortest") / band), F.floor((F.col("longest") + apart) / band)
    a = blocks.select(F.col("block").alias("a"), F.col("shortest").alias("sa"), F.col("longest").alias("la"), F.explode(F.sequence(low, high)).alias("band"))
    b = a.select(F.col("a").alias("b"), F.col("sa").alias("sb"), F.col("la").alias("lb"), "band")
    return a.join(b, "band").where(f"a <= b and sa <= lb + {apart} and sb <= la + {apart}").select("a", "b").distinct()


def against(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every block of `left` beside every block of `right`, whose columns get the prefix r_: an equi-join on numbers of the right blocks."""
    right = keep(numbered(right, "block", name="place"))
    many = right.count()
    spread = left.withColumn("r_place", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long")) if many else F.array().cast("array<bigint>")))
    return spread.join(right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns)), "r_place")


def each_pair(rows: DataFrame, schema: str, work: Callable[[dict], pa.RecordBatch | None]) -> DataFrame:
    """Applies `work` to each row, a pair of blocks, as a dictionary of lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                out = work(batch.slice(i, 1).to_pylist()[0])
                if out is not None and out.num_rows:
                    yield out

    return rows.mapInArrow(run, schema)


def kept_blocks(df: DataFrame, key: str, columns: dict[str, str], size: int = BLOCK, by_length: bool = True) -> DataFrame:
    return keep(pack(df, key, columns, size, by_length))


def labelled(rows: DataFrame, group: str, work: Callable[[list[str], np.ndarray], np.ndarray], order: str = "read_idx") -> DataFrame:
    """(group, part, order): `work` numbers the sequences of each group, which come in the order of the column `order`, whose values it gets too.

    Groups follow each other in Arrow batches, so small ones cost no call of their own between Spark and Python.
    """
    kind = dict(rows.dtypes)[group]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve(table: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
            seqs = table.column("seq").to_pylist()
            places = table.column(order).to_numpy()
            parts = [work(seqs[i:j], places[i:j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            names = [table.column(c).combine_chunks() for c in (group, order)]
            return pa.RecordBatch.from_arrays([names[0], pa.array(np.concatenate(parts).astype(np.int64)), names[1]], [group, "part", order])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if len(held) > 1 and held[0].column(group)[0] == batch.column(group)[batch.num_rows - 1]:
                continue  # all of one group, which may go on
            table = pa.Table.from_batches(held).combine_chunks()
            number = table.column(group).combine_chunks().dictionary_encode().indices.to_numpy()
            ends = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
            if len(ends) > 1:  # the last group may go on
                yield solve(table.slice(0, ends[-1]), ends)
            held = table.slice(ends[-1]).combine_chunks().to_batches(max_chunksize=1 << 30)
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield solve(table, np.array([0, table.num_rows]))

    return rows.select(group, order, "seq").repartition(parts, group).sortWithinPartitions(group, order).mapInArrow(run, f"{group} {kind}, part long, {order} long")
