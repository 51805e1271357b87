"""Best-fit packing by large-item matching, planned on the exact histogram of lengths.

A document is its ids and one end id. Longer documents are cut into full pieces, the first piece taking what is over.
Pieces above a third of the capacity are at most two to a sequence and are matched greedily, the largest with the
largest that fits; smaller ones, largest first, go to the tightest gap. The plan is made from the number of pieces of each
length (at most `capacity` numbers, whatever the corpus) for groups of equal sequences at once; then each piece finds its
place by its rank among the pieces of its length. Nothing is packed by partition, so no partition leaves gaps of its own.

Edge cases: a null or empty text is the end id alone; an empty table gives an empty result; rows whose doc_id is null are
packed too; repeated rows are packed one by one; a text of any length is encoded whole, in a step of its own; further columns are ignored. Special tokens within a text get their own ids, as in the library, or are
text like any other with `encode_special_tokens`, as the library names it; so pieces may hold the end id of the file.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tables, text
from .pretokens import Encoded

CAPACITY, END = 1024, 2


@functools.cache
def _bytes_of_chars() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes stand for themselves, the rest follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.cache
def tokenizer(path: str) -> Encoded:
    """Ids of the vocabulary in a tokenizers JSON file.

    Its merges come in the order of their ids, so a byte-pair coder over ids as ranks gives the ids of that library; it is
    called with distinct pre-tokens only.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    own = _bytes_of_chars()
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    ids = [model["vocab"][m] for m in merged]
    if ids != sorted(ids):
        raise ValueError("the merges don't come in the order of their ids")
    known = set(merged)
    ranks = {bytes(own[c] for c in token): i for token, i in model["vocab"].items() if all(c in own for c in token) and (len(token) == 1 or token in known)}
    coder = tiktoken.Encoding("packing", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    return Encoded(lambda words: [coder._encode_single_piece(w) for w in words])


@functools.cache
def added_tokens(path: str, encode_special_tokens: bool = False) -> dict[bytes, int]:
    """Ids of the added tokens in a tokenizers JSON file that are cut out of a text before all else."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    tokens = [t for t in whole.get("added_tokens") or [] if t["content"] and not (encode_special_tokens and t["special"])]
    for t in tokens:
        if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
            raise ValueError(f"an added token that is not taken as it stands: {t['content']!r}")
    return {t["content"].encode(): t["id"] for t in tokens}


def encode(table: Encoded, added: dict[bytes, int], data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All rows' ids, one after the other, and each row's number of ids; texts between added tokens are split by themselves."""
    raw = data.tobytes()
    if not any(token in raw for token in added):
        return table.encode(data, at)
    pattern = re.compile(b"|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)))  # the longest that starts first
    found = [(row, *m.span(), added[m[0]]) for row, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) for m in pattern.finditer(raw, a, b)]
    row, start, stop, token = np.array(found, np.int64).reshape(-1, 4).T
    gone = np.zeros(len(data), bool)
    gone[text.ranges(start, stop - start)] = True
    left = np.concatenate(([0], np.cumsum(~gone)))
    # a row for each text before or after a token
    order = np.argsort(np.concatenate((row, np.arange(len(at)))) * 2 + np.repeat([1, 0], [len(row), len(at)]), kind="stable")
    ids, counts = table.encode(data[~gone], left[np.concatenate((start, at))[order]])
    ends = np.concatenate(([0], np.cumsum(counts)))[np.argsort(order)]  # ids before each token and each row
    many = np.bincount(row, minlength=len(at) - 1)
    return np.insert(ids, ends[: len(row)], token), np.diff(ends[len(row) :]) + many


def plan(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Groups of equal sequences, (lengths, how many), that hold counts[n] pieces of each length n."""
    left = counts.astype(object).copy()
    gaps: dict[int, list[tuple[list[int], int]]] = {}
    closed: list[tuple[list[int], int]] = []

    def put(items: list[int], many: int) -> None:
        gap = capacity - sum(items)
        if gap:
            gaps.setdefault(gap, []).append((items, many))
        else:
            closed.append((items, many))

    large = capacity // 3
    for a in range(capacity, large, -1):
        b = min(a, capacity - a)
        while left[a]:
            while b > large and (not left[b] or b == a and left[a] < 2):
                b -= 1
            if b <= large:
                put([a], left[a])
                left[a] = 0
            else:
                many = left[a] // 2 if a == b else min(left[a], left[b])
                put([a, b], many)
                left[a] -= many
                left[b] -= many
    for s in range(large, 0, -1):
        while left[s]:
            gap = min((g for g in gaps if g >= s), default=0)
            if gap:
                items, many = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                use = min(many, left[s])
                if many > use:
                    put(items, many - use)
                # as many of this length as fit go together, as the tightest gap is then in the same sequences
                fit = max(1, min(gap // s, left[s] // use))
                put(items + [s] * fit, use)
                left[s] -= use * fit
            else:
                fit = capacity // s
                full, rest = divmod(left[s], fit)
                if full:
                    put([s] * fit, full)
                if rest:
                    put([s] * int(rest), 1)
                left[s] = 0
    return closed + [g for groups in gaps.values() for g in groups]


class Places:
    """Where the r-th piece of length n goes."""

    def __init__(self, groups: list[tuple[list[int], int]]):
        used: dict[int, int] = {}
        rows, base = [], 0
        for items, many in groups:
            offset = 0
            for n in items:
                low = used.get(n, 0)
                rows.append((n, low, base, offset))
                used[n] = low + many
                offset += n
            base += many
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 4)
        self.key = (table[:, 0] << 48) + table[:, 1]
        self.low, self.base, self.offset = table[:, 1], table[:, 2], table[:, 3]

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 48) + rank, side="right") - 1
        return self.base[at] + rank - self.low[at], self.offset[at]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = True, encode_special_tokens: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids); without ids if so asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, added = tokenizer(path), added_tokens(path, encode_special_tokens)
        for batch, data, at in text.steps(batches, text.STEP_BYTES // 2):
            ids, counts = encode(table, added, data, at)
            ids = np.insert(ids, np.cumsum(counts), end).astype("<u4")
            counts = counts + 1
            many = -(-counts // capacity)
            doc = np.repeat(np.arange(len(counts)), many)
            piece = text.ranges(np.zeros(len(counts), np.int64), many)
            head = (counts - 1) % capacity + 1
            start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[doc], capacity)
            begin = (np.cumsum(counts) - counts)[doc] + start
            raw = memoryview(ids.tobytes())
            cut = [raw[4 * a : 4 * (a + n)] for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
            columns = [batch.column("doc_id").cast(pa.int64()).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in cut], pa.int64())]
            if with_ids:
                columns.append(text.binary([bytes(x) for x in cut]))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = True, encode_special_tokens: bool = True) -> DataFrame:
    """The pieces of all documents with sequence_id and offset, gapless from 0 within each sequence."""
    spark = docs.sparkSession
    cut = tables.keep(pieces(docs, path, capacity, end, with_ids, encode_special_tokens))
    salts = tables.shuffle_partitions(spark)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    many = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in many.groupBy("length").agg(F.sum("n")).collect():  # at most `capacity` rows
        histogram[length] = n
    places = spark.sparkContext.broadcast(Places(plan(histogram, capacity)))  # grows with the capacity alone
    before = many.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base"))
    names = [*cut.columns, "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.value.find(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(sequence), pa.array(offset)], [*names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return ranked.select(*names).mapInArrow(run, schema + ", sequence_id long, offset long")
