"""Line deduplication through a sharded minimal perfect hash.

Lines are counted once for each document by the 128-bit hash of their key (the line with `[\\x20\\x09-\\x0D]` stripped at
both ends and A-Z lower-cased). All distinct line hashes are dealt to shards; each shard is a minimal perfect hash
(levels of bit arrays, a line taking the first level where nothing collides with it) that indexes compact arrays: a
32-bit fingerprint and the number of documents up to the threshold; an array of the documents that keep a line covers
the lines that reach it. Documents probe the arrays with packed blocks of their line hashes; lines themselves are never
joined. A task gets a shard's arrays once, before its blocks. A shard with more than its part of all probes is sent to
several tasks, and its blocks are dealt among them.

Edge cases: a null or empty text is one empty line; a text without repeated lines is returned as it is; an
empty table gives an empty result; rows whose doc_id is null keep all their lines; rows with one doc_id count as
documents of their own, and the largest holder of a line is each of its rows; columns besides doc_id and text, whatever
their names, pass through, but for those of the added columns, in any case, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables, text

MIN_CHARS, MIN_DOCS = 40, 5
ADDED = ("n_lines", "n_dropped")
#: Distinct lines of a shard, at most about so many; its arrays then take some 2 MB.
SHARD_KEYS = 250_000
_GAMMA = 2
_LEVELS = 24


def split_lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and stop of every line and the number of lines of each row."""
    ends = np.flatnonzero(data == 10)
    owner = text.row_of(ends, at)
    n_rows = len(at) - 1
    count = np.bincount(owner, minlength=n_rows) + 1
    total = int(count.sum())
    last = np.cumsum(count) - 1
    stop = np.empty(total, np.int64)
    inner = np.ones(total, bool)
    inner[last] = False
    stop[inner], stop[last] = ends, at[1:]
    start = np.empty(total, np.int64)
    start[1:] = stop[:-1] + 1
    start[last - count + 1] = at[:-1]
    return start, stop, count


def line_keys(data: np.ndarray, at: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines whose key is long enough: row, number within the row, two hashes; and every row's number of lines."""
    start, stop, count = split_lines(data, at)
    solid = np.concatenate(([0], np.cumsum(~text.is_space(data))))
    places = np.flatnonzero(~text.is_space(data))
    left, right = solid[start], solid[stop]
    full = np.flatnonzero(right > left)
    a, b = places[left[full]], places[right[full] - 1] + 1
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    long = points[b] - points[a] >= min_chars
    full, a, b = full[long], a[long], b[long]
    h, check = text.hashes(text.lower_ascii(data), a, b, 3)
    first = np.cumsum(count) - count
    row = np.searchsorted(first, full, side="right") - 1
    return row, full - first[row], h, check, count


class PerfectHash:
    """A minimal perfect hash: n keys (pairs of 64-bit numbers) to 0..n-1. Keys that share a place at one level go on to the next."""

    def __init__(self, levels: list[np.ndarray], seed: int):
        self.levels, self.seed = levels, seed
        before, self.ranks = 0, []
        for bits in levels:
            self.ranks.append((before + np.cumsum(bits) - bits).astype(np.int32))
            before += int(bits.sum())

    @staticmethod
    def build(keys: np.ndarray, checks: np.ndarray) -> PerfectHash:
        """The keys are different pairs; if some share all their places, another seed is taken."""
        seed = 0
        while True:
            levels, left = [], np.arange(len(keys))
            for depth in range(_LEVELS):
                if not len(left):
                    return PerfectHash(levels, seed)
                size = max(1, _GAMMA * len(left))
                place = PerfectHash._place(keys[left], checks[left], depth, seed, size)
                hits = np.bincount(place, minlength=size)
                levels.append(hits == 1)
                left = left[hits[place] > 1]
            if not len(left):
                return PerfectHash(levels, seed)
            seed += 1

    @staticmethod
    def _place(keys: np.ndarray, checks: np.ndarray, depth: int, seed: int, size: int) -> np.ndarray:
        return (text.mix(keys ^ text.mix(checks, 1000 * seed + depth), 100 + depth) % np.uint64(size)).astype(np.int64)

    def index(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Each key's index; any index, or -1, for keys that aren't in the set."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for depth, bits in enumerate(self.levels):
            place = self._place(keys[todo], checks[todo], depth, self.seed, len(bits))
            hit = bits[place]
            out[todo[hit]] = self.ranks[depth][place[hit]]
            todo = todo[~hit]
        return out

    def pack(self) -> list[tuple[int, bytes]]:
        return [(len(b), np.packbits(b).tobytes()) for b in self.levels]

    @staticmethod
    def unpack(sizes: list[int], bits: list[bytes], seed: int) -> PerfectHash:
        return PerfectHash([np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for n, b in zip(sizes, bits, strict=True)], seed)


def _count(min_chars: int):
    """Of each step of text: the distinct lines, the number of documents that hold each, and the largest doc_id of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in text.steps(batches):
            row, _, h, check, _ = line_keys(data, at, min_chars)
            docs = batch.column("doc_id")
            known = docs.is_valid().to_numpy(zero_copy_only=False)
            ids = docs.fill_null(0).to_numpy()
            there = known[row]
            row, h, check = row[there], h[there], check[there]
            order = np.lexsort((row, check, h))
            row, h, check = row[order], h[order], check[order]
            line = np.ones(len(h), bool)
            line[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1])
            fresh = line.copy()
            fresh[1:] |= row[1:] != row[:-1]
            row, h, check, line = row[fresh], h[fresh], check[fresh], line[fresh]
            starts = np.flatnonzero(line)
            most = np.maximum.reduceat(ids[row], starts) if len(h) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[starts].view(np.int64)), pa.array(check[starts].view(np.int64)), pa.array(np.diff(np.append(starts, len(h)))), pa.array(most)], ["line", "check", "n", "keeper"])

    return run, "line long, check long, n long, keeper long"


_SHARD = "shard int, probes long, seed long, sizes array<long>, bits array<binary>, fingerprints binary, counts binary, keepers binary"


def _build(min_docs: int):
    """One row of arrays for each shard, whose lines come one after the other."""

    def arrays(shard: int, lines: pa.Table) -> pa.RecordBatch:
        keys, checks = (lines.column(c).to_numpy().view(np.uint64) for c in ("line", "check"))
        n, keeper = (lines.column(c).to_numpy() for c in ("n", "keeper"))
        hashed = PerfectHash.build(keys, checks)
        order = np.argsort(hashed.index(keys, checks))
        counts = np.minimum(n, min_docs)[order]
        levels = hashed.pack()
        return pa.RecordBatch.from_arrays(
            [
                pa.array([shard], pa.int32()), pa.array([int(n.sum())]), pa.array([hashed.seed]), pa.array([[n for n, _ in levels]], pa.list_(pa.int64())), pa.array([[b for _, b in levels]], pa.list_(pa.binary())),
                text.binary([checks[order].astype(np.uint32).tobytes()]), text.binary([counts.astype(np.uint8 if min_docs < 256 else np.int64).tobytes()]), text.binary([keeper[order][counts >= min_docs].tobytes()]),
            ],
            ["shard", "probes", "seed", "sizes", "bits", "fingerprints", "counts", "keepers"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True]))) if len(shard) else np.zeros(1, np.int64)
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if held and held[0].column("shard")[0].as_py() != shard[i]:
                    yield arrays(held[0].column("shard")[0].as_py(), pa.Table.from_batches(held).combine_chunks())
                    held = []
                held.append(batch.slice(i, j - i))
        if held:
            yield arrays(held[0].column("shard")[0].as_py(), pa.Table.from_batches(held).combine_chunks())

    return run


_BLOCK = ["lines", "checks", "docs", "texts", "numbers"]


def _blocks(min_chars: int, shards: int, salts: dict[int, int]):
    """Packed probes: for each step of text and shard, the line hashes with their documents, those's text hashes and line numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in text.steps(batches):
            row, line, h, check, _ = line_keys(data, at, min_chars)
            docs = batch.column("doc_id")
            there = docs.is_valid().to_numpy(zero_copy_only=False)[row]
            row, line, h, check = row[there], line[there], h[there], check[there]
            ids, own = docs.fill_null(0).to_numpy(), batch.column("text_hash").to_numpy()
            shard = (h % np.uint64(shards)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            shard, h, check, row, line = shard[order], h[order], check[order], row[order], line[order].astype(np.int32)
            edges = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True]))) if len(shard) else np.zeros(1, np.int64)
            cut = list(zip(edges[:-1], edges[1:], strict=True))
            which = [int(shard[i]) for i, _ in cut]
            seed = int(text.mix(h[:1], 9)[0]) if len(h) else 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(which, pa.int32()), pa.array([(seed + s) % salts.get(s, 1) for s in which], pa.int32()), *(text.binary([x[i:j].tobytes() for i, j in cut]) for x in (h, check, ids[row], own[row], line))],
                ["shard", "salt", *_BLOCK],
            )

    return run, "shard int, salt int, " + ", ".join(f"{c} binary" for c in _BLOCK)


def _probe(min_docs: int):
    """The lines that go: (doc_id, text_hash, their numbers). A shard's arrays come before its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = hashed = None
        for batch in batches:
            for at in range(batch.num_rows):
                r = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                if not r["last"]:
                    shard, hashed = r["shard"], PerfectHash.unpack(r["sizes"], r["bits"], r["seed"])
                    prints, counts = np.frombuffer(r["fingerprints"], np.uint32), np.frombuffer(r["counts"], np.uint8 if min_docs < 256 else np.int64)
                    keepers = np.zeros(len(counts), np.int64)
                    keepers[counts >= min_docs] = np.frombuffer(r["keepers"], np.int64)
                    continue
                if r["shard"] != shard:
                    raise ValueError("a block without its shard's arrays")
                h, check = np.frombuffer(r["lines"], np.uint64), np.frombuffer(r["checks"], np.uint64)
                docs, own, numbers = np.frombuffer(r["docs"], np.int64), np.frombuffer(r["texts"], np.int64), np.frombuffer(r["numbers"], np.int32)
                place = hashed.index(h, check)
                gone = (place >= 0) & (prints[place] == check.astype(np.uint32)) & (counts[place] >= min_docs) & (keepers[place] != docs)
                docs, own, numbers = docs[gone], own[gone], numbers[gone]
                order = np.lexsort((numbers, own, docs))
                docs, own, numbers = docs[order], own[order], numbers[order]
                starts = np.flatnonzero(np.concatenate(([True], (docs[1:] != docs[:-1]) | (own[1:] != own[:-1])))) if len(docs) else np.empty(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(docs)).astype(np.int32)), pa.array(numbers))
                yield pa.RecordBatch.from_arrays([pa.array(docs[starts]), pa.array(own[starts]), lists], ["doc_id", "text_hash", "numbers"])

    return run, "doc_id long, text_hash long, numbers array<int>"


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shards: int | None = None, added: tuple[str, str] = ADDED) -> DataFrame:
    """docs with the repeated lines taken out of `text`, and the columns `added`, n_lines and n_dropped, at the end; columns of these names, in any case, are replaced.

    A line whose key has min_chars code points or more and is in min_docs documents or more stays only in the
    largest doc_id that holds it.
    """
    spark = docs.sparkSession
    pair = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    lines = tables.keep(pair.mapInArrow(*_count(min_chars)).groupBy("line", "check").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper")))
    if shards is None:
        shards = max(64, -(-lines.count() // SHARD_KEYS))
    # the same residue as in _blocks: of the hash read as unsigned
    residue = F.pmod(F.pmod(F.col("line"), F.lit(shards)) + F.when(F.col("line") < 0, F.lit((1 << 64) % shards)).otherwise(0), F.lit(shards)).cast("int")
    arrays = tables.keep(lines.withColumn("shard", residue).repartition("shard").sortWithinPartitions("shard").select("shard", "line", "check", "n", "keeper").mapInArrow(_build(min_docs), _SHARD))
    # a shard that has more than its part of the probes goes to several tasks: fewer such shards than partitions
    part = F.lit(max(1, -(-(arrays.agg(F.sum("probes")).first()[0] or 0) // tables.shuffle_partitions(spark))))
    salts = F.ceil(F.col("probes") / part)
    wide = dict(arrays.where(F.col("probes") > part).select("shard", salts).collect())
    copied = arrays.withColumn("salt", F.explode(F.sequence(F.lit(1), salts.cast("int")))).withColumn("salt", F.col("salt") - 1).withColumn("last", F.lit(0))
    probes = pair.mapInArrow(*_blocks(min_chars, shards, wide)).withColumn("last", F.lit(1))
    both = copied.drop("probes").unionByName(probes, allowMissingColumns=True)
    dealt = both.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "last")
    probed = dealt.mapInArrow(*_probe(min_docs))
    gone, doc, own = (tables.unused(docs, c) for c in ("gone", "gone_doc", "gone_text"))
    found = tables.keep(probed.groupBy(F.col("doc_id").alias(doc), F.col("text_hash").alias(own)).agg(F.flatten(F.collect_list("numbers")).alias(gone)))
    names = [c for c in docs.columns if c.lower() not in {a.lower() for a in added}]
    # the dropped lines' table grows with the documents, so it is never broadcast
    joined = docs.join(found.hint("merge"), (F.col("doc_id").cast("long") == F.col(doc)) & (F.xxhash64("text") == F.col(own)), "left").select(*(docs[c] for c in names), gone)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in names)
    return joined.mapInArrow(_rebuild(names, gone, added), f"{kept}, `{added[0]}` long, `{added[1]}` long")


def _rebuild(names: list[str], gone: str, added: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in text.steps(batches):
            start, stop, count = split_lines(data, at)
            first = np.cumsum(count) - count
            stay = np.ones(len(start), bool)
            lists = batch.column(gone)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            length = np.nan_to_num(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
            stay[np.repeat(first, length) + flat] = False
            row = np.repeat(np.arange(len(count)), count)
            dropped = count - np.bincount(row[stay], minlength=len(count))
            # each line that stays takes its line break along, but for the last one of its row
            keep_rows = row[stay]
            is_last = np.ones(len(keep_rows), bool)
            is_last[:-1] = keep_rows[1:] != keep_rows[:-1]
            length = stop[stay] - start[stay] + ~is_last
            source = text.ranges(start[stay], length)
            body = data[np.minimum(source, max(0, len(data) - 1))] if len(data) else np.empty(0, np.uint8)
            breaks = (np.cumsum(length) - 1)[~is_last]
            body[breaks] = 10
            size = np.bincount(keep_rows, weights=length, minlength=len(count)).astype(np.int64)
            new = text.text_rows(body, np.concatenate(([0], np.cumsum(size))))
            columns = [new if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(count), pa.array(dropped)], [*names, *added])

    return run
