"""Suffix-array deduplication: bytes covered by a string of `size` bytes that also starts earlier are removed.

Earlier means a smaller doc_id, or an earlier start in the same document. Steps:

1. Winnowing. Every string of `size` bytes has a key, the least hash of the GRAM-byte strings within it; equal strings
   have equal keys, and neighbouring starts mostly share one, so a document is a row of windows (starts lo..lo+n-1 with
   one key), about one for 33 bytes. Keys that occur once hold no repeat. A bit table of fixed size, made from the keys'
   counts, tells the windows that may.
2. Windows with the same bytes (by a hash of 128 bits) are collapsed to the first of them by an aggregation; all others
   are repeats whole. Texts of windows travel only from here on, and only for first windows whose key has others; they are
   cut from the documents' segments, of bounded length, in which overlapping windows are stored once.
3. The first windows are dealt by their key. Each task sorts the suffixes that start in its windows by two-stage sorting
   (only those smaller than their successors are sorted directly, the rest are induced by a scan over buckets of first
   bytes) and computes common prefixes of neighbours; starts whose neighbours agree on `size` bytes are equal strings,
   and all but the first of each are repeats. The windows of a key whose different ones hold more than GROUP starts are cut into
   their single starts, which are dealt to several groups by a second key, taken from all their bytes, and sorted there.
4. Repeats become spans, spans are gathered by document (its own only) and cut out of its bytes.

Edge cases: a null text is empty; texts shorter than `size` lose nothing; rows whose doc_id is null lose nothing and
cause no removal; rows with one doc_id and different texts are different documents, in the order of a hash of the text;
of rows with one doc_id and one text neither is earlier; an empty table gives an empty result; columns besides doc_id
and text, whatever their names, pass through, but for those that the result adds, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables, text

SIZE, GRAM = 100, 36
ADDED = ("n_bytes", "n_removed", "n_spans", "kept")
#: Bits of the table that tells which keys may repeat: 16 MB, whatever the corpus. With more repeated keys than that it tells less, and more windows go on to the exact steps.
TABLE_BITS = 27
#: Starts in the different windows of a group that is sorted together.
GROUP = 1 << 16
#: Bytes after which a segment ends, and so the windows that one row of the wanted ones can hold.
SEGMENT = 1 << 16
_MOST_STARTS = 2048


def _slide_min(v: np.ndarray, width: int) -> np.ndarray:
    w = 1
    while 2 * w <= width:
        v = np.minimum(v[: len(v) - w], v[w:])
        w *= 2
    r = width - w
    return np.minimum(v[: len(v) - r], v[r:]) if r else v


def windows(data: np.ndarray, at: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, first starts (in the batch), numbers of starts and keys of all windows, and the hashes of all grams."""
    n = len(data)
    empty = np.empty(0, np.int64)
    if n < size:
        return empty, empty, empty, np.empty(0, np.uint64), np.empty(0, np.uint64)
    grams = text.rolling(data, gram)
    least = _slide_min(grams, size - gram + 1)
    last = np.repeat(at[1:], np.diff(at))[: len(least)] - size
    start = np.flatnonzero(np.arange(len(least)) <= last)
    key = text.mix(least[start], 3)  # least values are small numbers; their bits are spread anew
    row = text.row_of(start, at)
    fresh = np.ones(len(start), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(fresh)
    many = np.diff(np.append(begin, len(start)))
    if (many > _MOST_STARTS).any():
        parts = -(-many // _MOST_STARTS)
        offset = text.ranges(np.zeros(len(parts), np.int64), parts) * _MOST_STARTS
        many = np.minimum(np.repeat(many, parts) - offset, _MOST_STARTS)
        begin = np.repeat(begin, parts) + offset
    return row[begin], start[begin], many, key[begin], grams


def _repeats_inside(lo: np.ndarray, many: np.ndarray, key: np.ndarray, grams: np.ndarray, width: int) -> np.ndarray:
    """Windows that hold their least gram at two places or more: only those can repeat a string within themselves."""
    length = many + width - 1
    same = text.mix(grams[text.ranges(lo, length)], 3) == np.repeat(key, length)
    return np.add.reduceat(same, np.cumsum(length) - length) > 1 if len(lo) else np.empty(0, bool)


def _mark_blocks(size: int, gram: int, bucket_bits: int):
    """Packed keys by bucket: once for each step of text, or twice if they occur there more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, at in text.steps(batches):
            _, lo, many, key, grams = windows(data, at, size, gram)
            if not len(key):
                continue
            twice = _repeats_inside(lo, many, key, grams, size - gram + 1)
            keys, count = np.unique(np.concatenate((key, key[twice])), return_counts=True)
            keys = np.repeat(keys, np.minimum(count, 2))
            bucket = (keys >> np.uint64(64 - bucket_bits)).astype(np.int32)
            cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]]), text.binary([keys[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)])], ["bucket", "keys"])

    return run, "bucket int, keys binary"


def _mark(table_bits: int, bucket_bits: int):
    """The slots of repeated keys, bucket by bucket, as sorted 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def slots(bucket: int, held: list[np.ndarray]) -> pa.RecordBatch:
            keys = np.sort(np.concatenate(held))
            found = np.unique(keys[1:][keys[1:] == keys[:-1]] >> np.uint64(64 - table_bits)).astype(np.uint32)
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), text.binary([found.tobytes()])], ["bucket", "slots"])

        now, held = -1, []
        for batch in batches:
            for bucket, keys in zip(batch.column("bucket").to_pylist(), batch.column("keys"), strict=True):
                if held and bucket != now:
                    yield slots(now, held)
                    held = []
                now = bucket
                held.append(np.frombuffer(keys.as_py(), np.uint64))
        if held:
            yield slots(now, held)

    return run, "bucket int, slots binary"


_FOUND = "doc_id long, part long, lo long, n long, seg long, key long, inside boolean, same long, check long, body binary"
_OWN = ["doc_id", "part"]


def _candidates(size: int, gram: int, table_bits: int, table):
    """Windows whose key may repeat, without a body, and the segments that they cover, without a key."""
    names = ["doc_id", "part", "lo", "n", "seg", "key", "inside", "same", "check", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for batch, data, at in text.steps(batches):
            row, lo, many, key, grams = windows(data, at, size, gram)
            docs, part = batch.column("doc_id"), batch.column("part")
            slot = (key >> np.uint64(64 - table_bits)).astype(np.int64)
            use = np.flatnonzero((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
            if not len(use):
                continue
            row, lo, many, key = row[use], lo[use], many[use], key[use]
            inside = _repeats_inside(lo, many, key, grams, size - gram + 1)
            end = lo + many + size - 1
            same, check = text.hashes(data, lo, end, 40)
            place = lo - at[row]
            fresh = np.ones(len(row), bool)
            fresh[1:] = (row[1:] != row[:-1]) | (lo[1:] > end[:-1]) | (place[1:] // SEGMENT != place[:-1] // SEGMENT)
            first = np.flatnonzero(fresh)
            seg = place[first][np.cumsum(fresh) - 1]
            none = lambda kind, n: pa.nulls(n, kind)
            pick = pa.array(row)
            yield pa.RecordBatch.from_arrays([docs.take(pick), part.take(pick), pa.array(place), pa.array(many), pa.array(seg), pa.array(key.view(np.int64)), pa.array(inside), pa.array(same.view(np.int64)), pa.array(check.view(np.int64)), none(pa.binary(), len(row))], names)
            stop = end[np.append(first[1:], len(row)) - 1]
            row, lo, place = row[first], lo[first], place[first]
            pick, n = pa.array(row), len(row)
            yield pa.RecordBatch.from_arrays([docs.take(pick), part.take(pick), pa.array(place), pa.array(stop - lo), pa.array(place), none(pa.int64(), n), none(pa.bool_(), n), none(pa.int64(), n), none(pa.int64(), n), text.cut(data, lo, stop).cast(pa.binary())], names)

    return run


_WINDOW = "key long, n long, doc_id long, part long, lo long, inside boolean, groups long, body binary"


def _bodies(size: int):
    """The wanted windows' texts, cut from their segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in text.steps(batches, column="body"):
            wanted = batch.column("wanted")
            flat = wanted.flatten()
            row = np.repeat(np.arange(batch.num_rows), wanted.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            lo, many = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lo", "n"))
            start = at[row] + lo - batch.column("seg").to_numpy()[row]
            body = text.cut(data, start, start + many + size - 1).cast(pa.binary())
            own = [batch.column(c).take(pa.array(row)) for c in _OWN]
            yield pa.RecordBatch.from_arrays([flat.field("key"), flat.field("n"), *own, flat.field("lo"), flat.field("inside"), flat.field("groups"), body], ["key", "n", *_OWN, "lo", "inside", "groups", "body"])

    return run, _WINDOW


def _single_starts(size: int):
    """Windows as starts of their own, with a second key in the first; of equal strings in a step only the first, the others as spans (n is then 0).

    Equal strings of one key have equal second keys, so none is parted from another.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in text.steps(batches, text.STEP_BYTES // 8, "body"):
            key, many, docs, part, lo, groups = (batch.column(c).to_numpy() for c in ("key", "n", "doc_id", "part", "lo", "groups"))
            start = text.ranges(at[:-1], many)
            row, place = np.repeat(np.arange(len(many)), many), text.ranges(lo, many)
            body = text.cut(data, start, start + size)
            number = body.dictionary_encode().indices.to_numpy()
            order = np.lexsort((place, part[row], docs[row], number, key[row]))
            again = np.zeros(len(order), bool)
            again[1:] = (number[order][1:] == number[order][:-1]) & (key[row][order][1:] == key[row][order][:-1])
            deal = (text.hashes(data, start, start + size, 61)[0] % groups[row].astype(np.uint64)).astype(np.uint64)
            second = text.mix(key[row].view(np.uint64) ^ text.mix(deal, 71), 72).view(np.int64)
            for which, n in ((order[~again], 1), (order[again], 0)):
                r, k = row[which], len(which)
                rest = body.take(pa.array(which)).cast(pa.binary()) if n else pa.nulls(k, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(second[which]), pa.array(np.full(k, n)), pa.array(docs[r]), pa.array(part[r]), pa.array(place[which]), pa.array(np.zeros(k, bool)), pa.array(np.ones(k, np.int64)), rest], ["key", "n", *_OWN, "lo", "inside", "groups", "body"])

    return run, _WINDOW


def two_stage_sort(codes: np.ndarray, take: np.ndarray, depth: int) -> np.ndarray:
    """The positions where `take` holds, by the order of their suffixes to a depth of at least `depth` codes.

    codes: 0 ends a window, bytes are 1..256. A taken suffix that is larger than its successor needs the successor taken.
    """
    n = len(codes)
    change = np.flatnonzero(np.append(codes[1:] != codes[:-1], True))
    nearest = change[np.searchsorted(change, np.arange(n))]  # the last place of each run of one code
    rises = np.zeros(n, bool)
    inner = nearest < n - 1
    rises[inner] = codes[nearest[inner] + 1] > codes[nearest[inner]]
    # seven codes of nine bits in a word
    padded = np.concatenate((codes, np.zeros(depth + 14, codes.dtype))).astype(np.uint64)
    word = np.zeros(n + depth + 7, np.uint64)
    for i in range(7):
        word |= padded[i : i + len(word)] << np.uint64(9 * (6 - i))
    small = np.flatnonzero(take & rises)
    small = small[np.argsort(word[small], kind="stable")]
    group = np.cumsum(np.concatenate(([0], word[small[1:]] != word[small[:-1]]))) if len(small) else np.empty(0, np.int64)
    for step in range(7, depth + 7, 7):
        if not len(small):
            break
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        w = word[small[tied] + step]
        order = np.lexsort((w, group[tied]))
        small[tied], w, g = small[tied][order], w[order], group[tied]
        split = np.zeros(len(small), np.int64)
        split[tied[1:]] = (w[1:] != w[:-1]) & (g[1:] == g[:-1])
        group = group + np.cumsum(split)
    falls = take & ~rises
    fixed = np.searchsorted(codes[small], np.arange(258))
    lists: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []
    # falling suffixes whose successor isn't taken (or doesn't exist) start with 0: nothing is compared beyond a window's end
    lone = np.flatnonzero(falls & (codes == 0))
    lists[0].append(lone)
    for c in range(257):
        part = lists[c]
        wave = np.concatenate(part) if part else np.empty(0, np.int64)
        part = [wave]
        while len(wave):
            before = wave[wave > 0] - 1
            wave = before[falls[before] & (codes[before] == c) & (c > 0)]
            part.append(wave)
        whole = np.concatenate([*part, small[fixed[c] : fixed[c + 1]]])
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[falls[before] & (codes[before] > c)]
        if len(before):
            head = codes[before]
            order = np.argsort(head, kind="stable")
            before, head = before[order], head[order]
            cut = np.flatnonzero(np.concatenate(([True], head[1:] != head[:-1], [True])))
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                lists[head[i]].append(before[i:j])
    return np.concatenate(out)


def common_prefixes(codes: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix lengths, up to `limit`, of each position in `order` with the one before it; the first has 0."""
    padded = np.concatenate((codes, np.zeros(limit + 8, codes.dtype)))
    out = np.zeros(len(order), np.int64)
    going = np.arange(1, len(order))
    for i in range(limit):
        if i % 8 == 0 and not len(going):
            break
        going = going[padded[order[going] + i] == padded[order[going - 1] + i]]
        out[going] += 1
    return out


def repeated_starts(bodies: np.ndarray, ends: np.ndarray, many: np.ndarray, size: int) -> np.ndarray:
    """For windows in the order of documents and, within them, of lo: for each start, window after window, whether its string starts earlier among them."""
    lengths = np.diff(ends)
    n_windows = len(many)
    codes = np.zeros(len(bodies) + n_windows, np.uint16)
    shift = np.arange(n_windows)
    first = ends[:-1] + shift
    codes[text.ranges(first, lengths)] = bodies.astype(np.uint16) + 1
    starts = text.ranges(first, many)
    take = np.zeros(len(codes), bool)
    take[starts] = True
    # a falling suffix is induced from its successor: go on to the first that rises, or the window's end
    end_of = first + lengths
    more = first + many - 1
    while True:
        open_ = more < end_of
        more = more[open_]
        end_of = end_of[open_]
        if not len(more):
            break
        falling = codes[more] >= codes[more + 1]
        more, end_of = more[falling] + 1, end_of[falling]
        take[more] = True
    order = two_stage_sort(codes, take, size)
    wanted = np.zeros(len(codes), bool)
    wanted[starts] = True
    order = order[wanted[order]]
    equal = common_prefixes(codes, order, size) >= size
    begin = np.flatnonzero(~equal)
    earliest = np.minimum.reduceat(order, begin) if len(order) else order
    repeated = np.zeros(len(codes), bool)
    repeated[order] = order > np.repeat(earliest, np.diff(np.append(begin, len(order))))
    return repeated[starts]


def _spans_of(docs: np.ndarray, part: np.ndarray, lo: np.ndarray, many: np.ndarray, repeated: np.ndarray, size: int) -> pa.RecordBatch:
    window = np.repeat(np.arange(len(many)), many)
    place = text.ranges(lo, many)
    window, place = window[repeated], place[repeated]
    fresh = np.ones(len(place), bool)
    fresh[1:] = (window[1:] != window[:-1]) | (place[1:] != place[:-1] + 1)
    begin = np.flatnonzero(fresh)
    last = np.append(begin[1:], len(place)) - 1 if len(place) else begin
    return pa.RecordBatch.from_arrays([pa.array(docs[window[begin]]), pa.array(part[window[begin]]), pa.array(place[begin]), pa.array(place[last] + size)], [*_OWN, "lo", "hi"])


def _sort_windows(size: int, chunk: int = 500_000):
    """Spans of repeats within the windows of each key; keys come in order."""

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key = rows.column("key").to_numpy()
        count = np.diff(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))))
        use = (np.repeat(count, count) > 1) | rows.column("inside").to_numpy()
        if not use.any():
            return
        rows = rows.filter(pa.array(use)).sort_by([("doc_id", "ascending"), ("part", "ascending"), ("lo", "ascending")])
        body, ends = text.column_bytes(rows.column("body"))
        docs, part, lo, many = (rows.column(c).to_numpy().astype(np.int64) for c in (*_OWN, "lo", "n"))
        yield _spans_of(docs, part, lo, many, repeated_starts(body, ends, many, size), size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        bulk = 0
        for batch in batches:
            while batch.num_rows:
                held.append(batch)
                bulk += batch.get_total_buffer_size()
                if bulk < chunk:
                    break
                rows = pa.Table.from_batches(held)
                key = rows.column("key").to_numpy()
                whole = int(np.searchsorted(key != key[-1], False)) if key[0] == key[-1] else int(np.flatnonzero(key != key[-1])[-1]) + 1
                if whole:
                    yield from solve(rows.slice(0, whole))
                rest = rows.slice(whole).combine_chunks().to_batches(max_chunksize=1 << 30)
                held, bulk = rest, 0
                break
        if held:
            yield from solve(pa.Table.from_batches(held))

    return run


def repeat_spans(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """(doc_id, part, lo, hi): byte ranges whose union is what is to be removed; part is the xxhash64 of the text."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("part"), "text").where("doc_id is not null")
    bucket_bits = max(6, (4 * tables.shuffle_partitions(spark) - 1).bit_length())
    blocks, blocked = _mark_blocks(size, gram, bucket_bits)
    mark, marked = _mark(TABLE_BITS, bucket_bits)
    bits = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
    for row in docs.mapInArrow(blocks, blocked).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(mark, marked).toLocalIterator():  # slots of a table of fixed size
        slots = np.frombuffer(row["slots"], np.uint32)
        np.bitwise_or.at(bits, slots >> 3, np.uint8(1) << (slots & 7).astype(np.uint8))
    table = spark.sparkContext.broadcast(bits)
    found = tables.keep(docs.mapInArrow(_candidates(size, gram, TABLE_BITS, table), _FOUND))
    bytes_of = ["key", "same", "check", "n"]
    thin = found.where("key is not null").select(*bytes_of, "doc_id", "part", "lo", "seg", "inside")
    first = F.min(F.struct("doc_id", "part", "lo", "seg")).alias("first")
    firsts = tables.keep(thin.groupBy(*bytes_of).agg(first, F.max("inside").alias("inside"), F.count("*").alias("copies")).select(*bytes_of, "first.*", "inside", "copies"))
    copied = firsts.where("copies > 1").select(*bytes_of, F.col("doc_id").alias("d"), F.col("part").alias("p"), F.col("lo").alias("l"))
    again = thin.join(copied, bytes_of).where("doc_id <> d or part <> p or lo <> l")
    spans = again.select("doc_id", "part", "lo", (F.col("lo") + F.col("n") - 1 + size).alias("hi"))
    kinds = firsts.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("n").alias("starts"), F.max("inside").alias("any")).where("kinds > 1 or any").select("key", F.ceil(F.col("starts") / GROUP).alias("groups"))
    wanted = firsts.join(kinds, "key").groupBy("doc_id", "part", "seg").agg(F.collect_list(F.struct("key", "n", "lo", "inside", "groups")).alias("wanted"))
    segments = found.where("key is null").select("doc_id", "part", "seg", "body").dropDuplicates(["doc_id", "part", "seg"])
    texts = tables.keep(segments.join(wanted, ["doc_id", "part", "seg"]).mapInArrow(*_bodies(size)))
    singles = tables.keep(texts.where("groups > 1").mapInArrow(*_single_starts(size)))
    spans = spans.union(singles.where("n = 0").select("doc_id", "part", "lo", (F.col("lo") + size).alias("hi")))
    windowed = texts.where("groups = 1").union(singles.where("n = 1")).select("key", "n", "doc_id", "part", "lo", "inside", "body")
    return spans.union(windowed.repartition("key").sortWithinPartitions("key").mapInArrow(_sort_windows(size), "doc_id long, part long, lo long, hi long"))


def _cut(names: list[str], found: str, as_text: bool, added: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in text.steps(batches):
            delta = np.zeros(len(data) + 1, np.int64)
            spans = batch.column(found)
            flat = spans.flatten()
            many = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            base, top = np.repeat(at[:-1], many), np.repeat(at[1:], many)
            np.add.at(delta, np.minimum(base + flat.field("lo").to_numpy(zero_copy_only=False).astype(np.int64), top), 1)
            np.add.at(delta, np.minimum(base + flat.field("hi").to_numpy(zero_copy_only=False).astype(np.int64), top), -1)
            gone = np.cumsum(delta[:-1]) > 0
            starts, _ = text.runs(gone, at)
            n_rows = len(at) - 1
            n_spans = np.bincount(text.row_of(starts, at), minlength=n_rows)
            total = np.concatenate(([0], np.cumsum(gone)))
            removed = total[at[1:]] - total[at[:-1]]
            body = data[~gone]
            cuts = np.concatenate(([0], np.cumsum(np.diff(at) - removed)))
            if as_text:
                kept = pa.array([bytes(body[i:j]).decode("utf-8", "ignore") for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.string())
            else:
                kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n_rows, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body))]).cast(pa.binary())
            columns = [kept if as_text and c == "text" else batch.column(c) for c in names if c != "text" or as_text]
            extra = [pa.array(np.diff(at)), pa.array(removed), pa.array(n_spans)] + ([] if as_text else [kept])
            labels = [c for c in names if c != "text" or as_text]
            yield pa.RecordBatch.from_arrays([*columns, *extra], [*labels, *added])

    return run


def drop_repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM, as_text: bool = False, added: tuple[str, str, str, str] = ADDED) -> DataFrame:
    """docs without `text`, with the columns `added`, n_bytes, n_removed, n_spans and kept (the bytes that stay), at the end; columns of these names, in any case, are replaced.

    as_text: with `text` cut instead of `kept`, which isn't added then; a character of which only some bytes stay is left out.
    """
    new = list(added[:3] if as_text else added)
    spans, found, doc, part = repeat_spans(docs, size, gram), *(tables.unused(docs, c) for c in ("spans", "spans_doc", "spans_text"))
    by_doc = tables.keep(spans.groupBy(F.col("doc_id").alias(doc), F.col("part").alias(part)).agg(F.collect_list(F.struct("lo", "hi")).alias(found)))
    names = [c for c in docs.columns if c.lower() not in {a.lower() for a in new}]
    joined = docs.join(by_doc, (F.col("doc_id").cast("long") == F.col(doc)) & (F.xxhash64("text") == F.col(part)), "left").select(*(docs[c] for c in names), found)
    fields = [f for f in docs.schema.fields if f.name in names and (as_text or f.name != "text")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + "".join(f", `{c}` {t}" for c, t in zip(new, ("long", "long", "long", "binary"), strict=False))
    return joined.mapInArrow(_cut(names, found, as_text, new), schema)
