"""MinHash near-duplicates by min-max hashing.

Each of `permutations` hash functions is evaluated once for each shingle and gives two signature values, the
smallest and the largest image; bands of `rows` values take both kinds in turn. Documents that share a band
become candidates, and every link is confirmed on the full shingle sets.

A document's set: its distinct word shingles, words being `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a text of
fewer words is one shingle; no words or a null text give the empty set, which is linked with nothing.

Copies with the same set are collapsed by an aggregation before any pair is formed. In each band's bucket the
members are first compared with one of them only, the one whose buckets hold most members in all (in a family of edited
copies that is the original or close to it). After components are known, pairs that share a bucket across different
components are compared, but for those that cannot be linked: each document counts, in CLASSES classes of shingles,
those that occur in another document still in question; the classes' smaller counts bound what two documents share, and
a link needs 80 * (n + n') <= 180 * that bound. Members that no size in their bucket satisfies go before pairs are
formed. So no link between two components is lost, and no bucket is expanded into all its pairs.

Edge cases: an empty table gives an empty result; a repeated doc_id counts as copies; rows whose doc_id is null
are left out; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables, text

PERMUTATIONS, ROWS, CLASSES = 64, 4, 32
#: About as many shingles are counted at once.
BUCKET = 1 << 18


def shingles(data: np.ndarray, at: np.ndarray, words: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one after the other, and each row's count."""
    starts, stops = text.runs(~text.is_space(data), at)
    n_rows = len(at) - 1
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(n_rows, np.int64)
    word = text.hashes(text.lower_ascii(data), starts, stops, seed)[0]
    row = text.row_of(starts, at)
    count = np.bincount(row, minlength=n_rows)
    first = np.cumsum(count) - count
    size = np.maximum(1, count - words + 1) * (count > 0)
    begin = text.ranges(first, size)
    owner = np.repeat(np.arange(n_rows), size)
    used = np.minimum(words, count[owner])
    h = np.zeros(len(begin), np.uint64)
    for j in range(words):
        there = j < used
        h[there] = text.mix(h[there] ^ word[begin[there] + j], j + 2)
    h = text.mix(h + used.astype(np.uint64), 17)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[fresh], np.bincount(owner[fresh], minlength=n_rows)


def signatures(sets: np.ndarray, counts: np.ndarray, permutations: int) -> np.ndarray:
    """Rows of 2 * permutations values: the minimum and the maximum under each; for non-empty sets only."""
    starts = (np.cumsum(counts) - counts)[counts > 0]
    out = np.empty((len(starts), 2 * permutations), np.uint64)
    for k in range(permutations):
        image = (sets ^ (sets >> np.uint64(32))) * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 3) ** 9 | 1) % (1 << 64))
        out[:, 2 * k] = np.minimum.reduceat(image, starts)
        out[:, 2 * k + 1] = np.maximum.reduceat(image, starts)
    return out


def _sign(words: int, permutations: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in text.steps(batches):
            sets, counts = shingles(data, at, words)
            full = counts > 0
            sig = signatures(sets, counts, permutations) if full.any() else np.empty((0, 2 * permutations), np.uint64)
            bands = []
            for b in range(2 * permutations // rows):
                h = np.full(len(sig), b + 1, np.uint64)
                for j in range(rows):
                    h = text.mix(h ^ sig[:, b * rows + j], j)
                bands.append(h)
            bands = np.stack(bands, 1) if len(sig) else np.empty((0, 2 * permutations // rows), np.uint64)
            starts = (np.cumsum(counts) - counts)[full]
            names = [np.zeros(len(counts), np.uint64) for _ in range(2)]
            if len(starts):
                names[0][full] = text.mix(np.add.reduceat(text.mix(sets, 5), starts))
                names[1][full] = text.mix(np.bitwise_xor.reduceat(text.mix(sets, 6), starts) + counts[full].astype(np.uint64))
            offsets = np.concatenate(([0], np.cumsum(full * bands.shape[1]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(counts), pa.array(names[0].view(np.int64)), pa.array(names[1].view(np.int64)), lists], schema=schema)

    return run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"


def _verify(words: int, percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, left_at = text.column_bytes(batch.column("text_a"))
            right, right_at = text.column_bytes(batch.column("text_b"))
            i, n = 0, batch.num_rows
            while i < n:
                j = i + 1
                while j < n and left_at[j + 1] - left_at[i] + right_at[j + 1] - right_at[i] < 2 * text.STEP_BYTES:
                    j += 1
                sa, ca = shingles(left[left_at[i] : left_at[j]], left_at[i : j + 1] - left_at[i], words, 2)
                sb, cb = shingles(right[right_at[i] : right_at[j]], right_at[i : j + 1] - right_at[i], words, 2)
                row = np.concatenate((np.repeat(np.arange(j - i), ca), np.repeat(np.arange(j - i), cb)))
                both = np.concatenate((sa, sb))
                order = np.lexsort((both, row))
                both, row = both[order], row[order]
                same = (both[1:] == both[:-1]) & (row[1:] == row[:-1])
                common = np.bincount(row[1:][same], minlength=j - i)
                linked = (100 * common >= percent * (ca + cb - common)) & (ca > 0) & (cb > 0)
                yield pa.RecordBatch.from_arrays([batch.column("a").slice(i, j - i), batch.column("b").slice(i, j - i), pa.array(linked)], schema=schema)
                i = j

    return run, "a long, b long, linked boolean"


def _pack_shingles(words: int, buckets: int):
    """Packed shingles by bucket: those of one document of the batch with it, those of several once, as shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in text.steps(batches):
            sets, counts = shingles(data, at, words)
            ids = batch.column("doc_id").to_numpy()
            owner = np.repeat(np.arange(len(counts)), counts)
            order = np.argsort(sets, kind="stable")
            h, owner = sets[order], owner[order]
            begin = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)
            many = np.diff(np.append(begin, len(h)))
            several = np.repeat(many > 1, many)
            place = owner[several] * CLASSES + (h[several] % np.uint64(CLASSES)).astype(np.int64)
            shared = np.bincount(place, minlength=len(counts) * CLASSES)
            h, owner, several = h[begin], ids[owner[begin]], many > 1
            bucket = (h % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            h, owner, several, bucket = h[order], owner[order], several[order], bucket[order]
            cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(h) else np.zeros(1, np.int64)
            pairs = list(zip(cut[:-1], cut[1:], strict=True))
            rows = [(int(bucket[i]), h[i:j].tobytes(), owner[i:j].tobytes(), several[i:j].tobytes(), b"", b"") for i, j in pairs]
            rows.append((int(ids[0] % buckets), b"", b"", b"", ids.tobytes(), shared.astype(np.int64).tobytes()))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(text.binary(c) for c in columns[1:])], ["bucket", "shingles", "docs", "several", "known", "counts"])

    return run, "bucket int, shingles binary, docs binary, several binary, known binary, counts binary"


_SHARED = [f"s{c}" for c in range(CLASSES)]


def _count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, class, n): how many of the documents' shingles of a class occur in others, in a bucket or in a batch of documents."""

    def rows(ids: np.ndarray, kinds: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(kinds.astype(np.int32)), pa.array(counts)], ["doc_id", "class", "n"])

    for bucket, held in _groups(batches, "bucket"):
        parts = []
        for r in held:
            known = np.frombuffer(r["known"], np.int64)
            if len(known):
                counts = np.frombuffer(r["counts"], np.int64)
                some = np.flatnonzero(counts)
                yield rows(known[some // CLASSES], some % CLASSES, counts[some])
            parts.append((np.frombuffer(r["shingles"], np.uint64), np.frombuffer(r["docs"], np.int64), np.frombuffer(r["several"], bool)))
        h, docs, several = (np.concatenate(x) for x in zip(*parts, strict=True))
        _, at = np.unique(h, return_inverse=True)
        shared = np.bincount(at, weights=1 + several) > 1
        ids, many = np.unique(docs[shared[at] & ~several], return_counts=True)
        yield rows(ids, np.full(len(ids), bucket % CLASSES), many)


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each key, one key after the other; the rows come in the order of the key."""
    now, held = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            if held and r[key] != now:
                yield now, held
                held = []
            now = r[key]
            held.append(r)
    if held:
        yield now, held


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): components over links of percent/100 Jaccard similarity or more.

    With 64 permutations and bands of 4 of their 128 values, a pair at similarity 0.8 shares no band with
    probability (1 - 0.8**4)**32, about 5e-8.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    run, schema = _sign(words, permutations, rows)
    signed = tables.keep(docs.mapInArrow(run, schema))
    sets = signed.where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"))
    reps = signed.where("n_shingles > 0").join(sets, (signed.doc_id == sets.rep) & (signed.set_a == sets.set_a) & (signed.set_b == sets.set_b), "left_semi").select("doc_id", F.explode("bands").alias("bucket")).distinct()
    sizes = reps.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = tables.keep(reps.join(sizes, "bucket"))
    weights = shared.groupBy("doc_id").agg(F.sum("n").alias("weight"))
    weighed = shared.select("bucket", "doc_id").join(weights, "doc_id")
    leaders = weighed.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("doc_id")).alias("id"))).alias("top")).select("bucket", (-F.col("top.id")).alias("leader"))
    members = shared.select("bucket", "doc_id")
    verify, verified = _verify(words, percent)

    def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
        right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
        # pairs grow with the documents: merged at every size, never broadcast
        return tables.keep(pairs.hint("merge").join(left, "a").hint("merge").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(verify, verified))

    stars = members.join(leaders, "bucket").where("doc_id <> leader").select(F.least("leader", "doc_id").alias("a"), F.greatest("leader", "doc_id").alias("b")).distinct()
    tried = confirm(stars, docs)
    links = tried.where("linked").select("a", "b")
    found = tables.components(links)
    labelled = tables.keep(members.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("component")))
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    open_members = tables.keep(labelled.join(mixed, "bucket", "left_semi").join(signed.select("doc_id", "n_shingles"), "doc_id"))
    volume = open_members.select("doc_id", "n_shingles").distinct().agg(F.sum("n_shingles")).first()[0]
    if volume:
        texts = tables.keep(docs.join(open_members.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi"))
        # buckets are a multiple of the classes, so that a bucket's shingles are of one class
        pack, packed = _pack_shingles(words, CLASSES * -(-volume // (CLASSES * BUCKET)))
        counted = texts.mapInArrow(pack, packed).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_count_shared, "doc_id long, class int, n long")
        # one row for each document, class and bucket or batch with shared shingles: no more than there are shingles
        common = counted.groupBy("doc_id").agg(*(F.sum(F.when(F.col("class") == c, F.col("n")).otherwise(0)).alias(s) for c, s in enumerate(_SHARED)))
        # the most shingles that a linked partner can have
        reach = F.floor(sum((F.col(c) for c in _SHARED), F.lit(0)) * (100 + percent) / percent) - F.col("n_shingles")
        able = open_members.join(common, "doc_id").withColumn("reach", reach)
        least = able.groupBy("bucket").agg(F.min("n_shingles").alias("least"))
        able = tables.keep(able.join(least, "bucket").where(F.col("reach") >= F.greatest(F.col("least"), F.ceil(F.col("n_shingles") * percent / 100))).select("bucket", "doc_id", "component", "n_shingles", "reach", *_SHARED))
        # of two components that share a bucket one isn't its largest: that side alone is the join's left
        held = able.groupBy("bucket", "component").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("top")).select("bucket", F.col("top.component").alias("largest"))
        minor = able.join(held, "bucket").where("component <> largest").drop("largest")
        other = able.select(F.col("bucket").alias("bucket_b"), *(F.col(c).alias(f"{c}_b") for c in ("doc_id", "component", "n_shingles", "reach", *_SHARED)))
        bound = " + ".join(f"least({c}, {c}_b)" for c in _SHARED)
        fits = f"component <> component_b and n_shingles <= reach_b and n_shingles_b <= reach and {100 + percent} * ({bound}) >= {percent} * (n_shingles + n_shingles_b)"
        across = minor.join(other, F.expr(f"bucket = bucket_b and {fits}"))
        across = across.select(F.least("doc_id", "doc_id_b").alias("a"), F.greatest("doc_id", "doc_id_b").alias("b")).distinct()
        more = confirm(across.join(tried.select("a", "b"), ["a", "b"], "left_anti"), texts).where("linked").select("a", "b")
        found = tables.components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).where("a <> b").union(more))
    classes = sets.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component_id"))
    rows_of = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(classes, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows_of.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))
