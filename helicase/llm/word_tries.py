"""Resampling of documents towards a target's distribution of hashed n-grams, counted and scored over word tries.

A task keeps a trie of the word sequences it has met: a node stands for the words on its path and holds their count and the
state of the CRC that its words, joined by one space, have led to, so a child's CRC goes on from its parent's and no
n-gram is ever written out. At the task's end, or when its trie has grown to NODES, the nodes' counts are added to the totals of their
buckets; the totals of all tasks are summed by an aggregation, and the driver turns them into a gain for each bucket. In a second
pass new nodes get their bucket's gain attached, and a document is scored by the nodes on the paths from each of its
words. Then each document's Gumbel key, from a hash of its id, is added to its score, and the highest are drawn.

A word: `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` once A-Z are in lower case.

Edge cases: a null or empty text, or one without words, has no features and weight 0; an empty table gives an empty
result; without target texts every bucket's gain follows from the documents alone; rows that share a doc_id are scored and drawn one by
one, ties going to the smaller hash of the text; a null doc_id counts as the empty string in the hash and comes last among ties.
Texts of any length are walked whole. Carried columns keep their names and values, whatever they are called: an added column whose name is
taken gets underscores.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.derep import numbered
from . import tables, text

BUCKETS, PERCENT, LEAST_WORDS = 10_000, 10, 20
#: Nodes at which a task's trie is given up for a new one.
NODES = 500_000


class Trie:
    """Nodes of word sequences; node 0 is the root."""

    def __init__(self, gains: np.ndarray | None = None):
        self._gains = gains
        self._words: dict[bytes, int] = {}
        self._spelled: list[bytes] = []
        self._child: dict[int, int] = {}
        self._state: list[int] = [0]
        self.count = np.zeros(1, np.int64)
        self.gain = np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self._state)

    def words(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The number of each word."""
        at, spelled = text.distinct(data, starts, stops)
        number = [self._words.setdefault(w, len(self._words)) for w in spelled]
        self._spelled.extend(w for w, i in zip(spelled, number, strict=True) if i >= len(self._spelled))
        return np.array(number, np.int64)[at]

    def step(self, nodes: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The children of `nodes` by `words`; those that don't exist yet are made."""
        keys, at = np.unique(nodes << 32 | words, return_inverse=True)
        found = [self._child.get(k, -1) for k in keys.tolist()]
        for i, (k, child) in enumerate(zip(keys.tolist(), found, strict=True)):
            if child < 0:
                parent, word = k >> 32, self._spelled[k & 0xFFFFFFFF]
                found[i] = self._child[k] = len(self._state)
                self._state.append(zlib.crc32(b" " + word if parent else word, self._state[parent]))
        fresh = np.array(self._state[len(self.count) :], np.int64)
        self.count = np.concatenate((self.count, np.zeros(len(fresh), np.int64)))
        if self._gains is not None:
            self.gain = np.concatenate((self.gain, self._gains[fresh % len(self._gains)]))
        return np.array(found, np.int64)[at]

    def totals(self, buckets: int) -> np.ndarray:
        """The nodes' counts by bucket."""
        out = np.zeros(buckets, np.int64)
        np.add.at(out, np.array(self._state[1:], np.int64) % buckets, self.count[1:])
        return out


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes and where words start and stop."""
    data = text.lower_ascii(data)
    return data, *text.runs((data >= 128) | (data >= 97) & (data <= 122) | (data >= 48) & (data <= 57), at)


def _paths(trie: Trie, data: np.ndarray, at: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each number of words up to `most` the nodes of all runs of so many words and the rows that hold them."""
    data, starts, stops = _words(data, at)
    words, row = trie.words(data, starts, stops), text.row_of(starts, at)
    nodes = np.zeros(len(words), np.int64)
    for n in range(most):
        if n:  # a run goes on where another word of the row follows
            more = np.flatnonzero(row[: len(row) - n] == row[n:])
            nodes, kept = nodes[more], more
        else:
            kept = np.arange(len(words))
        if not len(kept):
            return
        nodes = trie.step(nodes, words[kept + n])
        yield nodes, row[kept]
        if len(kept) < len(words):  # runs by their first word, for the next round
            full = np.zeros(len(words), np.int64)
            full[kept] = nodes
            nodes = full


def bucket_totals(docs: DataFrame, most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): the features of all documents in each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, total = Trie(), np.zeros(buckets, np.int64)
        for _, data, at in text.steps(batches):
            for nodes, _row in _paths(trie, data, at, most):
                trie.count += np.bincount(nodes, minlength=len(trie))
            if len(trie) > NODES:
                total += trie.totals(buckets)
                trie = Trie()
        total += trie.totals(buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["bucket", "n"])

    return docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """For each bucket 1000 times the log of its smoothed share in the target over that in the documents, rounded down."""
    held = []
    for table in (docs, target):
        n = [0] * buckets
        for bucket, many in bucket_totals(table, most, buckets).collect():  # a row for each bucket
            n[bucket] = many
        held.append(n)
    s, t = held
    every_s, every_t = sum(s) + buckets, sum(t) + buckets
    return np.array([math.floor(1000 * math.log((t[b] + 1) * every_s / ((s[b] + 1) * every_t))) for b in range(buckets)], np.int64)


def scores(docs: DataFrame, gain: np.ndarray, most: int = 1, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The carried columns with n_words, n_features and weight, the mean gain of a document's features, rounded down."""
    names = [*carry, *([] if "text" in carry else ["text"])]
    part = docs.select(*names)
    added = [tables.unused(part, c) for c in ("n_words", "n_features", "weight")]
    place, text_at = len(carry), names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(gain)
        for whole in batches:
            plain = pa.RecordBatch.from_arrays([whole.column(text_at), pa.array(np.arange(whole.num_rows))], ["text", "row"])
            for batch, data, at in text.steps(iter([plain])):
                n = len(at) - 1
                many, total, words = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
                for length, (nodes, row) in enumerate(_paths(trie, data, at, most)):
                    many += np.bincount(row, minlength=n)
                    np.add.at(total, row, trie.gain[nodes])
                    if not length:
                        words = many.copy()
                rows = whole.slice(batch.column("row")[0].as_py(), n)
                yield pa.RecordBatch.from_arrays([*rows.columns[:place], pa.array(words), pa.array(many), pa.array(total // np.maximum(many, 1))], [*carry, *added])
                if len(trie) > NODES:
                    trie = Trie(gain)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema.fields[:place])
    return part.mapInArrow(run, f"{schema}, {added[0]} long, {added[1]} long, {added[2]} long")


def resample(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = 2024, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The carried columns of every document with n_words, n_features, weight, score and rank, from 1 for the highest score, null if not drawn.

    percent/100 of the documents of at least `least_words` words are drawn, rounded down; ties go to the smaller doc_id.
    """
    plain = docs.select(*dict.fromkeys(("doc_id", *carry, "text")))
    h, tie = tables.unused(plain, "h"), tables.unused(plain, "tie")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    marked = plain.withColumn(h, F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")).withColumn(tie, F.xxhash64("text"))
    held = list(dict.fromkeys(("doc_id", *carry, h, tie)))
    weighed = scores(marked, gains(docs, target, most, buckets), most, held)
    n_words, weight = weighed.columns[len(held)], weighed.columns[len(held) + 2]
    score, rank = tables.unused(weighed, "score"), tables.unused(weighed, "rank")
    key = F.floor(-1000 * F.log(-F.log((F.col(h) + 0.5) / 4294967296.0)))
    weighed = tables.keep(weighed.withColumn(score, F.col(weight) + key))
    fit = F.col(n_words) >= least_words
    drawn = weighed.where(fit).count() * percent // 100
    place = tables.unused(weighed, "place")
    placed = numbered(weighed, F.when(fit, 0).otherwise(1), F.desc(score), F.col("doc_id").asc_nulls_last(), tie, name=place)
    return placed.withColumn(rank, F.when(F.col(place) < drawn, F.col(place) + 1)).select(*carry, *weighed.columns[len(held) : len(held) + 3], score, rank)
