"""SentencePiece encoding and decoding over a table of distinct marked words.

White space is written as the mark U+2581 and one mark is put before the text. Where no piece of the vocabulary holds a
mark behind another character, no merge can cross from a word to the marks that follow it: a text falls apart into
chunks, each a run of marks and the characters up to the next run, whose segmentations don't depend on each other. So
each distinct chunk is segmented once, by the vocabulary's merges in the order of their scores, and the ids of all chunks are
joined back by position. The table of chunks belongs to a worker and is bounded by its bytes; a worker that is lost takes
nothing along but the work of its running task.

Models: byte-pair models with byte fallback, identity normalization, a mark before the text, and normal, byte and control
pieces only; other models raise ValueError, as does one with a piece that crosses marks.

Edge cases: a null or empty text has the end id alone, if ends are asked for, and decodes to the empty string; texts of any
length are encoded whole, one without white space as a single chunk; repeated rows are encoded alike; doc_id is carried as it
is, null too; further columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import text

MARK = "▁"
_MARK = np.frombuffer(MARK.encode(), np.uint8)
#: Bytes of chunks and ids that a worker remembers; then it starts afresh.
MEMO_BYTES = 64_000_000


class Pieces:
    """A vocabulary: segments single chunks and turns ids back into bytes."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kind, normal = model.SentencePiece, model.normalizer_spec
        if model.trainer_spec.model_type != model.trainer_spec.BPE or not model.trainer_spec.byte_fallback or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("not a byte-pair model with byte fallback and marks in front")
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.add_dummy_prefix or not normal.escape_whitespaces:
            raise ValueError("a normalization other than marks for spaces and one in front")
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.byte = [0] * 256
        shown, self._blank, self._hidden, self._raw = [], [], [], []
        for i, p in enumerate(model.pieces):
            out = b""
            if p.type == kind.NORMAL:
                if MARK in p.piece.lstrip(MARK):
                    raise ValueError(f"a piece that crosses marks: {p.piece!r}")
                self.ids[p.piece], self.rank[p.piece] = i, -p.score
                out = p.piece.replace(MARK, " ").encode()
            elif p.type == kind.BYTE:
                self.byte[int(p.piece[3:5], 16)] = i
                out = bytes([int(p.piece[3:5], 16)])
            elif p.type == kind.UNKNOWN:
                out = model.trainer_spec.unk_surface.encode()
            elif p.type != kind.CONTROL:
                raise ValueError(f"a piece of another kind: {p.piece!r}")
            shown.append(out)
            self._blank.append(p.type == kind.NORMAL and p.piece.startswith(MARK))
            self._hidden.append(p.type == kind.CONTROL)
            self._raw.append(p.type == kind.BYTE)
        self.end = next(i for i, p in enumerate(model.pieces) if p.piece == (model.trainer_spec.eos_piece or "</s>"))
        self._size = np.array([len(s) for s in shown], np.int64)
        self._first = np.cumsum(self._size) - self._size
        self._bytes = np.frombuffer(b"".join(shown), np.uint8)
        self._blank, self._hidden, self._raw = np.array(self._blank), np.array(self._hidden), np.array(self._raw)
        self._memo: dict[bytes, list[int]] = {}
        self._held = 0

    def segment(self, chunk: str) -> list[int]:
        """Ids of one chunk: of all neighbours whose union is a piece those of the best score are merged, the leftmost first."""
        n = len(chunk)
        rank = self.rank.get
        stop = list(range(1, n + 1))  # where the symbol that starts here stops
        before = list(range(-1, n - 1))
        agenda = [(r, i, i + 2) for i in range(n - 1) if (r := rank(chunk[i : i + 2])) is not None]
        heapify(agenda)
        while agenda:
            _, i, k = heappop(agenda)
            j = stop[i]
            if not i < j < k or stop[j] != k:
                continue  # a symbol of the pair has been merged since
            stop[i], stop[j] = k, 0
            if k < n:
                before[k] = i
                if (r := rank(chunk[i : stop[k]])) is not None:
                    heappush(agenda, (r, i, stop[k]))
            p = before[i]
            if p >= 0 and (r := rank(chunk[p:k])) is not None:
                heappush(agenda, (r, p, k))
        out, i = [], 0
        while i < n:
            symbol = chunk[i : stop[i]]
            known = self.ids.get(symbol)
            if known is None:
                out.extend(self.byte[b] for b in symbol.encode())
            else:
                out.append(known)
            i = stop[i]
        return out

    def _looked_up(self, chunks: list[bytes]) -> list[list[int]]:
        """Ids of distinct chunks, from the table where it has them."""
        if self._held > MEMO_BYTES:
            self._memo, self._held = {}, 0
        found = [self._memo.get(c) for c in chunks]
        for i, ids in enumerate(found):
            if ids is None:
                found[i] = self._memo[chunks[i]] = ids = self.segment(chunks[i].decode())
                self._held += 200 + len(chunks[i]) + 8 * len(ids)  # about what the entry takes
        return found

    def encode(self, data: np.ndarray, at: np.ndarray, end: bool) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids, one after the other, and each row's number of ids."""
        data, at = marked(data, at)
        starts, stops = chunks(data, at)
        number, words = text.distinct(data, starts, stops)
        ids = self._looked_up(words)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))
        flat = flat[text.ranges((np.cumsum(size) - size)[number], size[number])]
        ends = np.concatenate(([0], np.cumsum(size[number])))[np.searchsorted(starts, at)]
        counts = np.diff(ends)
        return (np.insert(flat, ends[1:], self.end).astype(np.int32), counts + 1) if end else (flat, counts)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows and their offsets: marks become spaces but for the one in front; bytes that form no character become U+FFFD each."""
        size, first = self._size[ids], self._first[ids]
        at = np.concatenate(([0], np.cumsum(counts)))
        seen = np.flatnonzero(~self._hidden[ids])
        lead = np.searchsorted(seen, at[:-1])  # each row's first piece that shows
        lead = seen[lead[lead < len(seen)]]
        lead = np.unique(lead)[self._blank[ids[np.unique(lead)]]]
        size[lead] -= 1
        first[lead] += 1
        data = self._bytes[text.ranges(first, size)]
        ends = np.concatenate(([0], np.cumsum(size)))
        try:
            data.tobytes().decode()
        except UnicodeDecodeError:
            return self._mended(data, ends, self._raw[ids], at)
        return data, ends[at]

    @staticmethod
    def _mended(data: np.ndarray, ends: np.ndarray, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole, rows = data.tobytes(), []
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            edge = np.flatnonzero(np.diff(raw[i:j])) + i + 1
            cuts = [i, *edge.tolist(), j]
            rows.append(b"".join(_characters(whole[ends[a] : ends[b]]) if a < b and raw[a] else whole[ends[a] : ends[b]] for a, b in zip(cuts[:-1], cuts[1:], strict=True)))
        return np.frombuffer(b"".join(rows), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)


def _characters(run: bytes) -> bytes:
    out, i = [], 0
    while i < len(run):
        for n in (1, 2, 3, 4):
            try:
                run[i : i + n].decode()
            except UnicodeDecodeError:
                continue
            out.append(run[i : i + n])
            i += n
            break
        else:
            out.append("�".encode())
            i += 1
    return b"".join(out)


def marked(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows with marks for spaces and one more in front of each that isn't empty."""
    full = np.flatnonzero(np.diff(at))
    size = np.where(data == 32, 3, 1)
    size[at[full]] += 3
    ends = np.concatenate(([0], np.cumsum(size)))
    out = np.empty(ends[-1], np.uint8)
    space = data == 32
    out[ends[1:] - 1] = data  # a byte's own place is the last of its places
    for back, b in enumerate(_MARK[::-1]):
        out[ends[1:][space] - 1 - back] = b
    for forth, b in enumerate(_MARK):
        out[ends[at[full]] + forth] = b
    return out, ends[at]


def chunks(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks start and stop: at each run of marks, and at each row's begin."""
    mark = np.zeros(len(data) + 3, bool)
    if len(data) > 2:
        mark[3 : len(data) + 1] = (data[:-2] == _MARK[0]) & (data[1:-1] == _MARK[1]) & (data[2:] == _MARK[2])
    start = mark[3:] & ~mark[: len(data)]  # a mark is three bytes
    start[at[:-1][np.diff(at) > 0]] = True
    starts = np.flatnonzero(start)
    return starts, np.append(starts[1:], len(data))[: len(starts)]


@functools.cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values.astype(np.int32)))


def encode(docs: DataFrame, path: str, end: bool = True, decode: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids): ids as the library gives them, with the end id if asked for; with decode also `decoded`, the text that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(path)
        for batch, data, at in text.steps(batches):
            ids, counts = table.encode(data, at, end)
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(counts.astype(np.int64)), _lists(ids, counts)]
            if decode:
                columns.append(text.text_rows(*table.decode(ids, counts)))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"][: len(columns)])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>" + ", decoded string" * decode)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, decoded) from the ids of encode(); null ids decode to the empty string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(path)
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                lists = batch.column("ids").fill_null([])
                counts = lists.value_lengths().to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), text.text_rows(*table.decode(lists.flatten().to_numpy(), counts))], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")
