"""Quality classifier: linear support vectors over naive-Bayes-scaled n-gram indicators.

Features are indicators, hashed to 2**18 places: byte trigrams, words, and one to three successive word shapes (which
bytes a word holds, its length, whether it repeats the word before). Each is scaled by its class log-count ratio, rows
are brought to unit length, and a hinge-loss model is fitted by dual coordinate descent. A logistic curve over
out-of-fold margins turns margins into scores.

The fit takes at most SAMPLE labelled rows (those with the smallest hash of their doc_id); scoring takes every row.

Edge cases: empty, null and very long texts get a score; rows with a null label are no examples; a document with
two labels takes the lower; without examples of both classes every score is the share of label 1 (1.0 if there are
none); an empty table gives an empty result; labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text

#: Bound of the labelled rows that the fit reads.
SAMPLE = 12_000
PLACES, THRESHOLD = 1 << 18, 0.3


@dataclass
class Model:
    """For each place: `joint`, log-count ratio times weight, and `square`, the ratio's square."""

    joint: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    shift: float


def _features(data: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct feature places of each row."""
    n_rows = len(at) - 1
    starts, stops = text.runs(~text.is_space(data), at)
    low = text.lower_ascii(data)
    word = text.hashes(low, starts, stops, 1)[0]
    row = text.row_of(starts, at)
    kinds = [(data >= 65) & (data <= 90), (data >= 97) & (data <= 122), (data >= 48) & (data <= 57), data >= 128]
    held = np.zeros(len(starts), np.uint64)
    rest = (stops - starts).astype(np.int64)
    for i, kind in enumerate(kinds):
        total = np.concatenate(([0], np.cumsum(kind)))
        n = total[stops] - total[starts]
        held |= (np.minimum(n, 2) > 0).astype(np.uint64) << np.uint64(2 * i)
        if i == 0:
            held |= (n > 1).astype(np.uint64) << np.uint64(1)
        rest -= n
    held |= np.minimum(rest, 3).astype(np.uint64) << np.uint64(10)
    held |= np.minimum((stops - starts) // 4, 7).astype(np.uint64) << np.uint64(14)
    follows = np.zeros(len(starts), bool)
    follows[1:] = row[1:] == row[:-1]
    again = np.zeros(len(starts), bool)
    again[1:] = follows[1:] & (word[1:] == word[:-1])
    shape = [text.mix(held | again.astype(np.uint64) << np.uint64(20), 31)]
    grams, owners = [text.mix(word, 30), shape[0]], [row, row]
    alone = follows
    for n in (2, 3):
        joined = np.zeros(len(starts), np.uint64)
        joined[1:] = text.mix(shape[-1][:-1] ^ shape[0][1:] * np.uint64(3), 30 + n)
        whole = alone.copy()
        shape.append(joined)
        grams.append(joined[whole])
        owners.append(row[whole])
        alone = np.zeros(len(starts), bool)
        alone[1:] = follows[1:] & whole[:-1]
    thirds = text.rolling(low, 3)
    top = np.uint64(64 - 18)
    thirds = (thirds >> top).astype(np.int32)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    other = (np.concatenate(grams)[order] >> top).astype(np.int32)
    cut = np.searchsorted(owner[order], np.arange(n_rows + 1))
    last = np.zeros(PLACES, np.int32)
    for i in range(n_rows):
        f = np.concatenate((thirds[at[i] : max(at[i], at[i + 1] - 2)], other[cut[i] : cut[i + 1]]))
        n = np.arange(len(f), dtype=np.int32)
        last[f] = n
        yield f[last[f] == n]


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, at in text.steps(batches):
        found = [f.tobytes() for f in _features(data, at)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("label"), text.binary(found)], ["doc_id", "label", "features"])


def _length(square: np.ndarray, row: np.ndarray) -> float:
    return max(np.sqrt(square[row].sum(dtype=np.float64)), 1e-12)


def _descend(rows: list[np.ndarray], square: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 15) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss over rows of unit length; gives ratios times weights, and the bias.

    A row's values are the ratios of its places over its length. With the products kept in place of the weights no row's
    values are ever stored: their sum over a row's places is its margin, and a step adds squared ratios.
    """
    joint, bias, alpha = np.zeros(PLACES), 0.0, np.zeros(len(rows))
    length = np.array([_length(square, f) for f in rows])
    norm = np.array([square[f].sum() for f in rows]) / length**2 + 1.0
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            f = rows[i]
            slope = y[i] * (joint[f].sum() / length[i] + bias) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                joint[f] += step / length[i] * square[f]
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return joint, bias


def _logistic(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton's steps with a little shrinkage."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - label) * margin).sum() + 1e-2 * a, (p - label).sum()])
        d = p * (1 - p)
        h = np.array([[(d * margin * margin).sum() + 1e-2, (d * margin).sum()], [(d * margin).sum(), d.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    return a, b


def _fit_rows(rows: list[np.ndarray], label: np.ndarray, cost: float = 4.0) -> Model:
    def fit(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        counts = np.ones((2, PLACES))
        for i in part:
            counts[label[i]][rows[i]] += 1
        counts /= counts.sum(1, keepdims=True)
        square = np.log(counts[1] / counts[0]) ** 2
        share = label[part].mean()
        weight = np.where(label[part] == 1, 0.5 / share, 0.5 / (1 - share)) * cost
        joint, bias = _descend([rows[i] for i in part], square, np.where(label[part] == 1, 1.0, -1.0), weight)
        return joint, square, bias

    def margins(part: np.ndarray, joint: np.ndarray, square: np.ndarray, bias: float) -> np.ndarray:
        return np.array([joint[rows[i]].sum() / _length(square, rows[i]) + bias for i in part])

    everything = np.arange(len(rows))
    if len(set(label.tolist())) < 2:
        share = float(label.mean()) if len(label) else 1.0
        return Model(np.zeros(PLACES, np.float32), np.zeros(PLACES, np.float32), 0.0, 0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    folds = [everything[label == c][k::3] for k in range(3) for c in (0, 1)]
    out, truth = [], []
    for k in range(3):
        test = np.sort(np.concatenate(folds[2 * k : 2 * k + 2]))
        train = np.setdiff1d(everything, test)
        if len(test) and len(set(label[train].tolist())) == 2:
            out.append(margins(test, *fit(train)))
            truth.append(label[test])
    joint, square, bias = fit(everything)
    slope, shift = _logistic(np.concatenate(out), np.concatenate(truth)) if out else (4.0, 0.0)
    return Model(joint.astype(np.float32), square.astype(np.float32), bias, slope, shift)


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task: it holds at most SAMPLE rows of features."""
    got = sorted((r["doc_id"], r["label"], r["features"]) for b in batches for r in b.to_pylist())
    model = _fit_rows([np.frombuffer(f, np.int32) for _, _, f in got], np.array([y for _, y, _ in got], np.int64))
    yield pa.RecordBatch.from_arrays([text.binary([model.joint.tobytes()]), text.binary([model.square.tobytes()]), *(pa.array([float(x)]) for x in (model.bias, model.slope, model.shift))], ["joint", "square", "bias", "slope", "shift"])


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the rows from which no label is learned."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from labelled rows that aren't held out, at most `sample` of them."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    marked = marked.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` rows of two numbers
    model = rows.select("doc_id", "label", "text").mapInArrow(_examples, "doc_id long, label int, features binary").repartition(1).mapInArrow(_fit, "joint binary, square binary, bias double, slope double, shift double").first()
    if model is None:
        return _fit_rows([], np.empty(0, np.int64))
    return Model(np.frombuffer(model["joint"], np.float32), np.frombuffer(model["square"], np.float32), model["bias"], model["slope"], model["shift"])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, added: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with the columns `added`, score and prediction, at the end; columns of these names are replaced."""
    taken = {c.lower() for c in added}
    names = [c for c in docs.columns if c.lower() not in taken]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch, data, at in text.steps(batches):
            margin = np.array([m.joint[f].sum(dtype=np.float64) / _length(m.square, f) for f in _features(data, at)])
            p = 1 / (1 + np.exp(-np.clip(m.slope * (margin + m.bias) + m.shift, -500, 500)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*names, *added])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in names)
    return docs.select(*names).mapInArrow(run, schema + f", `{added[0]}` double, `{added[1]}` int")
