"""Classifier, fingerprints and the pipeline against plain versions, and rows that are likely to go wrong."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helicase.llm import bpe, chat, fingerprint, neighbours, packing, quality, queries, tables, token_counts

from . import brute

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    """documents with nulls and a column of a clashing name, labels with nulls, unknown ids and two for one document."""
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", None if i % 7 == 0 else "web", None if t is None else len(t), "x") for i, t in corpus]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int("\n" in (t or "")), 0) for i, t in corpus if i % 4] + [(corpus[0][0], 0, 0), (corpus[0][0], 1, 0), (None, 1, 0), (10**6, 1, 1), (corpus[1][0], None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def scored(corpus, spark, folder):
    """Each document's margin and the training labels by the plain version."""
    labels: dict[int, int] = {}
    for r in spark.read.parquet(f"{folder}/labels.parquet").where("doc_id is not null and quality is not null").collect():
        labels[r["doc_id"]] = min(r["quality"], labels.get(r["doc_id"], 1))
    texts = dict(corpus)
    train = sorted(i for i in labels if i in texts and zlib.crc32(str(i).encode()) % 5)
    rows = {i: brute.features(t) for i, t in texts.items()}
    y = [labels[i] for i in train]
    assert 10 < sum(y) < len(y) - 10
    margin = brute.support_vectors([rows[i] for i in train], y, quality.PLACES)
    folds = {i: j % 3 for c in (0, 1) for j, i in enumerate(i for i in train if labels[i] == c)}
    outside = []
    for k in range(3):
        part = [i for i in train if folds[i] != k]
        own = brute.support_vectors([rows[i] for i in part], [labels[i] for i in part], quality.PLACES)
        outside += [(own(rows[i]), labels[i]) for i in train if folds[i] == k]
    return {i: margin(rows[i]) for i in texts}, np.array(outside)


def test_features(corpus):
    for _, t in corpus:
        data, at = quality.text.column_bytes(quality.pa.array([t, "Other words", t], quality.pa.string()))
        first, _, last = quality._features(data, at)
        assert len(set(first.tolist())) == len(first) and set(first.tolist()) == set(last.tolist()) == brute.features(t)


def test_classifier(spark, corpus, folder, scored):
    margins, outside = scored
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    # the curve's optimum: no slope left in either direction
    p = 1 / (1 + np.exp(-(model.slope * outside[:, 0] + model.shift)))
    assert abs((p - outside[:, 1]).sum()) < 1e-2 and abs(((p - outside[:, 1]) * outside[:, 0]).sum() + 1e-2 * model.slope) < 1e-2
    rows = {r["doc_id"]: r for r in queries.op4_quality(spark, folder).collect()}
    assert sorted(rows) == sorted(margins)
    for i, m in margins.items():
        want = 1 / (1 + np.exp(-(model.slope * m + model.shift)))
        assert rows[i]["score"] == pytest.approx(want, abs=1e-4) and rows[i]["predicted"] == (rows[i]["score"] >= 0.3)
        assert rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_fingerprints(docs, corpus):
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(docs).collect()}
    order = sorted((i, t or "") for i, t in corpus)
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        prints = [brute.fingerprint(x) for x in (t, edited, u)]
        assert [got[i]["fingerprint"], got[i]["edited_fingerprint"]] == prints[:2]
        assert got[i]["near_edited"] == pytest.approx(brute.likeness(prints[0], prints[1])) and got[i]["near_next"] == pytest.approx(brute.likeness(prints[0], prints[2]))


def test_pipeline(spark, corpus, folder, scored):
    """Each stage against its plain version, with null texts and another column."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, held = docs.columns, dict(corpus)
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    want = {i: 1 / (1 + np.exp(-(model.slope * m + model.shift))) for i, m in scored[0].items()}
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = tables.keep(stage(spark, docs, folder))
        if i < 4:
            assert docs.columns == names
            new = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert docs.where("score = 'x'").count() == len(new)
        if i == 0:
            sure = {d for d, p in want.items() if abs(p - 0.3) > 1e-4}
            assert set(new) & sure == {d for d in sure if want[d] >= 0.3} and 0 < len(new) < len(held)
            assert all(new[d] == held[d] for d in new)
        elif i == 1:
            assert new == {d: v[2] for d, v in brute.lines(held.items()).items()}
        elif i == 2:
            assert new == {d: held[d] for d, v in brute.near(held.items(), 5).items() if v[1] == d}
        elif i == 3:
            assert new == {d: v[3].decode("utf-8", "ignore") for d, v in brute.repeats(held.items(), 100).items()}
        else:
            _packed_as_documents(docs.collect(), {d: [*library.encode(t or "", add_special_tokens=False).ids, 2] for d, t in held.items()})
        held = new
    again = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, again.select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, docs.select("doc_id", "piece", "ids_crc32").collect()))


def _packed_as_documents(rows, want: dict[int, list[int]], capacity: int = 1024) -> None:
    pieces: dict[int, list] = {}
    bins: dict[int, list[tuple[int, int]]] = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(pieces) == sorted(want)
    for d, ids in want.items():
        end = 0
        for k, r in enumerate(sorted(pieces[d], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, end) and r["ids_crc32"] == zlib.crc32(np.array(ids[end : end + r["length"]], "<u4").tobytes())
            assert r["length"] == capacity or k == 0
            end += r["length"]
        assert end == len(ids)
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts[:-1]]]).tolist() and sum(parts[-1]) <= capacity
    assert len(bins) <= 1.05 * -(-sum(map(len, want.values())) // capacity) + 1


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_null_and_repeated_ids(spark):
    rows = [(None, "a text"), (None, None), (1, "a text"), (1, "a text"), (1, "another text"), (2, None)]
    table = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, ids string, n_tokens int").repartition(3)
    coded = bpe.encode(table, RANKS, decode=True).select("doc_id", F.col("decoded").cast("string")).collect()
    key = lambda pairs: sorted(map(repr, pairs))
    assert key(map(tuple, coded)) == key((i, t or "") for i, t in rows)
    counted = token_counts.histogram(token_counts.lengths(table, RANKS)).agg(F.sum("n_docs")).first()[0]
    packed = packing.pack(table, JSON).collect()
    assert counted == len(packed) == 6
    assert key(r["doc_id"] for r in packed) == key(i for i, _ in rows) and {(r["piece"], r["start"]) for r in packed} == {(0, 0)}
    end = 0
    for r in sorted(packed, key=lambda r: r["offset"]):
        assert r["sequence_id"] == packed[0]["sequence_id"] and r["offset"] == end
        end += r["length"]


def test_fingerprints_in_many_runs(spark, corpus):
    """The runs that the documents are cut into leave no trace, whatever the ids are."""
    ids = [-(2**62), -7, 0, 0, 1, 2**40, 2**62]
    docs = spark.createDataFrame([(ids[i] if i < 7 else i * 31, t) for i, (_, t) in enumerate(corpus)], "doc_id long, text string").repartition(5)
    old, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (1, 3, 60):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got.append(sorted(map(tuple, fingerprint.fingerprints(docs).select("doc_id", "n_chars", "edited_text", "near_edited", "near_next").collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(got[0]) == len(corpus) and got[0] == got[1] == got[2]


def test_neighbours_of_null_and_repeated_ids(spark):
    rows = [(None, [1.0, 1.0]), (0, [1.0, 0.0]), (0, [3.0, 0.0]), (1, [1.0, 0.5]), (1, [9.0, 9.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0])]
    table = spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id long, embedding array<double>, rank int, list string").repartition(3)
    got = sorted(map(tuple, neighbours.search(table, table.where("vec_id = 0")).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, 1.0)]


def test_repeated_turns(spark):
    turns = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (2, 0, "user", "hi"), (3, 5, "user", "hi"), (3, 9, "user", "hi"), (3, 9, "user", "ho")]
    got = chat.format_chats(spark.createDataFrame([(*t, 3) for t in turns], "conv_id long, turn int, role string, text string, place int").repartition(3)).collect()
    assert [(r["conv_id"], r["n_turns"], r["n_copies"]) for r in got] == [(3, 3, 1)]
    assert got[0]["chat"] == "".join(f"{chat.START}user\n{t}{chat.STOP}\n" for t in ("hi", "hi", "ho"))
