"""SentencePiece ids and texts against the library itself."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from helicase.llm import marked_words

PATH = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = ["a", "th", "the", " ", "  ", "   ", "\n", "\t", "é", "漢字", "😀", "▁", "▁▁", "<s>", "</s>", "<0x41>", "\x00", "<unk>", "ing", "Hello", "123", "　", "\xa0", "�", "é"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_as_the_library(docs, corpus, library):
    got = {r["doc_id"]: r for r in marked_words.encode(docs, PATH, decode=True).collect()}
    for i, t in corpus:
        want = library.encode(t or "", add_eos=True)
        assert got[i]["ids"] == want and got[i]["n_tokens"] == len(want) and got[i]["decoded"] == library.decode(want)
    back = marked_words.decode(marked_words.encode(docs, PATH, end=False), PATH)
    assert {r["doc_id"]: r["decoded"] for r in back.collect()} == {i: r["decoded"] for i, r in got.items()}


def test_random_texts_and_runs_of_marks(library):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    texts += [" " * n for n in range(60)] + ["▁" * n for n in range(40)] + ["a" * 3000, "日本語" * 300, "ab " * 2000]
    raw = [t.encode() for t in texts]
    ids, counts = marked_words.pieces(PATH).encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))), True)
    ends = np.cumsum(counts)[:-1]
    assert [x.tolist() for x in np.split(ids, ends)] == library.encode(texts, add_eos=True)


def test_any_ids_decode_as_by_the_library(spark, library):
    rng = random.Random(2)
    rows = [(i, [rng.choice([rng.randrange(32000), rng.randrange(259), 0, 1, 2, 28705, 259]) for _ in range(rng.randint(0, 12))]) for i in range(2000)]
    got = dict(map(tuple, marked_words.decode(spark.createDataFrame([*rows, (-1, None)], "doc_id long, ids array<int>"), PATH).collect()))
    assert got.pop(-1) == "" and got == {i: library.decode(ids) for i, ids in rows}


def test_table_of_chunks_is_bounded_and_starts_afresh(monkeypatch, library):
    monkeypatch.setattr(marked_words, "MEMO_BYTES", 500)
    table, rng = marked_words.Pieces(PATH), random.Random(3)
    for _ in range(20):
        t = " ".join(str(rng.randrange(10**6)) for _ in range(5))
        ids, _ = table.encode(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), True)
        assert ids.tolist() == library.encode(t, add_eos=True)
    assert len(table._memo) < 20


def test_long_chunk_nulls_repeats_and_empty_table(spark, none, library):
    assert marked_words.encode(none, PATH).count() == 0
    long = "x0y" * 20_000
    docs = spark.createDataFrame([(None, long), (1, None), (1, "same"), (1, "same")], "doc_id long, text string").withColumn("ids", F.lit("own"))
    got = sorted((r["n_tokens"], r["ids"]) for r in marked_words.encode(docs, PATH).collect())
    assert got == sorted((len(w), w) for w in (library.encode(t, add_eos=True) for t in (long, "", "same", "same")))


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    for change in ("cross", "normal", "kind"):
        model = sentencepiece_model_pb2.ModelProto()
        with open(PATH, "rb") as f:
            model.ParseFromString(f.read())
        if change == "cross":
            model.pieces[500].piece = "a▁b"
        elif change == "normal":
            model.normalizer_spec.remove_extra_whitespaces = True
        else:
            model.pieces[500].type = model.SentencePiece.USER_DEFINED
        path = tmp_path / change
        path.write_bytes(model.SerializeToString())
        with pytest.raises(ValueError):
            marked_words.Pieces(str(path))
