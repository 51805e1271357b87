"""Resampling over word tries against plain counting."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from helicase.llm import word_tries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _features(text, most):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def _plain(docs, target, most, buckets, percent, least, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in _features(t, most)[1])
    t = Counter(bucket(f) for x in target for f in _features(x, most)[1])
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for i, x in docs:
        words, features = _features(x, most)
        gains = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in map(bucket, features)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(fit[: len(fit) * percent // 100])}
    return [(*r, rank.get(id(r))) for r in out]


@pytest.mark.parametrize(("most", "buckets", "percent", "least"), [(1, 10_000, 10, 20), (3, 97, 50, 1), (2, 1000, 100, 0)])
def test_as_plain_counting(spark, docs, corpus, most, buckets, percent, least):
    target = [t for _, t in corpus[:30]] + [None, "", "word word WORD"]
    table = spark.createDataFrame([(t,) for t in target], "text string")
    got = word_tries.resample(docs, table, most, buckets, percent, least)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect())) == sorted(_plain(corpus, target, most, buckets, percent, least), key=lambda r: r[:5])


def test_tries_given_up_and_steps_of_one_document_change_nothing(spark, docs, corpus, monkeypatch):
    target = spark.createDataFrame([(t,) for _, t in corpus[:9]], "text string")
    want = sorted(map(tuple, word_tries.resample(docs, target, 2).collect()))
    monkeypatch.setattr(word_tries, "NODES", 5)
    monkeypatch.setattr(word_tries.text, "STEP_BYTES", 1)
    assert sorted(map(tuple, word_tries.resample(docs, target, 2).collect())) == want


def test_crc_states_of_paths():
    import numpy as np

    trie = word_tries.Trie()
    raw = "alpha beta alpha beta gamma".encode()
    for _ in word_tries._paths(trie, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 3):
        pass
    spelled = {0: ""}
    for key, child in sorted(trie._child.items(), key=lambda x: x[1]):
        word = trie._spelled[key & 0xFFFFFFFF].decode()
        spelled[child] = f"{spelled[key >> 32]} {word}".strip()
    assert len(spelled) == len(trie) == 1 + 3 + 3 + 3
    assert all(trie._state[i] == zlib.crc32(s.encode()) for i, s in spelled.items())


def test_empty_tables_repeats_nulls_and_clashing_names(spark, none):
    target = spark.createDataFrame([("good words here",)], "text string")
    assert word_tries.resample(none, target).count() == 0
    rows = [(1, "good words " * 15, "a", 5), (1, "good words " * 15, "b", 6), (None, "other " * 30, "c", 7), (2, None, "d", 8), (3, "", "e", 9), (None, "x " * 25, "f", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Score string, h int")
    got = word_tries.resample(docs, spark.createDataFrame([], "text string"), percent=100, carry=("doc_id", "Score", "h")).collect()
    assert got[0].__fields__ == ["doc_id", "Score", "h", "n_words", "n_features", "weight", "score_", "rank"]
    assert sorted((r["Score"], r["h"]) for r in got) == [(r[2], r[3]) for r in rows]
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4]
    assert all(r["weight"] == 0 and r["n_features"] == 0 for r in got if r["Score"] in "de")


def test_target_words_raise_the_score(spark):
    docs = spark.createDataFrame([(i, ("wanted " if i % 4 == 0 else "plain ") * 40) for i in range(400)], "doc_id long, text string")
    target = spark.createDataFrame([("wanted " * 50,)], "text string")
    drawn = [r["doc_id"] for r in word_tries.resample(docs, target).collect() if r["rank"]]
    assert len(drawn) == 40 and sum(i % 4 == 0 for i in drawn) > 25
