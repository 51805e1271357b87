"""Near duplicates, lines, passages and fingerprints against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from helicase.llm import fingerprint, line_dedup, minhash, suffix_dedup, tables, text

from . import brute


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates(docs, corpus, words):
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs, words=words).collect()}
    want = brute.near(corpus, words)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())
    assert len({r["component_id"] for r in got.values()}) < len(got) - 10


def test_near_duplicates_chain(spark):
    """Links across buckets whose smallest id isn't linked, and a chain longer than one hop."""
    rng = random.Random(4)
    chain = [[f"w{i}" for i in range(60)]]
    for _ in range(40):
        w = list(chain[-1])
        w[rng.randrange(60)] = f"n{rng.random()}"
        chain.append(w)
    corpus = [(i, " ".join(w)) for i, w in enumerate(chain)]
    rng.shuffle(corpus)
    got = minhash.near_duplicates(spark.createDataFrame(corpus, "doc_id long, text string"), words=3).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.near(corpus, 3)


def test_lines(docs, corpus):
    got = line_dedup.drop_lines(docs)
    assert got.columns == ["doc_id", "text", "rank", "key", "n_lines", "n_dropped"]
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()} == brute.lines(corpus)


def test_lines_low_threshold(docs, corpus):
    got = line_dedup.drop_lines(docs, min_chars=1, min_docs=2, shards=3)
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()} == brute.lines(corpus, 1, 2)


def test_perfect_hash():
    keys, checks = np.random.default_rng(1).integers(0, 1 << 64, (2, 5000), dtype=np.uint64)
    keys[:40] = keys[0]  # told apart by the second number alone
    hashed = line_dedup.PerfectHash.build(keys, checks)
    assert sorted(hashed.index(keys, checks).tolist()) == list(range(5000))
    sizes, bits = zip(*hashed.pack(), strict=True)
    assert (line_dedup.PerfectHash.unpack(list(sizes), list(bits), hashed.seed).index(keys, checks) == hashed.index(keys, checks)).all()


def test_perfect_hash_takes_another_seed(monkeypatch):
    monkeypatch.setattr(line_dedup, "_LEVELS", 2)
    keys, checks = np.random.default_rng(2).integers(0, 1 << 64, (2, 12), dtype=np.uint64)
    seeds = set()
    for i in range(3, 12):
        hashed = line_dedup.PerfectHash.build(keys[:i], checks[:i])
        assert sorted(hashed.index(keys[:i], checks[:i]).tolist()) == list(range(i))
        seeds.add(hashed.seed)
    assert len(seeds) > 1


@pytest.mark.parametrize(("size", "gram", "group"), [(100, 36, 4000), (40, 12, 4000), (40, 12, 3)])
def test_repeats(docs, corpus, size, gram, group, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    got = suffix_dedup.drop_repeats(docs, size=size, gram=gram)
    have = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got.collect()}
    assert have == brute.repeats(corpus, size)


def test_repeats_as_text(docs, corpus):
    got = suffix_dedup.drop_repeats(docs, as_text=True)
    want = brute.repeats(corpus, 100)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {i: w[3].decode("utf-8", "ignore") for i, w in want.items()}


def test_two_stage_sort():
    rng = random.Random(1)
    for _ in range(150):
        size = rng.choice([3, 5, 8])
        parts = [bytes(rng.choice(b"ab\x00\xffc") for _ in range(rng.randint(size, 40))) for _ in range(rng.randint(1, 6))]
        many = np.array([rng.randint(1, len(w) - size + 1) for w in parts])
        parts = [w[: m + size - 1] for w, m in zip(parts, many, strict=True)]
        ends = np.concatenate(([0], np.cumsum([len(w) for w in parts])))
        seen, want = set(), []
        for w, m in zip(parts, many, strict=True):
            for p in range(m):
                want.append(w[p : p + size] in seen)
                seen.add(w[p : p + size])
        got = suffix_dedup.repeated_starts(np.frombuffer(b"".join(parts), np.uint8), ends, many, size)
        assert got.tolist() == want


def test_two_stage_order_is_the_suffix_order():
    codes = np.frombuffer(b"mississippi banana abracadabra", np.uint8).astype(np.uint16) + 1
    codes = np.append(codes, 0).astype(np.uint16)
    order = suffix_dedup.two_stage_sort(codes, np.ones(len(codes), bool), 40)
    assert order.tolist() == sorted(range(len(codes)), key=lambda i: codes[i:].tolist())
    prefix = suffix_dedup.common_prefixes(codes, order, 40)
    raw = codes.tolist()
    for a, b, n in zip(order[:-1], order[1:], prefix[1:], strict=True):
        assert raw[a : a + n] == raw[b : b + n] and raw[a : a + n + 1] != raw[b : b + n + 1]


def test_fingerprints(docs, corpus):
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(docs).collect()}
    order = sorted(corpus)
    assert sorted(got) == [i for i, _ in order]
    prints: dict[str, str] = {}
    for (i, t), (j, u) in zip(order, order[1:] + order[:1], strict=True):
        t, u = t or "", u or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        assert (got[i]["n_chars"], got[i]["edited_text"]) == (len(t), edited)
        for x, p in ((t, got[i]["fingerprint"]), (edited, got[i]["edited_fingerprint"])):
            assert prints.setdefault(x, p) == p
        assert 0 <= got[i]["near_edited"] <= 1
        if t == u:
            assert got[i]["near_next"] == 1
    long = [r for r in got.values() if r["n_chars"] > 300]
    assert np.mean([r["near_edited"] for r in long]) > 0.3 > np.mean([r["near_next"] for r in long if r["near_next"] < 1])


def test_fingerprint_alone(spark):
    one = fingerprint.fingerprints(spark.createDataFrame([(5, "some text")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1 and one[0]["edited_text"] == "some some"[:9]


def test_edit_distance():
    rng = np.random.default_rng(2)
    n, m = rng.integers(0, 65, 60), rng.integers(0, 65, 60)
    a, b = np.full((60, 64), -1, np.int8), np.full((60, 64), -1, np.int8)
    for i in range(60):
        a[i, : n[i]] = rng.integers(0, 4, n[i])
        b[i, : m[i]] = rng.integers(0, 4, m[i])
    got = fingerprint.edit_distance(a, n, b, m)
    for i in range(60):
        assert got[i] == brute.distance("".join(map(chr, a[i, : n[i]])), "".join(map(chr, b[i, : m[i]])))


def test_components(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(60)] + [(700, 701 + i) for i in range(50)]
    got = {r["id"]: r["component"] for r in tables.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: r for x, r in root.items() if x in linked}


def test_empty_tables(none):
    assert minhash.near_duplicates(none).count() == 0
    assert line_dedup.drop_lines(none).count() == 0
    assert suffix_dedup.drop_repeats(none).count() == 0
    assert fingerprint.fingerprints(none).count() == 0


def test_nulls_everywhere(spark):
    rows = spark.createDataFrame([(None, None), (None, "x " * 200), (1, None), (2, "x " * 200), (2, "x " * 200)], "doc_id long, text string")
    assert minhash.near_duplicates(rows).count() == 3
    assert line_dedup.drop_lines(rows).count() == 5
    assert suffix_dedup.drop_repeats(rows).count() == 5
    assert fingerprint.fingerprints(rows).count() == 3


def test_hashes_depend_on_content_alone():
    data = np.frombuffer(b"abcXabcYabcd" + b"q" * 50 + b"Z" + b"q" * 50, np.uint8)
    for h in text.hashes(data, np.array([0, 4, 8, 8, 12, 63, 12]), np.array([3, 7, 11, 12, 62, 113, 61])):
        assert h[0] == h[1] == h[2] != h[3] and h[4] == h[5] != h[6]
    for k in (1, 3, 7, 36):
        h = text.rolling(np.frombuffer(b"x" * 40 + b"y" + b"x" * 40, np.uint8), k)
        assert len(h) == 82 - k and len(set(h.tolist())) == k + 1


def test_numbered_rows_of_one_doc_id(spark):
    """Rows that share a doc_id are cut by their own lines and passages only."""
    a, b = brute.thue_morse(512)
    rows = [(1, a + "\n" + "first " * 9), (1, "second text " * 30), (2, a), (2, a), (3, "x" + a), (4, "w " * 30 + "\n" + a), (5, a), (6, a)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted((r["doc_id"], r["text"], r["n_dropped"]) for r in line_dedup.drop_lines(table).collect())
    assert kept == sorted([(1, "first " * 9, 1), (1, "second text " * 30, 0), (2, "", 1), (2, "", 1), (3, "x" + a, 0), (4, "w " * 30, 1), (5, "", 1), (6, a, 0)])
    cut = [(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.drop_repeats(table).collect()]
    alone = {r["n_bytes"]: r["n_removed"] for r in suffix_dedup.drop_repeats(table.where("text like 'second%'")).collect()}
    assert (1, 360, alone[360]) in cut and cut.count((2, 512, 512)) == 2 and (3, 513, 512) in cut


def test_one_key_in_many_windows(spark, monkeypatch):
    """A passage between texts of its own in every document: its key's windows are dealt to groups by a second key."""
    monkeypatch.setattr(suffix_dedup, "GROUP", 50)
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(90))
    corpus = [(i, "".join(rng.choice("ijklmnop") for _ in range(30)) + passage + "".join(rng.choice("rstuv") for _ in range(rng.choice([3, 30])))) for i in range(1500)]
    got = suffix_dedup.drop_repeats(spark.createDataFrame(corpus, "doc_id long, text string").repartition(4))
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got.collect()} == brute.repeats(corpus, 100)


def test_extra_columns_with_clashing_names(spark):
    names = ["doc_id", "text", "gone", "gone_doc", "spans", "Spans_doc", "kept", "n_lines", "bucket", "part", "text_hash", "component_id", "a", "b"]
    table = spark.createDataFrame([(i, "some words of a text " * 9, *"xyzuvwabcdef") for i in range(6)], ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))
    assert line_dedup.drop_lines(table).where("n_dropped = 1 and gone = 'x' and bucket = 'a'").count() == 5
    assert suffix_dedup.drop_repeats(table).where("n_removed = 189 and spans = 'z' and Spans_doc = 'u'").count() == 5
    assert minhash.near_duplicates(table).where("kept").count() == 1
    assert fingerprint.fingerprints(table).where("near_next = 1").count() == 6


def test_a_large_index_goes_to_each_task_once(spark):
    """Bytes to the probing tasks grow with lines and index, not with their product."""
    corpus = [(i, "\n".join(f"line {i if j % 3 else j} {j} of a text that is long enough" for j in range(40))) for i in range(600)]
    table = spark.createDataFrame(corpus, "doc_id long, text string").repartition(4)
    got = line_dedup.drop_lines(table, shards=16)
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()} == brute.lines(corpus)
