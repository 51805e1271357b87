"""Operators against plain versions on small inputs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helicase import AlignParams, ClusterMode, ConsensusParams, EmptyInput, FadParams, InvalidK, InvalidParam, RadParams, fad_denoise, rad_denoise
from helicase.functions import metrics as M
from helicase.functions import sequences as S
from helicase.operators import align, assign, blocks, consensus, derep, dpmeans, finesplit, lsh, neighbours, selection, sketch

from . import brute

SCHEMA = "read_idx long, id string, seq string, qual binary, cnt long"


def _random(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("ACGT") for _ in range(n))


def _edited(rng: random.Random, s: str, edits: int) -> str:
    for _ in range(edits):
        i = rng.randrange(len(s))
        s = rng.choice([s[:i] + rng.choice("ACGT") + s[i + 1 :], s[:i] + s[i + 1 :], s[:i] + rng.choice("ACGT") + s[i:]])
    return s


@pytest.fixture(scope="module")
def noisy():
    rng = random.Random(5)
    truths = [_random(rng, 120) for _ in range(4)]
    return truths, [(_edited(rng, truths[i % 4], rng.choice([0, 0, 0, 1, 2])), 1 + i % 2) for i in range(120)]


def _frame(spark, seqs):
    return spark.createDataFrame([(i, f"r{i}", s, None, n) for i, (s, n) in enumerate(seqs)], SCHEMA).repartition(3)


def _one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_sequence_columns(spark):
    s = F.col("s")
    assert _one(spark, S.reverse_complement(s), s="ACGTACGT") == "ACGTACGT"
    assert _one(spark, S.clean(s), s="acguN") == "ACGTN" and _one(spark, S.bad_position(s), s="acguN") == 4
    assert _one(spark, S.bad_position(s), s="ACGU") is None
    assert _one(spark, S.kmers(s, 6), s="ACG") == [] and _one(spark, S.kmers(s, 2), s="AAAAA") == ["AA"] * 4
    assert _one(spark, S.kmer_code(s), s="ACGT") == 0b00011011 and _one(spark, S.canonical(s), s="TTTT") == "AAAA"
    assert _one(spark, S.is_homopolymer(s), s="CCC") and not _one(spark, S.is_homopolymer(s), s="CCA") and not _one(spark, S.is_homopolymer(s), s="")
    assert _one(spark, S.homopolymer_mask(s), s="AACCCGGGGT") == [False, False] + [True] * 7 + [False]
    assert _one(spark, S.codes(s), s="ACGT") == [0, 1, 2, 3] and _one(spark, S.from_codes(S.codes(s)), s="TGCA") == "TGCA"
    for header, n in (("Uniq1;size=48;", 48), ("Uniq1 size=48", 48), ("Uniq1;size=48;foo=bar", 48), ("a;size=0", 1), ("a;size=x;size=3", 3), ("a;xsize=9", 1), ("a", 1)):
        assert _one(spark, S.header_size(s), s=header) == n, header
    assert _one(spark, S.header_id(s), s="Uniq1;size=4") == "Uniq1"
    assert _one(spark, S.fasta_lines(F.lit("h"), s, 4), s="ACGTACGTA") == ">h\nACGT\nACGT\nA" and _one(spark, S.fasta_lines(F.lit("h"), s), s="") == ">h"
    with pytest.raises(InvalidK):
        S.kmers(s, 16)


def test_metric_columns(spark):
    a, b = F.col("a"), F.col("b")
    v = {"a": [1, 0, 3], "b": [2, 2, 3]}
    assert _one(spark, M.squared_distance(a, b), **v) == 5 and _one(spark, M.corrected_distance(a, b, 5), **v) == 0.5
    assert _one(spark, M.normalized_distance(a, b, 5), **v) == pytest.approx(5 / (5 * 11)) and _one(spark, M.normalized_distance(a, b, 5), a=[0], b=[0]) == 0
    assert _one(spark, M.hamming_fraction(a, b), **v) == pytest.approx(2 / 3) and _one(spark, M.order_mismatch(a, b), a=[1, 2], b=[1, 3, 4]) == 0.5
    assert _one(spark, M.bindash_from_hamming(F.lit(1.0), 6), x=1) == pytest.approx(117.95, abs=0.01)
    assert _one(spark, M.SketchDistance.BINDASH.column(a, b, 6), a=[1], b=[1]) == 0


def test_neighbours_and_selection(spark, noisy):
    unique = derep.dereplicate(_frame(spark, noisy[1])).cache()
    order, taken, _ = brute.greedy(noisy[1], 6, 3.0, 1)
    assert [(r["seq"], r["cnt"]) for r in unique.orderBy("uid").collect()] == order
    c = [brute.counts(s, 6) for s, _ in order]
    want = {(i, j): brute.squared(c[i], c[j]) for i in range(len(c)) for j in range(i + 1, len(c)) if brute.squared(c[i], c[j]) <= 36}
    got = {(r["ua"], r["ub"]): r["sq"] for r in neighbours.pairs(unique, 6, 3.0, size=7).collect()}
    assert got == want and len(want) > 50
    edges = neighbours.pairs(unique, 6, 3.0)
    assert sorted(r["uid"] for r in selection.greedy_independent(unique, edges).collect()) == taken


def _loop(n, edges):
    near: dict[int, list[int]] = {}
    for a, b in edges:
        near.setdefault(max(a, b), []).append(min(a, b))
    taken: set[int] = set()
    for i in range(n):
        if not taken & set(near.get(i, [])):
            taken.add(i)
    return sorted(taken)


def test_selection_on_chains_and_random_graphs(spark, monkeypatch):
    frame = lambda edges: spark.createDataFrame(edges, "ua long, ub long").repartition(3)
    n, rng, report = 10_000, random.Random(4), {}
    chain = [(i, i + 1) for i in range(n - 1)]
    got = selection.greedy_independent(spark.range(n).withColumnRenamed("id", "uid"), frame(chain), report)
    assert sorted(r[0] for r in got.collect()) == list(range(0, n, 2)) and report["rounds"] < 20
    place = list(range(300))
    rng.shuffle(place)
    edges = [(place[i], place[i + 1]) for i in range(150)] + [(rng.randrange(300), rng.randrange(300)) for _ in range(120)] + [(0, i) for i in range(200, 240)]
    edges = [e for e in edges if e[0] != e[1]]
    nodes = spark.range(300).withColumnRenamed("id", "uid")
    for rounds, most in ((1, 1 << 20), (1, 3)):
        monkeypatch.setattr(selection, "ROUNDS", rounds)
        monkeypatch.setattr(selection, "EDGES", most)
        assert sorted(r[0] for r in selection.greedy_independent(nodes, frame(edges)).collect()) == _loop(300, edges)
    assert selection.greedy_independent(nodes, spark.createDataFrame([], "ua long, ub long")).count() == 300


@pytest.mark.parametrize(("threshold", "least"), [(1.0, 2), (8.0, 1), (1.0, 1000)])
def test_fad(spark, noisy, threshold, least):
    order, taken, best = brute.greedy(noisy[1], 6, threshold, least)
    got = fad_denoise(_frame(spark, noisy[1]), FadParams(use_sketch=False, neighbor_threshold=threshold, min_count=least))
    assert [(r["uid"], r["seq"]) for r in got.templates.orderBy("tid").collect()] == [(t, order[t][0]) for t in taken]
    assert [r["tid"] for r in got.assignments.orderBy("uid").collect()] == best
    assert got.templates.agg(F.sum("assigned")).first()[0] == sum(n for _, n in noisy[1])


def test_fad_finds_the_truths(spark, noisy):
    got = fad_denoise(_frame(spark, noisy[1]))
    assert {r["seq"] for r in got.templates.orderBy("tid").limit(4).collect()} == set(noisy[0])


def test_sketches_estimate_similarity(spark):
    rng = random.Random(2)
    a = _random(rng, 3000)
    seqs = [a, _edited(rng, a, 40), brute.rc(a)]
    sig = {r["k"]: r["sig"] for r in sketch.signatures(spark.createDataFrame(list(enumerate(seqs)), "k long, seq string"), "k", 9, 512).collect()}
    sets = [set(brute.counts(s, 9)) for s in seqs]
    share = sum(x == y for x, y in zip(sig[0], sig[1], strict=True)) / 512
    assert abs(share - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 0.08 and sig[0] == sig[2] and len(sig[0]) == 512
    few = sketch.signatures(spark.createDataFrame([(1, "ACGTACG")], "k long, seq string"), "k", 6, 64).first()["sig"]
    assert len(few) == 64 and len(set(few)) <= 2


def test_assignment_over_candidates(spark, noisy):
    t = spark.createDataFrame(list(enumerate(noisy[0])), "tid long, seq string")
    rows = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(noisy[1])], "uid long, seq string")
    sign = lambda df, key: df.join(sketch.signatures(df, key, 6, 64), key)
    got = {r["uid"]: r["tid"] for r in assign.by_sketch(sign(rows, "uid"), "uid", sign(t, "tid"), 6, 2, 0.03, size=3).collect()}
    exact = {r["uid"]: r["tid"] for r in assign.nearest(rows, "uid", t, 6, size=3).collect()}
    assert exact == {i: i % 4 for i in range(120)} == got
    cut = spark.createDataFrame([(1, 0, 0.5, 3), (1, 1, 0.2, 9), (1, 2, 0.1, 9), (2, 5, 0.9, 4), (2, 4, 0.9, 4)], "uid long, tid long, d double, sq long")
    assert {r["uid"]: r["tid"] for r in assign.best_candidate(cut, "uid", 3, 0.3).collect()} == {1: 2, 2: 4}


def _plain_by_sketch(rows, templates, k, top, most):
    """(tid, sq) of each row by looking at all templates."""
    import math

    counted = {s: brute.counts(s, k) for s in {s for _, s, _ in [*rows, *templates]}}
    out = {}
    for i, s, sig in rows:
        differ = lambda t: sum(x != y for x, y in zip(sig, t[2], strict=True)) / len(sig)  # noqa: B023, E731
        d = lambda t: 0 - math.log(2 * max(1 - differ(t), 2.2250738585072014e-308) / (1 + max(1 - differ(t), 2.2250738585072014e-308))) / k  # noqa: B023, E731
        ranked = sorted(templates, key=lambda t: (d(t), t[0]))[:top]  # noqa: B023
        ranked = [t for t in ranked if d(t) <= most] or ranked
        sq = [brute.squared(counted[s], counted[t[1]]) for t in ranked]
        out[i] = (ranked[sq.index(min(sq))][0], min(sq))
    return out


def test_pruned_searches_against_all_pairs(spark, monkeypatch):
    rng = random.Random(17)
    roots = [_random(rng, rng.choice([70, 90, 120])) for _ in range(12)]
    templates = [(t, _edited(rng, roots[t % 12], rng.randint(0, 9))) for t in range(60)]
    rows = [(i, _edited(rng, rng.choice(templates)[1], rng.randint(0, 5))) for i in range(100)] + [(200 + i, _random(rng, 80)) for i in range(6)] + [(300, "ACG"), (301, templates[5][1])]
    t, r = spark.createDataFrame(templates, "tid long, seq string"), spark.createDataFrame(rows, "uid long, seq string").repartition(3)
    counted = {s: brute.counts(s, 6) for _, s in [*rows, *templates]}
    want = {i: min((brute.squared(counted[s], counted[x]), tid) for tid, x in templates) for i, s in rows}
    report: dict[str, int] = {}
    got = {x["uid"]: (x["sq"], x["tid"]) for x in assign.nearest(r, "uid", t, 6, size=16, report=report).collect()}
    assert got == want and 0 < report["compared"] < report["all"] * 0.6
    signed = lambda df, key: df.join(sketch.signatures(df, key, 6, 48), key).cache()
    rs, ts = signed(r, "uid"), signed(t, "tid")
    plain_rows, plain_templates = ([(x[key], x["seq"], x["sig"]) for x in df.collect()] for df, key in ((rs, "uid"), (ts, "tid")))
    for top, most in ((3, 0.05), (2, -1.0)):
        report = {}
        got = {x["uid"]: (x["tid"], x["sq"]) for x in assign.by_sketch(rs, "uid", ts, 6, top, most, size=16, report=report).collect()}
        assert got == _plain_by_sketch(plain_rows, plain_templates, 6, top, most)
        assert (report["rows compared with all"] < 60) == (most > 0)
    none = spark.createDataFrame([], "tid long, seq string")
    assert assign.nearest(r, "uid", none, 6).count() == 0 and assign.nearest(none.withColumnRenamed("tid", "uid"), "uid", t, 6).count() == 0
    assert neighbours.pairs(none.withColumnRenamed("tid", "uid"), 6, 1.0).count() == 0


def test_dp_means_local_and_distributed(spark, noisy):
    seqs = [s for s, _ in noisy[1]][:60]
    names = sorted({w for s in seqs for w in brute.counts(s, 4)})
    vectors = [[brute.counts(s, 4)[w] for w in names] for s in seqs]

    def distance(c, v):
        total = sum(c) + sum(v)
        return sum((x - y) ** 2 for x, y in zip(c, v, strict=True)) / (4 * total) if total else 0.0

    for radius, rounds in ((0.015, 10), (0.2, 3), (0.0, 2)):
        want = brute.dp_means(vectors, radius, rounds, distance)
        assert dpmeans.local(np.array(vectors), radius, rounds, dpmeans.normalized(4)).tolist() == want
        frame = _frame(spark, [(s, 1) for s in seqs])
        got = {r["read_idx"]: r["cluster_id"] for r in dpmeans.exact(frame, 4, True, radius, rounds, size=16).collect()}
        names_of = sorted(set(got.values()))
        assert [names_of.index(got[i]) for i in range(60)] == want
    blob = np.concatenate((np.zeros((1, 2)), 100 + np.arange(100).reshape(50, 2)))
    assert len(set(dpmeans.local(blob, 1.0, 10, lambda c, v: ((c[:, None] - v) ** 2).sum(2)).tolist())) == 51


def test_fine_split_parts_two_alleles(spark):
    rng = random.Random(3)
    a = _random(rng, 200)
    b = _edited(rng, a, 12)
    rows = spark.createDataFrame([(0, i, a if i % 2 else b) for i in range(40)], "cluster_id long, read_idx long, seq string")
    got = {r["read_idx"]: r["part"] for r in finesplit.fine_split(rows, RadParams(min_cluster_size=3)).collect()}
    assert len(set(got.values())) == 2 and all(got[i] == got[i % 2] for i in range(40))
    whole = finesplit.fine_split(rows, RadParams(min_cluster_size=21)).select("part").distinct().count()
    assert whole == 1
    groups = finesplit.absorb_small(np.array([[0.0], [0.0], [9.0], [9.0], [8.0]]), [np.array([0, 1]), np.array([2, 3]), np.array([4])], 2, 1)
    assert [sorted(g.tolist()) for g in groups] == [[0, 1], [2, 3, 4]]


def _families(seed: int, n: int) -> list[tuple[int, int, str]]:
    """Reads of five clusters, each of some alleles with edits, in mixed order."""
    rng = random.Random(seed)
    alleles = {c: [_edited(rng, a, 6 * j) for j in range(4)] for c, a in ((c, _random(rng, 90)) for c in range(5))}
    return [(c, i, _edited(rng, rng.choice(alleles[c]), rng.choice([0, 0, 0, 1, 2]))) for i, c in ((i, rng.choice([0, 0, 0, 1, 2, 3, 4])) for i in range(n))]


def test_fine_split_by_levels_and_within_tasks_agree(spark, monkeypatch):
    rows = _families(31, 220)
    frame = spark.createDataFrame(rows, "cluster_id long, read_idx long, seq string").repartition(3)
    params = RadParams(k=4, min_cluster_size=4, fine_split_min_var=0.02, fine_split_radius=0.012, fine_split_max_depth=2, fine_split_max_iter=4)
    want = {r["read_idx"]: (r["cluster_id"], r["part"]) for r in finesplit.fine_split(frame, params).collect()}
    assert len(want) == 220 and 5 < len(set(want.values())) < 60
    assert all(part == min(i for i, x in want.items() if x == (c, part)) for c, part in want.values())
    monkeypatch.setattr(dpmeans, "READS", 20)  # large clusters by levels, their small parts within tasks
    assert {r["read_idx"]: (r["cluster_id"], r["part"]) for r in finesplit.fine_split(frame, params).collect()} == want


@pytest.mark.parametrize(("radius", "rounds"), [(0.02, 5), (0.02, 1), (0.3, 3)])
def test_dp_means_in_groups_of_any_size_agree(spark, monkeypatch, radius, rounds):
    rows = _families(7, 90)
    frame = spark.createDataFrame(rows + [(0, 90 + i, rows[0][2]) for i in range(20)], "g long, read_idx long, seq string").repartition(3)
    take = lambda: {r["read_idx"]: (r["g"], r["part"]) for r in dpmeans.in_groups(frame, "g", 4, True, radius, rounds, 1).collect()}
    want = take()
    monkeypatch.setattr(dpmeans, "READS", 15)
    assert take() == want and len(want) == 110


@pytest.mark.parametrize(("n", "largest"), [(272, 1), (273, 2)])
def test_lsh_spreads_equal_reads(spark, n, largest):
    rows = spark.range(n).select(F.col("id").alias("read_idx"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i * 7).alias("sig"))
    sizes = lsh.bins(rows, 64, 256).groupBy("bin").count().agg(F.max("count")).first()[0]
    assert sizes == largest
    assert lsh.max_bin_size(100, 4096, 1) == 256 and lsh.max_bin_size(10**8, 4096, 1) == 2048 and lsh.max_bin_size(10**6, 1000, 1) == 1000


def test_lsh_choices_by_component_are_those_of_one_stream(spark, monkeypatch):
    monkeypatch.setattr(lsh, "FEW", 0)
    rng = random.Random(12)
    rows = [(i, [rng.choice([c, 100 + c, 200 + rng.randrange(3) + 10 * c, 1000 + rng.randrange(40)]) for _ in range(4)]) for i in range(400) for c in [rng.randrange(30)]]
    rows = [(i, keys) for i, keys in rows if i % 5] + [(i, [10_000 + i] * 4) for i in range(0, 400, 5)]
    taken: dict[int, int] = {}
    want = {}
    for i, keys in sorted(rows):
        want[i] = min(keys, key=lambda x: (taken.get(x, 0), x))
        taken[want[i]] = taken.get(want[i], 0) + 1
    keyed = spark.createDataFrame(rows, "read_idx long, keys array<long>").repartition(4)
    assert dict(map(tuple, lsh.choose(keyed).collect())) == want
    assert lsh.by_component(keyed).select("component").distinct().count() > 17


@pytest.mark.parametrize(("prunings", "few"), [(0, 0), (1, 0), (3, 0), (3, 1 << 16)])
def test_lsh_keys_that_cannot_be_chosen_are_left_out(spark, monkeypatch, prunings, few):
    monkeypatch.setattr(lsh, "FEW", few)
    monkeypatch.setattr(lsh, "PRUNINGS", prunings)
    rng = random.Random(31)
    rows = [(i, [rng.choice([rng.randrange(60), 100 + rng.randrange(600), 5000 + rng.randrange(9000)]) * 17 + i % 17 for _ in range(6)]) for i in range(500)]
    taken: dict[int, int] = {}
    want = {}
    for i, keys in rows:
        want[i] = min(keys, key=lambda x: (taken.get(x, 0), x))
        taken[want[i]] = taken.get(want[i], 0) + 1
    keyed = spark.createDataFrame(rows, "read_idx long, keys array<long>").repartition(4)
    assert dict(map(tuple, lsh.choose(keyed).collect())) == want
    left = lsh.by_component(keyed).agg(F.sum(F.size("keys"))).first()[0]
    assert left == sum(len(set(keys)) for _, keys in rows) if prunings == 0 else left < 1500


def test_alignments_cell_by_cell():
    rng = random.Random(8)
    pairs = []
    for _ in range(40):
        a = _random(rng, rng.randint(0, 40))
        pairs.append((a, _edited(rng, a, rng.randint(0, 6)) if len(a) > 7 else _random(rng, rng.randint(0, 12))))
    raw = ([a.encode() for a, _ in pairs], [b.encode() for _, b in pairs])
    for band in (-1, 0, 3, 16):
        for free in (True, False):
            x, y, score = align.batch(*raw, AlignParams(2, -2, -3, band), free)
            for (a, b), p, q, s in zip(pairs, x, y, score, strict=True):
                assert (p.decode(), q.decode(), int(s)) == brute.align(a, b, 2, -2, -3, band, free), (a, b, band, free)
    x, y, score = align.batch(*raw, AlignParams(2, -2, -3, 16, homo_gap_score=-1))
    for (a, b), p, q, s in zip(pairs, x, y, score, strict=True):
        gaps = [[-1 if any(set(t[k : k + 3]) == {t[i]} and len(t[k : k + 3]) == 3 for k in range(max(0, i - 2), i + 1)) else -3 for i in range(len(t))] for t in (a, b)]
        assert (p.decode(), q.decode(), int(s)) == brute.align(a, b, 2, -2, -3, 16, True, *gaps)


def test_alignment_scores_of_known_pairs():
    p = AlignParams(5, -4, -8, 16)
    first = [b"ACGTACGTACGT"] * 3
    assert align.batch(first, [b"ACGTACGTACGT", b"ACGTTCGTACGT", b"ACGACGTACGT"], p)[2].tolist() == [60, 51, 47]


def test_alignment_rows(spark):
    rows = spark.createDataFrame([(1, "ACGTACGT", "ACGACGT", [30] * 8, [20] * 7), (2, "AAAA", "TTTTTT", None, None), (3, "ACGTACGTAC", "ACGAACGTAC", list(range(10)), list(range(10, 20)))], "i long, ref string, qry string, ref_qual array<int>, qry_qual array<int>")
    flat = {r["i"]: r for r in align.align(rows, AlignParams(), "gapless").collect()}
    assert (flat[2]["ref_aln"], flat[2]["qry_aln"], flat[2]["score"]) == ("AAAA--", "TTTTTT", -8)
    got = {r["i"]: r for r in align.substitution_records(align.screened(rows, AlignParams(band=4), 3, cutoff=0.3)).collect()}
    assert got[2]["ref_aln"] is None and got[2]["sub"] is None
    assert got[3]["sub"]["pos"] == [3] and got[3]["sub"]["nt0"] == ["T"] and got[3]["sub"]["nt1"] == ["A"] and got[3]["sub"]["q0"] == [3] and got[3]["sub"]["q1"] == [13]
    assert got[1]["sub"]["len0"] == 8 and got[1]["sub"]["map"].count(align.NOWHERE) == 1
    with pytest.raises(InvalidParam):
        align.align(rows, AlignParams(), "sideways")


def test_consensus(spark):
    rng = random.Random(13)
    rows, want = [], {}
    for c in range(5):
        truth = _random(rng, 80)
        reads = [_edited(rng, truth, rng.randint(0, 4)) for _ in range(c * 3 + 1)]
        rows += [(c, 100 * c + i, s) for i, s in enumerate(reads)]
        k = [brute.counts(s, 6) for s in reads]
        draft = reads[min(range(len(reads)), key=lambda i: (sum(brute.squared(k[i], x) for x in k), i))]  # noqa: B023
        want[c] = reads[0] if len(reads) == 1 else brute.consensus(reads, draft, 0.5, 16)
    got = consensus.consensus(spark.createDataFrame(rows, "cluster_id long, read_idx long, seq string"), ConsensusParams())
    assert {r["cluster_id"]: r["seq"] for r in got.collect()} == want


def test_even_samples(spark):
    rows = spark.range(37).select(F.lit(1).alias("g"), F.col("id").alias("o"))
    for most in (1, 2, 5, 36, 37, 50):
        got = [r["o"] for r in consensus.sample(rows, "g", "o", most).orderBy("rank").collect()]
        want = list(range(37)) if most >= 37 else [0] if most <= 1 else [i * 36 // (most - 1) for i in range(most)]
        assert got == want, most


@pytest.mark.parametrize("mode", list(ClusterMode))
def test_rad(spark, noisy, mode):
    reads = _frame(spark, noisy[1])
    got = rad_denoise(reads, RadParams(cluster_mode=mode, min_cluster_size=2 if mode is ClusterMode.EXACT else 1))
    rows = got.templates.orderBy("tid").collect()
    assert sum(r["assigned"] for r in rows) == sum(n for _, n in noisy[1]) and got.read_assignments.count() == 120
    assert set(noisy[0]) <= {r["seq"] for r in rows}


def test_rad_falls_back_to_one_cluster(spark, noisy):
    got = rad_denoise(_frame(spark, noisy[1][:40]), RadParams(min_cluster_size=50, fine_split=False))
    assert got.clusters.select("cluster_id").distinct().count() == 1 and got.templates.count() == 1


def test_errors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    with pytest.raises(EmptyInput):
        fad_denoise(empty)
    with pytest.raises(InvalidK):
        fad_denoise(_frame(spark, [("ACGT", 1)]), FadParams(k=0))
    for seq, says in (("ACGTNACGT", "invalid base 'N' at 4"), ("ACG", "shorter than k")):
        with pytest.raises(Exception, match=says):
            fad_denoise(_frame(spark, [(seq, 1)])).templates.collect()
    kept = fad_denoise(_frame(spark, [("ACGTNACGT", 1), ("ACG", 1), ("ACGTACGTA", 3)]), mode="drop")
    assert kept.unique.count() == 1
    assert ClusterMode.of("Sketch") is ClusterMode.SKETCH_PRECLUSTER
    with pytest.raises(InvalidParam):
        ClusterMode.of("none")


def test_numbers_follow_the_order_of_many_rows(spark):
    rows = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("key"), F.repeat(F.lit("A"), 20).alias("seq"))
    got = [r["key"] for r in derep.numbered(rows, "key").orderBy("read_idx").select("key").collect()]
    assert got == sorted(got) and len(got) == 20_000
    places = derep.numbered(rows, "key").select("read_idx").distinct().agg(F.min("read_idx"), F.max("read_idx"), F.count("*")).first()
    assert tuple(places) == (0, 19_999, 20_000)


@pytest.mark.parametrize("n", [0, 5, 6, S.STEP - 1, S.STEP, S.STEP + 5, S.STEP + 6, 3 * S.STEP + 17])
def test_long_sequences_have_all_kmers_and_runs(spark, n):
    seq = _random(random.Random(n), n) if n else ""
    got = spark.createDataFrame([(seq,)], "seq string").select(S.kmers(F.col("seq"), 6).alias("w"), S.homopolymer_mask(F.col("seq")).alias("m")).first()
    assert got["w"] == [seq[i : i + 6] for i in range(n - 5)]
    assert got["m"] == [any(s >= 0 and seq[s : s + 3] == b * 3 for s in (i - 2, i - 1, i)) for i, b in enumerate(seq)]


def test_kmer_screen_against_counts():
    rng = random.Random(3)
    first, second = ["", "AC", "ACGT"] + [_random(rng, 90) for _ in range(5)], ["ACG", "", "ACGA"] + [_random(rng, 80) for _ in range(4)] + [""]
    distance, order = align.kmer_screen(first, second, 3)
    for a, b, d, o in zip(first, second, distance, order, strict=True):
        x, y = [a[i : i + 3] for i in range(len(a) - 2)], [b[i : i + 3] for i in range(len(b) - 2)]
        squared = sum((x.count(w) - y.count(w)) ** 2 for w in {*x, *y})
        assert d == pytest.approx(squared / (3 * (len(x) + len(y))) if x or y else 0)
        n = min(len(x), len(y))
        assert o == pytest.approx(sum(v != w for v, w in zip(x, y)) / n if n else 1)  # noqa: B905


def test_blocks_hold_a_bounded_number_of_letters(spark, monkeypatch):
    monkeypatch.setattr(blocks, "LETTERS", 100)
    rows = spark.createDataFrame([(i, "A" * n) for i, n in enumerate([30, 30, 30, 30, 250, 40, 90])], "uid long, seq string").coalesce(1)
    packed = blocks.pack(rows, "uid", {"seq": "string"}).collect()
    assert sorted(u for r in packed for u in r["uid"]) == list(range(7))
    assert all(len(r["seq"]) == 1 or sum(map(len, r["seq"])) <= 100 for r in packed)
