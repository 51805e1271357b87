"""Files, streams, the command line and the driver contract."""

from __future__ import annotations

import gzip
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from helicase import InvalidParam, queries
from helicase.cli import build_parser, main, rad_params
from helicase.sources import fasta, members
from helicase.streaming.abundance import running_abundance

FASTA = ">Uniq1;size=48;x=1\r\nacgu\r\nACGT  \r\n>empty\r\n>two size=3\nTTTT\n>three\nGG>G\nA\n"
FASTQ = "@r1 size=9 x\nACGT\n+\n@III\n@r2\nGGTA\n+anything\nIIII\nnot a header\nAAAA\n+\nIIII\n"


@pytest.mark.parametrize("packed", [False, True])
def test_read_fasta(spark, tmp_path, packed):
    path = tmp_path / ("a.fa.gz" if packed else "a.fa")
    path.write_bytes(gzip.compress(FASTA.encode()) if packed else FASTA.encode())
    rows = fasta.read_reads(spark, str(path)).orderBy("read_idx").collect()
    assert [(r["read_idx"], r["id"], r["seq"], r["cnt"], r["qual"]) for r in rows] == [(0, "Uniq1", "acguACGT", 48, None), (1, "two", "TTTT", 3, None), (2, "three", "GG>GA", 1, None)]


@pytest.mark.parametrize("packed", [False, True])
def test_read_fastq(spark, tmp_path, packed):
    path = tmp_path / ("a.fq.gz" if packed else "a.fq")
    path.write_bytes(gzip.compress(FASTQ.encode()) if packed else FASTQ.encode())
    rows = fasta.read_reads(spark, str(path)).orderBy("read_idx").collect()
    assert [(r["id"], r["seq"], r["cnt"], bytes(r["qual"])) for r in rows] == [("r1 size=9 x", "ACGT", 1, b"@III"), ("r2", "GGTA", 1, b"IIII")]


def test_no_known_format(spark, tmp_path):
    for text in ("", "ACGT\n"):
        (tmp_path / "x").write_text(text)
        with pytest.raises(InvalidParam):
            fasta.read_reads(spark, str(tmp_path / "x"))


def test_write_and_read_again(spark, tmp_path):
    records = spark.createDataFrame([(1, "b", "C" * 81), (0, "a", "A" * 80), (2, "c", "")], "tid long, header string, seq string")
    fasta.write_fasta_file(records, str(tmp_path / "out.fa"))
    want = ">a\n" + "A" * 80 + "\n>b\n" + "C" * 80 + "\nC\n>c\n"
    assert (tmp_path / "out.fa").read_text() == want
    fasta.write_fasta(records, str(tmp_path / "dir"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "dir").glob("part-*"))) == want
    back = fasta.read_fasta(spark, str(tmp_path / "out.fa")).orderBy("read_idx")
    assert [r["seq"] for r in back.collect()] == ["A" * 80, "C" * 81]


def test_command_line(spark, tmp_path):
    seqs = ["ACGTTGCAAC" * 6] * 5 + ["GGATCCTTAA" * 6] * 3
    (tmp_path / "in.fa").write_text("".join(f">r{i}\n{s}\n" for i, s in enumerate(seqs)))
    assert main(["fad", "-i", str(tmp_path / "in.fa"), "-o", str(tmp_path / "fad.fa"), "--no-use-sketch"]) == 0
    text = (tmp_path / "fad.fa").read_text()
    assert text.startswith(">helicase_FAD_1 size=5 assigned=5\nACGT") and ">helicase_FAD_2 size=3 assigned=3\n" in text
    assert main(["rad", "-i", str(tmp_path / "in.fa"), "-o", str(tmp_path / "rad.fa")]) == 0
    assert (tmp_path / "rad.fa").read_text().startswith(">helicase_RAD_1 support=5 assigned=5\n")
    args = build_parser().parse_args(["rad", "-i", "a", "-o", "b", "--no-fad-clean", "--cluster-mode", "exact", "--align-band", "-1"])
    assert rad_params(args).consensus.align.band == -1 and not rad_params(args).run_fad_clean


def test_stream(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([("acgu", 2), ("ACGT", 0), ("NN", 1), ("GGGG", i)], "seq string, cnt long").write.mode("append").parquet(str(tmp_path / "in"))
    stream = running_abundance(spark.readStream.schema("seq string, cnt long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("abundance").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert {r["seq"]: r["cnt"] for r in spark.table("abundance").collect()} == {"ACGT": 9, "GGGG": 4}


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["tid", "uid", "seq", "cnt", "assigned"] and rows.count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "orders", "customer", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    columns = sorted(want.columns)
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == columns
    key = lambda rows: sorted(map(repr, rows))
    assert key(tuple(r) for r in got.select(*(F.col(c) for c in columns)).collect()) == key(con.sql(f"SELECT {', '.join(columns)} FROM want").fetchall())


def test_distances_of_reads_without_a_shared_kmer(spark, monkeypatch):
    rng = random.Random(1)
    kmers = lambda s: {min(w, w.translate(str.maketrans("ACGT", "TGCA"))[::-1]) for w in (s[i : i + 6] for i in range(len(s) - 5))}
    while True:
        seqs = ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(2)]
        if not kmers(seqs[0]) & kmers(seqs[1]) and all(len(kmers(s)) == 55 for s in seqs):
            break
    reads = spark.createDataFrame([(i, f"r{i}", s, 3 - 2 * i) for i, s in enumerate(seqs)], "read_idx long, id string, seq string, cnt long")
    monkeypatch.setattr(queries, "reads_a", lambda spark, sf: reads)
    assert [tuple(r) for r in queries.corrected_distance_full(spark, "").collect()] == [(0, 1, 110)]
    assert [tuple(r) for r in queries.corrected_distance_normalized(spark, "").collect()] == [(0, 1, round(1 / 6, 9))]


def _cut_members(raw: bytes, seed: int, many: int) -> bytes:
    rng = random.Random(seed)
    cuts = [0, *sorted(rng.randrange(len(raw) + 1) for _ in range(many - 1)), len(raw)]
    return b"".join(gzip.compress(raw[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True))


@pytest.mark.parametrize(("many", "size"), [(1, 500), (60, 500), (60, 10**6), (7, 97), (300, 400)])
def test_gzip_members_anywhere_give_the_lines_of_the_whole(spark, tmp_path, many, size):
    rng = random.Random(many)
    records = [(f"r{i} é x", "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 30)))) for i in range(120)]
    raw = "".join(f"@{h}\n{s}\n+\n{'I' * len(s)}\n" for h, s in records).encode()
    raw = raw[:-1] if many == 7 else raw
    path = tmp_path / "many.fq.gz"
    path.write_bytes(_cut_members(raw, many, many) + (b"\0" * 40 if many == 60 else b""))
    got = members.read_lines(spark, str(path), size).orderBy("line").collect()
    want = raw.decode().split("\n")
    want = want[:-1] if want[-1] == "" else want
    assert [r["line"] for r in got] == list(range(len(want))) and [r["value"] for r in got] == want
    pieces = members.read_pieces(spark, str(path), size).withColumn("task", F.spark_partition_id())
    tasks = pieces.select("task").distinct().count()
    assert tasks == 1 if many == 1 or size > 10**5 else tasks > 2
    plain = tmp_path / "many.fq"
    plain.write_bytes(raw)
    rows = lambda p: [tuple(r) for r in fasta.read_fastq(spark, str(p)).orderBy("read_idx").collect()]
    assert rows(path) == rows(plain) and len(rows(path)) > 100


def test_gzip_marks_by_chance_and_broken_files(spark, tmp_path):
    marks = b"@r\nAC\n+\nII\n" + b"".join(gzip.compress(bytes([i])) for i in range(20))
    path = tmp_path / "marks.fq.gz"
    path.write_bytes(gzip.compress(marks, 0) + gzip.compress(b"\n@s\nG\n+\nI\n"))  # level 0 stores the marks as they are
    with pytest.raises(Exception, match="no gzip member ends at"):
        members.read_lines(spark, str(path), 40).collect()
    assert members.read_lines(spark, str(path)).count() >= 8
    path.write_bytes(gzip.compress(b"@r\nAC\n+\nII\n" * 50)[:-9])
    with pytest.raises(Exception, match="ends within a gzip member"):
        members.read_lines(spark, str(path)).collect()
