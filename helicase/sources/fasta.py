"""FASTA and FASTQ files as DataFrames of reads, and back.

Plain files and gzip (by the extension .gz) are read by Spark's own text source, gzip FASTQ of many members by ranges where Python can
open the path. FASTA is split at lines that begin with ">"; FASTQ records are four lines each, so their lines are numbered within each file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import InvalidParam
from ..functions import sequences as S
from ..operators.derep import READS, numbered
from . import members


def sniff(spark: SparkSession, path: str) -> str:
    """fasta or fastq, by the first character."""
    first = spark.read.text(path).limit(1).collect()
    mark = first[0][0][:1] if first else ""
    if mark not in (">", "@"):
        raise InvalidParam(f"{path} is neither FASTA nor FASTQ")
    return "fasta" if mark == ">" else "fastq"


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Reads with position, id, sequence and count (size= in the header, else 1); records without a sequence are left out."""
    raw = spark.read.option("lineSep", "\n>").text(path).withColumn("at", F.monotonically_increasing_id())
    # each file's first record still has its mark
    body = F.regexp_replace(F.col("value"), "^>", "")
    lines = F.split(F.regexp_replace(body, "\r\n?", "\n"), "\n")
    header = F.trim(lines[0])
    seq = F.array_join(F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.rtrim(x)), "")
    rows = raw.select("at", S.header_id(header).alias("id"), seq.alias("seq"), S.header_size(header).alias("cnt")).where(F.length("seq") > 0)
    return _as_reads(rows.withColumn("qual", F.lit(None).cast("binary")), "at")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """Reads with position, whole header as id, sequence, qualities as they stand, and count 1 whatever the header says.

    Records can't be told from their middle, as quality lines may begin with @ too, so lines are numbered: within each
    block of a file as Spark splits it, plus the lines of the blocks before. A file ends at the first record whose header
    has no @; reads follow the order of the files' names.
    """
    lines = _gzip_lines(spark, path)
    if lines is None:
        raw = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
        sizes = raw.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))
        before = F.sum("n").over(Window.partitionBy("file").orderBy("start")) - F.col("n") - F.col("first")  # a row for each block of a file
        lines = raw.join(F.broadcast(sizes.select("file", "start", before.alias("shift"))), ["file", "start"]).withColumn("line", F.col("at") + F.col("shift"))
    part = lambda i: F.max(F.when(F.col("line") % 4 == i, F.col("value")))
    records = lines.groupBy("file", F.floor(F.col("line") / 4).alias("record")).agg(part(0).alias("head"), part(1).alias("seq"), part(3).alias("qual"))
    good = F.col("head").startswith("@")
    ends = records.where(~good).groupBy("file").agg(F.min("record").alias("end"))
    bare = lambda c, blank: F.coalesce(F.regexp_replace(c, f"{blank}+$", ""), F.lit(""))
    rows = records.join(ends, "file", "left").where(F.col("end").isNull() | (F.col("record") < F.col("end")))
    rows = rows.select("file", "record", F.regexp_replace(F.substr("head", F.lit(2)), r"^\s+|\s+$", "").alias("id"), bare("seq", r"\s").alias("seq"), bare("qual", r"\r").cast("binary").alias("qual"), F.lit(1).cast("long").alias("cnt"))
    return _as_reads(rows, "file", "record")


def _gzip_lines(spark: SparkSession, path: str) -> DataFrame | None:
    """Lines of gzip files by their members, if all files of the path are such and can be opened."""
    files = spark.read.format("binaryFile").load(path).select("path").inputFiles()
    if not files or not all(f.endswith(".gz") for f in files) or not members.can_open(files[0]):
        return None
    return members.read_lines(spark, path)


def _as_reads(rows: DataFrame, *order: str) -> DataFrame:
    return numbered(rows, *order).select(*(c.split()[0] for c in READS.split(", ")))


def read_reads(spark: SparkSession, path: str) -> DataFrame:
    return read_fasta(spark, path) if sniff(spark, path) == "fasta" else read_fastq(spark, path)


def fad_records(templates: DataFrame, prefix: str = "helicase") -> DataFrame:
    """(tid, header, seq), numbered from 1 in order of acceptance."""
    return templates.select("tid", F.format_string(f"{prefix}_FAD_%d size=%d assigned=%d", F.col("tid") + 1, "cnt", "assigned").alias("header"), "seq")


def rad_records(templates: DataFrame, prefix: str = "helicase") -> DataFrame:
    return templates.select("tid", F.format_string(f"{prefix}_RAD_%d support=%d assigned=%d", F.col("tid") + 1, "cluster_size", "assigned").alias("header"), "seq")


def write_fasta(records: DataFrame, path: str, width: int = 80) -> None:
    """Writes (tid, header, seq) in order as text part files, overwriting; `cat path/part-*` is one FASTA file."""
    records.orderBy("tid").select(S.fasta_lines(F.col("header"), F.col("seq"), width).alias("value")).write.mode("overwrite").text(path)


def write_fasta_file(records: DataFrame, path: str, width: int = 80) -> None:
    """One local file, filled row by row; for template sets, which are small beside the reads."""
    with open(path, "w", encoding="ascii") as out:
        for row in records.orderBy("tid").select(S.fasta_lines(F.col("header"), F.col("seq"), width).alias("value")).toLocalIterator():
            out.write(row["value"] + "\n")
