"""Lines of gzip files of many members, such as sequencers write, read by several tasks.

A file is cut into byte ranges. A task looks for the first member that starts in its range, by the mark of a gzip header and by
inflating what follows, and goes on from member to member until one starts beyond the range; the last one is read to its end. So a file of one
member is read by one task. Members may end within a line: each gives its pieces of lines and its number of line breaks, the breaks of the
members before give a piece its line, and the pieces of a line are put together. That each member starts where another ends
is checked over all of them, so no chance mark can pass for one: a file that stores whole gzip files within a member raises an error where a
range begins in these, and is read by a `size` beyond its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_MARK = b"\x1f\x8b\x08"
#: Bytes that are read at once, that a mark's member is tried on, and that a batch of lines holds.
READ, TRIAL, BATCH = 1 << 20, 1 << 18, 1 << 23
_ROWS = "file string, member long, piece long, value binary, breaks long, stop long"


def _open(file: str) -> pa.NativeFile:
    system, path = pa.fs.FileSystem.from_uri(file)
    return system.open_input_file(path)


def can_open(file: str) -> bool:
    """Whether Python can open the file's kind of path; the tasks read it by themselves."""
    try:
        with _open(file):
            return True
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False


def _is_member(source: pa.NativeFile, at: int) -> bool:
    source.seek(at)
    head = source.read(TRIAL)
    if len(head) < 18 or head[3] & 0xE0:
        return False
    try:
        zlib.decompressobj(31).decompress(head, 1 << 20)
    except zlib.error:
        return False
    return True


def first_member(source: pa.NativeFile, start: int, stop: int) -> int | None:
    """Where the first member within [start, stop) starts."""
    at = start
    while at < stop:
        source.seek(at)
        data = source.read(min(READ, stop - at) + len(_MARK) - 1)
        i = data.find(_MARK)
        while i >= 0 and at + i < stop:
            if _is_member(source, at + i):
                return at + i
            i = data.find(_MARK, i + 1)
        at += READ
    return None


def _pieces(source: pa.NativeFile, file: str, start: int, stop: int) -> Iterator[pa.RecordBatch]:
    """Pieces of lines of all members that start in [start, stop), and a row without a value for each member, with its breaks and its end."""
    rows: list[tuple] = []
    held = 0

    def flush() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["file", "member", "piece", "value", "breaks", "stop"])

    member = first_member(source, start, stop)
    while member is not None and member < stop:
        inflate, at, breaks, tail = zlib.decompressobj(31), member, 0, []
        source.seek(at)
        while not inflate.eof:
            data = source.read(READ)
            if not data:
                raise EOFError(f"{file} ends within a gzip member")
            at += len(data)
            while data:
                out = inflate.decompress(data, BATCH)
                lines = out.split(b"\n")
                for line in lines[:-1]:
                    rows.append((file, member, breaks, b"".join([*tail, line]), None, None))
                    tail, breaks = [], breaks + 1
                tail.append(lines[-1])
                held += len(out)
                if held > BATCH and rows:
                    yield flush()
                    rows, held = [], 0
                data = inflate.unconsumed_tail
        at -= len(inflate.unused_data)
        rest = b"".join(tail)
        if rest:
            rows.append((file, member, breaks, rest, None, None))
        rows.append((file, member, None, None, breaks, at))
        source.seek(at)
        member = at if source.read(len(_MARK)) == _MARK else None  # zeros may fill up a file's end
    if rows:
        yield flush()


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, start, stop in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "stop")), strict=True):
            with _open(file) as source:
                yield from _pieces(source, file, start, stop)


def read_pieces(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """The pieces of all files of a path, by ranges of `size` bytes (as Spark's own file sources cut them, by default)."""
    if size is None:
        size = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length").where("length > 0")
    ranges = files.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))))
    ranges = ranges.select("file", "start", F.least(F.col("start") + size, F.col("length")).alias("stop"))
    many = ranges.count()  # a row for each range
    return ranges.repartition(max(1, many), "file", "start").mapInArrow(_run, _ROWS)


def read_lines(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """(file, line, value): the lines of gzip files, numbered from 0 within each."""
    pieces = read_pieces(spark, path, size)
    # a row for each member
    ends = pieces.where("piece is null").select("file", "member", "breaks", "stop")
    order = Window.partitionBy("file").orderBy("member")
    starts_right = F.col("member") == F.coalesce(F.lag("stop").over(order), F.lit(0))
    before = F.coalesce(F.sum("breaks").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wrong = F.raise_error(F.concat(F.lit("no gzip member ends at "), F.col("member").cast("string"), F.lit(" in "), "file"))
    ends = ends.select("file", "member", F.when(starts_right, before).otherwise(wrong.cast("long")).alias("before"))
    lines = pieces.where("piece is not null").join(ends, ["file", "member"]).select("file", (F.col("before") + F.col("piece")).alias("line"), F.struct("member", "value").alias("p"))
    whole = lines.groupBy("file", "line").agg(F.array_sort(F.collect_list("p")).alias("p"))  # one piece but where members meet
    value = F.aggregate("p", F.lit("").cast("binary"), lambda s, p: F.concat(s, p["value"]))
    return whole.select("file", "line", value.cast("string").alias("value"))
