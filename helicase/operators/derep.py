"""Reads with positions, and their distinct sequences in order of abundance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import SequenceTooShort
from ..functions import sequences as S
from ..plans.scratch import keep

READS = "read_idx long, id string, seq string, qual binary, cnt long"


def numbered(df: DataFrame, *order: str | Column, name: str = "read_idx") -> DataFrame:
    """df with a number from 0, called `name`, in the order of columns that are unique together: places within ranges of the order plus the ranges' sizes."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # ranges are sampled anew for each plan, so places and sizes must come from one table
    placed = keep(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33).alias("__part")
    sizes = placed.groupBy(part).agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__base"))  # a row for each range
    rows = placed.withColumn("__part", part).join(F.broadcast(before), "__part")
    return rows.withColumn(name, F.col("__base") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__part", "__base", "__at")


def checked(reads: DataFrame, k: int, mode: str = "strict") -> DataFrame:
    """reads with cleaned sequences. strict: the query fails at a bad base or a read shorter than k; drop: such reads go."""
    if mode == "drop":
        return reads.where(S.bad_position(F.col("seq")).isNull() & (F.length("seq") >= k)).withColumn("seq", S.clean(F.col("seq")))
    short = F.concat(F.lit(f"{SequenceTooShort.__name__}: a read is shorter than k = {k}: "), F.length("seq"))
    seq = S.validated(F.col("seq"))
    return reads.withColumn("seq", F.when(F.length("seq") < k, F.raise_error(short).cast("string")).otherwise(seq))


def dereplicate(reads: DataFrame) -> DataFrame:
    """(uid, seq, cnt): distinct sequences; abundance counts at least 1 for each read.

    uid is the rank by abundance (most first), length and sequence, so ties have one order and no task orders all.
    """
    found = reads.groupBy("seq").agg(F.sum(F.greatest("cnt", F.lit(1))).alias("cnt"))
    return numbered(found, F.desc("cnt"), F.length("seq"), "seq", name="uid").select("uid", "seq", "cnt")


def membership(reads: DataFrame, unique: DataFrame) -> DataFrame:
    """(uid, read_idx): the distinct sequence of each read."""
    return reads.select("read_idx", "seq").join(unique.select("uid", "seq"), "seq").select("uid", "read_idx")
