"""Running dereplication of a stream of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as S


def running_abundance(reads: DataFrame) -> DataFrame:
    """(seq, cnt) so far, for a streaming DataFrame with seq and cnt; write it in the update or complete mode.

    The state holds a row for each distinct sequence; reads with a bad base are left out, as a stream can't fail for one.
    """
    return reads.where(S.bad_position(F.col("seq")).isNull()).groupBy(S.clean(F.col("seq")).alias("seq")).agg(F.sum(F.greatest("cnt", F.lit(1))).alias("cnt"))
