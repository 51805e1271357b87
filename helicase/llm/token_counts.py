"""Token counts from the exact length histogram.

Documents are aggregated by their encoded length; suffix sums over the histogram then answer totals, quantiles and
truncated totals for every context limit without another pass over the texts. The sums are taken in blocks of lengths:
within a block by a window, between blocks by the blocks' totals.

Edge cases: a null or empty text has length 0; an empty table gives an empty histogram, total 0 and no quantile; rows count one by one,
also those that share a doc_id or have none; texts of any length are encoded whole, in a step of their own; further columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tables, text
from .bpe import read_ranks
from .pretokens import Encoded

BLOCK = 1024


@functools.cache
def _counter(path: str) -> Encoded:
    import tiktoken

    coder = tiktoken.Encoding("counts", pat_str=r"(?s).+", mergeable_ranks=read_ranks(path), special_tokens={})
    return Encoded(lambda words: [coder._encode_single_piece(w) for w in words])


def lengths(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens) of every document, special tokens' strings being ordinary text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _counter(path)
        for batch, data, at in text.steps(batches, text.STEP_BYTES // 2):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(table.encode(data, at)[1])], ["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long")


def histogram(counted: DataFrame) -> DataFrame:
    """For each length that occurs, taken as a context limit:

    n_docs of that length; docs_at_least and tokens_at_least, the suffix sums; truncated_total, the tokens left if every
    document is cut at the limit; share, the part of the documents that the limit holds whole.
    """
    by = counted.groupBy(F.col("n_tokens").alias("n_tokens")).agg(F.count("*").alias("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    by = tables.keep(by)  # read twice below, so that texts are encoded once
    # a row for each block of lengths that occurs: no more than the longest document has blocks
    total = by.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = total.select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t"), F.sum("d").over(every).alias("docs"), F.sum("t").over(every).alias("tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    rows = by.withColumns({"d_in": F.sum("n_docs").over(inside), "t_in": F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside)}).join(total, "block")
    docs, tokens = F.col("d") + F.col("d_in"), F.col("t") + F.col("t_in")
    return rows.select(
        "n_tokens", "n_docs", docs.alias("docs_at_least"), tokens.alias("tokens_at_least"),
        (F.col("tokens") - tokens + F.col("n_tokens") * docs).alias("truncated_total"),
        ((F.col("docs") - docs + F.col("n_docs")) / F.col("docs")).alias("share"),
    )


def total(sums: DataFrame, limit: int | None = None) -> int:
    """Tokens in all, or those left if every document is cut at `limit`, any number."""
    if limit is None:
        row = sums.agg(F.max("tokens_at_least")).first()
        return row[0] or 0
    row = sums.agg(F.max("tokens_at_least").alias("t"), F.max(F.when(F.col("n_tokens") >= limit, F.struct(F.col("docs_at_least"), F.col("tokens_at_least")))).alias("m")).first()
    over = row["m"]
    return (row["t"] or 0) - (over[1] - limit * over[0] if over else 0)


def quantile(sums: DataFrame, q: float) -> int | None:
    """The least length that holds at least a share q of the documents whole."""
    return sums.where(F.col("share") >= q).agg(F.min("n_tokens")).first()[0]
