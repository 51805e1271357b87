"""From documents to packed training sequences: five stages, each over all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helicase.llm import line_dedup, minhash, packing, quality, suffix_dedup, tables


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as quality 0 go."""
    names = docs.columns
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    added = tables.unused(docs, "score"), tables.unused(docs, "predicted")  # columns of these names stay as they are
    return quality.score(docs, model, added=added).where(F.col(added[1]) == 1).select(*names)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines of many documents stay in one of them; n_chars follows the text."""
    names = docs.columns
    added = tuple(tables.unused(docs, c) for c in line_dedup.ADDED)
    return line_dedup.drop_lines(docs, added=added).withColumn("n_chars", F.length("text").cast("long")).select(*names)


def keep_one_near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the smallest doc_id stays."""
    kept = minhash.near_duplicates(docs).where("kept").select("doc_id").hint("merge")
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that also start earlier are cut out; n_chars follows the text."""
    names = docs.columns
    added = tuple(tables.unused(docs, c) for c in suffix_dedup.ADDED)
    return suffix_dedup.drop_repeats(docs, as_text=True, added=added).withColumn("n_chars", F.length("text").cast("long")).select(*names)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False, encode_special_tokens=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", reject_low_quality),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", keep_one_near_duplicate),
    ("suffix-array dedup", cut_repeated_passages),
    ("best-fit packing", pack_sequences),
]

#: Classifier, tokenizer and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = tables.keep(docs)
    return docs
