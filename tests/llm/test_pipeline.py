"""The pipeline's stages take effect and keep their columns."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from helicase.llm import line_dedup, suffix_dedup, tables

from . import brute


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, before = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        old = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        docs = tables.keep(stage(spark, docs, sf))
        if i == 4:
            assert {r[0] for r in docs.select("doc_id").distinct().collect()} == set(old)
            break
        assert docs.columns == names
        new = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        if i == 1:
            assert new == {k: v[2] for k, v in brute.lines(old.items()).items()}
        elif i == 2:
            assert new == {k: old[k] for k, v in brute.near(old.items(), 5).items() if v[1] == k}
        elif i == 3:
            assert new == {k: v[3].decode("utf-8", "ignore") for k, v in brute.repeats(old.items(), 100).items()}
        assert 0 < len(new) <= before, name


def test_columns_of_any_name_keep_their_values(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    mine = ["kept", "N_LINES", "n_dropped", "N_Bytes", "n_removed", "n_spans", "Score", "predicted", "component_id"]
    docs = docs.select("*", *(F.concat(F.lit(f"{c}:"), "doc_id").alias(c) for c in mine), F.lit(1).alias("keeper"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        names, docs = docs.columns, tables.keep(stage(spark, docs, sf))
        assert docs.columns == names and 0 < docs.count() <= before
        assert all(r[c] == f"{c}:{r['doc_id']}" for r in docs.collect() for c in mine)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= docs.count()
    small = docs.select("doc_id", "text", "n_lines", F.col("n_removed"))
    assert line_dedup.drop_lines(small).columns == ["doc_id", "text", "n_removed", "n_lines", "n_dropped"]
    assert [c.lower() for c in suffix_dedup.drop_repeats(small).columns] == ["doc_id", "n_lines", "n_bytes", "n_removed", "n_spans", "kept"]
