"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import logging
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder where it is unset and the master is local, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="helicase-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def keep(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it back: a later loss of executors costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/helicase/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def stage(df: DataFrame, plan: str, name: str, verbose: bool) -> Iterator[None]:
    """Names the Spark jobs of a plan's step; verbose: logs its time."""
    context = df.sparkSession.sparkContext
    context.setJobDescription(f"{plan}: {name}")
    began = time.monotonic()
    try:
        yield
    finally:
        context.setJobDescription(None)
        if verbose:
            logging.getLogger(f"helicase.{plan}").info("%s: %.2f s", name, time.monotonic() - began)
