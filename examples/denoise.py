"""Templates behind a handful of reads: python examples/denoise.py"""

from __future__ import annotations

from pyspark.sql import SparkSession

from helicase import FadParams, fad_denoise
from helicase.sources import fasta

READS = [("r1", "ACGTACGTACGT"), ("r2", "ACGTACGTACGT"), ("r3", "ACGTACGTACGA")]


def main() -> None:
    spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    rows = [(i, name, seq, None, 1) for i, (name, seq) in enumerate(READS)]
    reads = spark.createDataFrame(rows, "read_idx long, id string, seq string, qual binary, cnt long")
    result = fad_denoise(reads, FadParams(k=3, min_count=1))
    for record in fasta.fad_records(result.templates).orderBy("tid").collect():
        print(f">{record['header']}\n{record['seq']}")
    spark.stop()


if __name__ == "__main__":
    main()
