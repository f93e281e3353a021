"""Scores recorded answers against a folder of samples from the command line."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.runs import records, replayed, summary
from .sources.files import read_runs, recorded_payloads, samples, write_runs
from .sources.stores import is_store, read_payloads


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--image", help="folder of page images, or one image; by default that of the session")
    p.add_argument("--ground-truth", help="folder of HTML files of the same names, or one file; by default that of the session")
    p.add_argument("--payloads", required=True, help="JSON lines of recorded answers, or a store of them")
    p.add_argument("--family", help="only answers of this family")
    p.add_argument("--output", required=True, help="folder for the run log")
    p.add_argument("--workers", type=int, help="partitions of a shuffle; by default the session's")
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    if a.workers:
        spark.conf.set("spark.sql.shuffle.partitions", a.workers)
    if is_store(a.payloads):
        answers = read_payloads(spark, a.payloads, families=[a.family] if a.family else None)
    else:
        answers = recorded_payloads(spark, a.payloads).where(F.lit(True) if a.family is None else F.col("family") == a.family)
    write_runs(records(replayed(samples(spark, a.image, a.ground_truth).drop("content"), answers)), a.output)
    summary(read_runs(spark, a.output).select("model", "success"), "model").show(truncate=False)


if __name__ == "__main__":
    main()
