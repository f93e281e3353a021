"""Structured Streaming over the run log: scoring as rows arrive, and windowed success counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scoring import score_tables
from ..sources.files import RUN


def stream_runs(spark: SparkSession, path: str, files_at_a_time: int = 100) -> DataFrame:
    """Run records as files of JSON lines arrive under path."""
    return spark.readStream.schema(RUN).option("maxFilesPerTrigger", files_at_a_time).json(path)


def score_stream(pairs: DataFrame, metrics: tuple[str, ...] = ("levenshtein",)) -> DataFrame:
    """Scores of pairs as they arrive; no state."""
    return score_tables(pairs, metrics=metrics)


def success_by_window(runs: DataFrame, late: str = "10 minutes", width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Successes and runs of each model in each window of event time; rows later than late are dropped."""
    r = runs.withColumn("at", F.timestamp_micros((F.col("timestamp") * 1e6).cast("long"))).withWatermark("at", late)
    return r.groupBy(F.window("at", width, slide) if slide else F.window("at", width), "model").agg(F.count_if("success").alias("successes"), F.count(F.lit(1)).alias("runs"))


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """A query that appends Parquet files, once for each input even across restarts."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode)
