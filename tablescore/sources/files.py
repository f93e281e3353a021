"""Folders of page images and ground truth, recorded payloads, and the run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import stem, strip
from .stores import write_files

IMAGES = "*.{png,jpg,jpeg}"
SCORES = T.StructType([T.StructField("levenshtein", T.DoubleType()), T.StructField("teds", T.DoubleType())])
#: A run: success has a result and scores, failure an error; times are seconds, timestamp is in seconds since 1970.
RUN = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("processor", "model", "image_path", "ground_truth_path")),
    *(T.StructField(n, T.DoubleType()) for n in ("processing_time", "grading_time", "total_time")),
    T.StructField("result", T.StringType()), T.StructField("error", T.StringType()), T.StructField("scores", SCORES), T.StructField("timestamp", T.DoubleType()), T.StructField("success", T.BooleanType()),
])
LEADERBOARD = T.StructType([T.StructField("models", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("levenshtein", T.DoubleType()), T.StructField("teds", T.DoubleType())])))])
SPEED = T.StructType([T.StructField("models", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("time_seconds", T.DoubleType())])))])


def images(spark: SparkSession, folder: str, content: bool = True) -> DataFrame:
    """(stem, image_path, content) of the images right in folder."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", IMAGES).option("recursiveFileLookup", "false").load(folder)
    return found.select(stem(F.col("path")).alias("stem"), F.col("path").alias("image_path"), *(["content"] if content else []))


def ground_truth(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, ground_truth_path, gt_html) of the HTML files right in folder, stripped."""
    found = spark.read.option("pathGlobFilter", "*.html").text(folder, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return found.select(stem(F.col("path")).alias("stem"), F.col("path").alias("ground_truth_path"), strip(F.col("value")).alias("gt_html"))


def paired(images: DataFrame, truths: DataFrame) -> DataFrame:
    """Images that have a ground truth of the same stem."""
    return images.join(truths, "stem")


def required(pairs: DataFrame) -> DataFrame:
    """pairs, or an error if there are none."""
    if pairs.isEmpty():
        raise ValueError("no image has a ground truth of the same name")
    return pairs


def is_file(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(at) and not fs.getFileStatus(at).isDirectory()


#: Settings of the session that name the samples to take where none are given.
DEFAULT_IMAGES, DEFAULT_TRUTHS = "spark.tablescore.images", "spark.tablescore.truths"


def samples(spark: SparkSession, images_at: str | None = None, truths_at: str | None = None) -> DataFrame:
    """Pairs from two folders by name, or of two single files whatever their names. Without either, those of the
    session's settings DEFAULT_IMAGES and DEFAULT_TRUTHS."""
    if images_at is None and truths_at is None:
        images_at, truths_at = spark.conf.get(DEFAULT_IMAGES, None), spark.conf.get(DEFAULT_TRUTHS, None)
    if images_at is None or truths_at is None:
        raise ValueError("images and ground truth are given together or by the session")
    found, truths = images(spark, images_at), ground_truth(spark, truths_at)
    if is_file(spark, images_at) and is_file(spark, truths_at):
        truths = truths.withColumn("stem", stem(F.lit(images_at)))
    return required(paired(found, truths))


def encoded(content: Column) -> Column:
    """Base 64 without line breaks."""
    return F.regexp_replace(F.base64(content), r"\s+", "")


def data_uri(path: Column, content: Column) -> Column:
    kind = F.when(F.lower(path).endswith(".png"), "image/png").otherwise("image/jpeg")
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), encoded(content))


MAX_SIDE = 8000
MAX_MB, QUALITIES, LAST_QUALITY = 4.8, tuple(range(95, 69, -5)), 85


def scaled_size(width: Column, height: Column) -> Column:
    """(width, height) at which an image is sent: twice its size, but no side above MAX_SIDE."""
    w, h = width * 2, height * 2
    longest = F.greatest(w, h)
    scale = F.lit(float(MAX_SIDE)) / longest
    small = F.struct((w * scale).cast("int").alias("width"), (h * scale).cast("int").alias("height"))
    return F.when(longest > MAX_SIDE, small).otherwise(F.struct(w.cast("int").alias("width"), h.cast("int").alias("height")))


def sending_plan(width: Column, height: Column, megabytes: Column) -> Column:
    """(quality, width, height) of the image that is sent; megabytes: sizes at QUALITIES. The first that is small
    enough is taken; if none is, the sides shrink by the root of what is too much."""
    fits = F.array_position(F.transform(megabytes, lambda m: m <= MAX_MB), True)
    shrink = F.sqrt(F.lit(MAX_MB) / F.element_at(megabytes, -1))
    found = F.struct(F.get(F.array(*map(F.lit, QUALITIES)), (fits - 1).cast("int")).alias("quality"), width.cast("int").alias("width"), height.cast("int").alias("height"))
    return F.when(fits > 0, found).otherwise(F.struct(F.lit(LAST_QUALITY).alias("quality"), (width * shrink).cast("int").alias("width"), (height * shrink).cast("int").alias("height")))


def recorded_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(stem, family, model, payload, status, seconds) of answers that were recorded as JSON lines."""
    return spark.read.schema("stem string, family string, model string, payload string, status string, seconds double").json(path)


#: The part of a run log's file name that stands for a processor and a model.
LOG_NAME = r"(.*)_(?:result|error)(?:\.\d+)?\.json"


def write_runs(runs: DataFrame, path: str, files: int = 1) -> None:
    """The run log as JSON lines, in a file for each processor, model and outcome; slashes in names are underscores.

    The files of a processor and model are replaced as a whole when the job is done, those of others stay. A log whose
    models have very many runs is dealt into so many files for each by image.
    """
    outcome = F.when(F.col("success"), "result").otherwise("error")
    part = F.pmod(F.xxhash64("image_path"), F.lit(files))
    number = F.when(part > 0, F.concat(F.lit("."), part.cast("string"))).otherwise("")
    name = F.concat(F.translate(F.concat_ws("_", "processor", "model"), "/", "_"), F.lit("_"), outcome, number, F.lit(".json"))
    rows = runs.select(name.alias("file"), F.to_json(F.struct(*RUN.names)).alias("content"))
    write_files(rows.repartition("file").sortWithinPartitions("file"), path, "\n", LOG_NAME)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN).json(path)


def read_models(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The models of an aggregate file (LEADERBOARD or SPEED), one in a row."""
    return spark.read.schema(schema).option("multiLine", "true").json(path).select(F.inline("models"))
