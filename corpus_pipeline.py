"""A corpus pipeline of five training-data operators.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept; all but
the last return the columns of documents. run() applies them in order and hands each the Parquet
files that the one before has written to the shared folder.

Every stage keeps all columns, whatever their names and whatever else they are called by the operators, but that the
last one sets the column copy. An empty table passes as an empty one. Texts of any length are read whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tablescore.llm import decontaminate, langid, mixing, pii, simhash
from tablescore.llm.common import delete, shared_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fit a learned language. A null text and one without a letter fit none. Rows that repeat a doc_id are judged
    each by its text; without any lang to learn from nothing fits."""
    return langid.recognised(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id. Of rows that share a doc_id one stays, that
    whose columns have the smallest hash; rows without doc_id all stay. Null and empty texts are near-duplicates of each other."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. A null or empty text has none; rows that repeat a doc_id are judged each by
    its text; items without words mark nothing."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced; none is left out. A null text stays null, and of overlapping spans the first names the run."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, a row for each copy, numbered in the column copy. A null source is one of its own, a
    text without words is never taken; equal finish times go by source, and rows alike in id, source and size by their texts' hash."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("language id", language_id),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("pii redaction", redaction),
    ("source mixing", mixture),
]

#: SQL has neither the models nor XXH64.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. The files of a stage are deleted once the next one's are written; the last ones stay, as the result reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        if k:
            delete(spark, f"{folder}/{k - 1}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
