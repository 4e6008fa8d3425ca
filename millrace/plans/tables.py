"""The driver tables as the engine's relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-31 00:00:00"
#: Records without a time get one from their number: a minute each from here on.
EPOCH = 1_700_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def minute(number: str):
    return F.timestamp_seconds(F.lit(EPOCH) + 60 * (F.col(number) if isinstance(number, str) else F.lit(number)))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("record_id"), F.col("source").alias("source_type"), F.col("lang").alias("container"), minute("doc_id").alias("timestamp"), "text")


CORPUS_SQL = "corpus AS (SELECT CAST(doc_id AS VARCHAR) AS record_id, source AS source_type, lang AS container, make_timestamp((1700000000 + 60 * doc_id) * 1000000) AS timestamp, text FROM documents)"
