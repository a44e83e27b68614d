"""An optional stream over an inbox of JSON lines: each document id once within the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folio.sources.io import DOCUMENT


def stream_documents(spark: SparkSession, path: str, delay: str = "1 day") -> DataFrame:
    rows = spark.readStream.schema(DOCUMENT + ", fetched_at timestamp").json(path)
    return rows.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["doc_id"])
