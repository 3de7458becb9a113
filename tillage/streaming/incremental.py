"""The batch cleaning plan on a stream of new observation files."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from tillage.plans.crop import clean_observations
from tillage.schemas import CROP_COLUMNS, text_schema


def clean_new_files(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append the cleaned rows of each new CSV file to a Parquet table, exactly once, then stop.

    Cleaning is row by row, so the stream holds no state; duplicates and lags need the whole table and stay in batch.
    """
    raw = spark.readStream.schema(text_schema(CROP_COLUMNS)).option("header", True).csv(source)
    cleaned = clean_observations(raw)
    return cleaned.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
