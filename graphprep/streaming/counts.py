"""Incremental counterparts of batch operators on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphprep.functions.text import words


def stream_token_counts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Running counts of the words of text in a folder of Parquet files."""
    docs = spark.readStream.schema(schema).parquet(path)
    return docs.select(F.explode(words(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("cnt"))


def stream_first_of_each(rows: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Rows whose key was not seen within the watermark; state is dropped behind it."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def stream_windows(events: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Events by type in tumbling windows; events later than `late` are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), "event_type").agg(F.count(F.lit(1)).alias("n"))
