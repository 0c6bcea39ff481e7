"""Counts over an event log as it grows; an extension, as batch results are the contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_counts(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events, failures and tokens per window and type; rows later than the watermark are left out.

    Works on a stream and on a table alike.
    """
    tokens = F.get_json_object("props", "$.k").cast("long")
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", delay) if rows.isStreaming else rows
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(tokens).alias("tokens")).select(F.col("w.start").alias("start"), "event_type", "n", "tokens")
