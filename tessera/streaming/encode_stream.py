"""Encoding streams, and running popcount statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.encode import encode
from tessera.operators.stats import popcount_stats
from tessera.plans.schema import Schema


def encode_stream(stream: DataFrame, schema: Schema, secret: bytes | str, row_id: str, validate: bool = True) -> DataFrame:
    """A streaming table with an id column and the schema's columns to row_id, clk, popcount and error.

    Bad entries are marked, not raised, so that one of them does not stop the stream.
    """
    rest = [c for c in stream.columns if c != row_id]
    named = stream.select(F.col(row_id).alias("row_id"), *[F.col(f"`{c}`") for c in rest])
    return encode(named, schema, secret, validate, errors="column")


def write_encoded(encoded: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends encodings as Parquet; the checkpoint folder must be shared by all executors."""
    writer = encoded.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def running_stats(encoded: DataFrame) -> DataFrame:
    """Mean and spread of popcounts so far; for complete output mode."""
    return popcount_stats(encoded)


def windowed_stats(encoded: DataFrame, time: str, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Popcount statistics by event-time window, for streams that keep a time column."""
    grouped = encoded.withWatermark(time, late).groupBy(F.window(time, window).alias("w"))
    return grouped.agg(F.count("popcount").alias("n"), F.avg("popcount").alias("mean"))
