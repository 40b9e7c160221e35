"""Batch and stream sources of messages and membership events, and the mapping of the driver's tables onto them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guildward import schemas

#: The sample events are too sparse to flood; one millisecond of message time is so many of event time (fixed value).
COMPRESSION, EPOCH_MS = 10_000, 1_704_067_200_000


def read(spark: SparkSession, path: str, fmt: str = "parquet", stream: bool = False, schema: str = schemas.MESSAGES, **options: str) -> DataFrame:
    """Messages from files or, as a stream, from a growing folder of them."""
    reader = (spark.readStream if stream else spark.read).format(fmt).schema(schema)
    return reader.options(**options).load(path)


def members(events: DataFrame, kind: str) -> DataFrame:
    """Membership events of a kind: request, added or removed."""
    return events.where(F.col("kind") == kind)


def from_events(events: DataFrame) -> DataFrame:
    """(message_id, guild_id, user_id, t_ms) of the sample event table; times are rounded to milliseconds."""
    ms = F.expr("(unix_micros(cast(ts as timestamp)) + 500) div 1000")
    return events.select(
        F.col("event_id").alias("message_id"),
        F.col("event_type").alias("guild_id"),
        F.col("user_id").cast("string").alias("user_id"),
        (F.floor((ms - EPOCH_MS) / COMPRESSION) + 1).cast("long").alias("t_ms"),
    )
