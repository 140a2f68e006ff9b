"""Landing of webhook deliveries as raw rows (headers plus untouched body)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake import schemas

# HTTP header names, compared in lower case.
EVENT_HEADER = "x-github-event"
SIGNATURE_HEADER = "x-hub-signature-256"


def raw_event_stream(
    spark: SparkSession, folder: str, file_format: str = "parquet", **options: str
) -> DataFrame:
    """Stream of raw events from files in the ``RAW_EVENTS`` schema."""
    reader = spark.readStream.format(file_format).schema(schemas.RAW_EVENTS)
    return reader.options(**options).load(folder)


def raw_events_from_messages(messages: DataFrame) -> DataFrame:
    """Raw events from a message-queue frame, streaming or batch.

    Expects the columns of Spark's Kafka source read with
    ``includeHeaders=true``: ``key``, ``value``, ``timestamp`` and ``headers``.
    """

    def header(name: str):
        match = F.filter("headers", lambda entry: F.lower(entry["key"]) == name)
        return F.try_element_at(match, F.lit(1))["value"].cast("string")

    return messages.select(
        F.col("key").cast("string").alias("delivery_id"),
        F.col("timestamp").alias("received_at"),
        header(EVENT_HEADER).alias("event_header"),
        header(SIGNATURE_HEADER).alias("signature"),
        F.col("value").alias("body"),
    )
