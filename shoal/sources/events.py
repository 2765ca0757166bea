"""Event topics: keyed JSON messages from Kafka or from any table with ``key`` and ``value``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_topic(spark: SparkSession, servers: str, topic: str, per_trigger: int = 1_000_000) -> DataFrame:
    """A topic from its earliest offsets, as ``key`` and ``value`` text (needs the Kafka connector package)."""
    raw = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
        .option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", per_trigger).load()
    )
    return raw.select(F.col("key").cast("string"), F.col("value").cast("string"))


def read_events(messages: DataFrame, schema: T.StructType | str) -> DataFrame:
    """``event`` parsed from ``value``; a malformed message keeps its text in ``quarantine`` instead."""
    fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    wide = T.StructType([*fields.fields, T.StructField("_corrupt", T.StringType())])
    parsed = messages.withColumn(
        "event", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("event._corrupt")
    unread = F.col("event").isNull() | bad.isNotNull()
    clean = F.struct(*[F.col(f"event.{f.name}").alias(f.name) for f in fields.fields])
    return parsed.withColumns({"quarantine": F.when(unread, F.col("value")), "event": F.when(~unread, clean)})


def to_messages(df: DataFrame, key: str) -> DataFrame:
    """``key`` and JSON ``value`` of each row, as a topic takes them."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def write_events(messages: DataFrame, servers: str, topic: str, checkpoint: str):
    """Stream ``key`` and ``value`` into a topic (needs the Kafka connector package)."""
    return (
        messages.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
        .option("checkpointLocation", checkpoint).start()
    )
