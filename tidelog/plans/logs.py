"""The driver's tables as message logs. Times are microseconds since 1970 in UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr

NOW = 1706659200000000
READ = 101
BATCH = 50
PER_SEGMENT = 1000
SEGMENT_BYTES = 65536
STARVE = 10 * 86_400_000_000
WINDOW = 6 * 3_600_000_000
RETRIES = 3


def micros(ts: Column) -> Column:
    """Microseconds of a zoneless timestamp, whatever the session's zone."""
    second = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return F.unix_date(ts.cast("date")) * F.lit(86_400_000_000) + F.hour(ts) * F.lit(3_600_000_000) + F.minute(ts).cast("long") * 60_000_000 + second


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as MESSAGE, with ``dedup_id``, ``duration``, ``event_type`` and the entry's ``bytes``."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.col("event_type")
    ts = micros(F.col("ts"))
    ttl = F.when(kind == "view", F.lit(86_400_000_000)).when(kind == "click", F.lit(604_800_000_000))
    return e.select(
        (F.col("event_id") + 1).alias("msg_id"),
        ts.alias("ts"),
        F.col("props").cast("binary").alias("payload"),
        F.when(kind == "error", 2).when(kind == "purchase", 1).otherwise(0).cast("byte").alias("priority"),
        (ts + ttl).alias("expires_at"),
        F.create_map(F.lit("type"), kind, F.lit("user"), F.col("user_id").cast("string")).alias("headers"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("dedup_id"),
        F.floor("value").cast("long").alias("duration"),
        "event_type",
    ).withColumn("bytes", expr.entry_bytes())


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("event_id").alias("seq"), (F.col("event_id") % 97 + 1).alias("msg_id"), F.when(F.col("event_type") == "purchase", "ack").otherwise("nack").alias("outcome"),
        F.concat("event_type", F.lit("\n"), "props").alias("reason"), micros(F.col("ts")).alias("ts"),
    )


def with_faults(log: DataFrame) -> DataFrame:
    k = (F.col("msg_id") - 1) % 10
    return log.select(
        F.col("msg_id").alias("row_id"), F.when(k == 1, 0).otherwise(F.col("msg_id")).alias("msg_id"), F.when(k == 2, 0).otherwise(F.col("ts")).alias("ts"),
        F.when(k == 0, 3).otherwise(F.col("priority").cast("int")).alias("priority"), F.when(k == 3, F.col("ts")).otherwise(F.col("expires_at")).alias("expires_at"), "payload", "headers",
    )


def operations(log: DataFrame) -> DataFrame:
    """A log of operations: what each message's event stands for."""
    op = F.when(F.col("event_type") == "view", "dequeue").when(F.col("event_type") == "click", "enqueue").when(F.col("event_type") == "signup", "batch").when(F.col("event_type") == "purchase", "seek").otherwise("compact")
    return log.select(op.alias("op"), "duration", F.when(F.col("event_type") == "signup", F.col("duration")).otherwise(1).alias("messages"), F.octet_length("payload").cast("long").alias("bytes"), (F.col("msg_id") % 50 == 0).alias("failed"))
