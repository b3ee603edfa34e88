"""Counters and the duration histogram over a log of operations ``op, duration_us, messages, bytes, failed``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import BUCKET_VALUES, bucket


def histogram(rows: DataFrame, duration: str = "duration") -> DataFrame:
    """``bucket, observations``; at most ten rows."""
    return rows.where(F.col(duration).isNotNull()).groupBy(bucket(F.col(duration)).alias("bucket")).agg(F.count(F.lit(1)).alias("observations"))


def percentiles(rows: DataFrame, of=(50, 95, 99), duration: str = "duration") -> DataFrame:
    """``percent, value_ns``: the value of the first bucket whose running count reaches floor(total * p); 0 if there are none."""
    h = histogram(rows, duration)
    order = Window.orderBy("bucket")  # ten rows
    h = h.withColumn("upto", F.sum("observations").over(order)).withColumn("total", F.sum("observations").over(Window.partitionBy()))
    values = F.lit(list(BUCKET_VALUES))
    asked = rows.sparkSession.range(1).select(F.explode(F.lit(list(of))).alias("percent"))
    first = asked.join(F.broadcast(h), F.col("upto") >= F.floor(F.col("total") * F.col("percent") / 100), "left").groupBy("percent").agg(F.min("bucket").alias("b"), F.max("total").alias("total"))
    # a target of 0 is reached before the first observation
    at_once = F.floor(F.col("total") * F.col("percent") / 100) == 0
    value = F.when(F.col("b").isNull(), 0).when(at_once, BUCKET_VALUES[0]).otherwise(F.get(values, F.col("b")))
    return first.select(F.col("percent").cast("long").alias("percent"), value.cast("long").alias("value_ns"))


def counters(ops: DataFrame) -> DataFrame:
    """One row of totals by kind of operation; a batch is one operation with many messages."""
    n = lambda c: F.count_if(c)
    op = F.col("op")
    ok = ~F.col("failed")
    return ops.agg(
        n((op == "enqueue") & ok).alias("enqueues"), n((op == "dequeue") & ok).alias("dequeues"), n((op == "batch") & ok).alias("batches"), n((op == "seek") & ok).alias("seeks"),
        n((op == "compact") & ok).alias("compactions"), n(F.col("failed")).alias("errors"), F.coalesce(F.sum(F.when(ok, F.col("messages"))), F.lit(0)).cast("long").alias("messages"),
        F.coalesce(F.sum(F.when(ok, F.col("bytes"))), F.lit(0)).cast("long").alias("bytes"),
    )
