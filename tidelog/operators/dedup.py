"""Deduplication: within a fixed window from an accepted message, later ones of its key are duplicates.

Whether a message is accepted depends on the last accepted one of its key, so a key's messages are passed
in order: dealt by key, sorted, and streamed with one accepted message of state. No key is gathered, so a
key with a third of all rows costs its task time, not memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidMessage


def decide(log: DataFrame, window: int, key: str = "dedup_id", own_window: str | None = None) -> DataFrame:
    """``key_hash, msg_id, ts, original_id, expires_at``: original_id is the message's own if it is accepted.

    A duplicate does not extend the window, and at its very end a message is accepted. ``own_window`` names
    a column with a window for each message, 0 or null for the default. Empty or null keys are an error.
    With a default window of 0 nothing is tracked: all are accepted.
    """
    if window < 0:
        raise InvalidMessage("deduplication window must not be negative")
    given = F.when((F.col(key).isNull()) | (F.col(key) == ""), F.raise_error(F.lit("deduplication ID cannot be empty"))).otherwise(F.sha2(F.col(key), 256))
    w = F.lit(window).cast("long")
    if own_window:
        own = F.coalesce(F.col(own_window), F.lit(0)).cast("long")
        w = F.when(own < 0, F.raise_error(F.lit("deduplication window must not be negative")).cast("long")).when(own > 0, own).otherwise(w)
    rows = log.select(given.alias("key_hash"), F.col("msg_id").cast("long").alias("msg_id"), F.col("ts").cast("long").alias("ts"), w.alias("w"))
    if window == 0:
        return rows.select("key_hash", "msg_id", "ts", F.col("msg_id").alias("original_id"), F.col("ts").alias("expires_at"))

    def run(batches):
        import pyarrow as pa

        last_key, until, original = None, 0, 0
        for b in batches:
            keys, ids, times, windows = (b.column(c).to_pylist() for c in ("key_hash", "msg_id", "ts", "w"))
            first, ends = [], []
            for k, i, t, x in zip(keys, ids, times, windows, strict=True):
                if k != last_key or t >= until:
                    last_key, until, original = k, t + x, i
                first.append(original)
                ends.append(until)
            yield pa.RecordBatch.from_arrays([b.column("key_hash"), b.column("msg_id"), b.column("ts"), pa.array(first, pa.int64()), pa.array(ends, pa.int64())], names=["key_hash", "msg_id", "ts", "original_id", "expires_at"])

    ordered = rows.repartition("key_hash").sortWithinPartitions("key_hash", "ts", "msg_id")
    return ordered.mapInArrow(run, "key_hash string, msg_id long, ts long, original_id long, expires_at long")


def accepted(decided: DataFrame) -> DataFrame:
    return decided.where("msg_id = original_id")


def duplicates(decided: DataFrame) -> DataFrame:
    return decided.where("msg_id <> original_id")


def state(decided: DataFrame, now: int) -> DataFrame:
    """What is tracked at ``now``: ``key_hash, msg_id, expires_at`` of accepted messages whose window is open."""
    return accepted(decided).where(F.lit(now) < F.col("expires_at")).select("key_hash", "msg_id", "expires_at")


def clean(tracked: DataFrame, now: int) -> DataFrame:
    return tracked.where(F.lit(now) < F.col("expires_at"))


def counts(tracked: DataFrame, now: int) -> DataFrame:
    return tracked.agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.lit(now) < F.col("expires_at")).alias("active"))
