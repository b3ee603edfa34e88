"""Acknowledgements, retries and dead letters, from a log of outcomes.

outcomes has ``seq`` (their order), ``msg_id``, ``outcome`` (ack or nack), ``reason`` and ``ts``. An ack
clears a message's count; every max-th nack since then sends it to the dead letters and clears it too. Both
are running counts, so window functions are enough.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr


def _counted(outcomes: DataFrame) -> DataFrame:
    upto = Window.partitionBy("msg_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    acks = F.sum((F.col("outcome") == "ack").cast("long")).over(upto)
    since = Window.partitionBy("msg_id", "__i").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return outcomes.withColumn("__i", acks).where("outcome = 'nack'").withColumn("nacks", F.sum(F.lit(1)).over(since))


def dead(outcomes: DataFrame, max_retries: int) -> DataFrame:
    """``seq, msg_id, retry_count, reason, ts`` of the nacks that send a message to the dead letters."""
    rows = _counted(outcomes)
    if max_retries == 0:
        return rows.limit(0).select("seq", "msg_id", F.col("nacks").alias("retry_count"), "reason", "ts")
    return rows.where(F.col("nacks") % max_retries == 0).select("seq", "msg_id", F.lit(max_retries).cast("long").alias("retry_count"), expr.sanitize(F.col("reason")).alias("reason"), "ts")


def state(outcomes: DataFrame, max_retries: int) -> DataFrame:
    """``msg_id, retry_count, last_failure, reason`` of the messages with open retries."""
    acks = F.max(F.when(F.col("outcome") == "ack", F.col("seq")))
    last = outcomes.groupBy("msg_id").agg(acks.alias("__a"))
    nacks = outcomes.where("outcome = 'nack'").join(last, "msg_id").where("__a IS NULL OR seq > __a")
    n = nacks.groupBy("msg_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("ts", "seq").alias("last_failure"), F.max_by("reason", "seq").alias("reason"))
    live = F.col("n") % max_retries if max_retries else F.col("n")
    return n.withColumn("retry_count", live.cast("long")).where("retry_count > 0").select("msg_id", "retry_count", "last_failure", "reason")


def dead_letters(log: DataFrame, died: DataFrame, written: bool = False) -> DataFrame:
    """The dead-letter rows: payload and headers of the message with four headers more; time to live and priority are not kept.

    Nacks of messages that the log does not hold give none.
    """
    rows = died.join(log.select("msg_id", "payload", "headers"), "msg_id")
    when = expr.iso_millis(F.col("ts")) if not written else F.col("ts").cast("string")
    headers = expr.enrich_dlq(F.col("headers"), F.col("msg_id"), F.col("retry_count"), F.col("reason"), when)
    return rows.select("seq", "payload", headers.alias("headers"))


def requeued(dead_rows: DataFrame) -> DataFrame:
    """What goes back to the log: the payload, and the headers without the four."""
    return dead_rows.withColumn("headers", expr.strip_dlq(F.col("headers")))
