"""Continuous consumption and deduplication with Structured Streaming.

The checkpoint is the durable cursor. Delivery is at least once: a batch whose handler fails is given again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import expr


def messages(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """The log's Parquet files as a stream, oldest first."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def consume(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, read: int = 1, now: Callable[[], int] | None = None, drain: bool = False, every: str = "100 milliseconds") -> StreamingQuery:
    """Give each micro-batch's live unread messages, in order, to the handler; drain ends at the log's end."""

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.where(F.col("msg_id") >= read)
        if now:
            rows = rows.where(expr.live(now()))
        handler(rows.orderBy("msg_id"), number)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=every)).start()


def dedup(stream: DataFrame, window: int, per_second: int, key: str = "dedup_id", delay: str = "0 seconds") -> DataFrame:
    """Accepted messages ``msg_id, ts, key_hash`` of a stream, first wins within a fixed window.

    ``per_second`` is the unit of ``ts``. The state of a key is one end of window; it goes when the
    watermark, ``delay`` behind the newest message, has passed that end. Messages later than the watermark
    are still decided by the state that is left.
    """
    keyed = stream.select("msg_id", "ts", F.sha2(F.col(key), 256).alias("key_hash"), F.timestamp_micros((F.col("ts") * (1_000_000 / per_second)).cast("long")).alias("at"))

    def decide(keys: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        until = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "msg_id"])
        out = []
        for i, t in zip(rows["msg_id"], rows["ts"], strict=True):
            if until is None or t >= until:
                until = int(t) + window
                out.append((int(i), int(t), keys[0]))
        state.update((until,))
        end = until * 1000 // per_second + 1
        if end > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(end)
        yield pd.DataFrame(out, columns=["msg_id", "ts", "key_hash"]).astype({"msg_id": "int64", "ts": "int64"})

    rows = keyed.withWatermark("at", delay).groupBy("key_hash")
    return rows.applyInPandasWithState(decide, "msg_id long, ts long, key_hash string", "until long", "append", GroupStateTimeout.EventTimeTimeout)
