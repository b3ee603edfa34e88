"""Reads of the log as lazy queries. The cursor, the next id and ``now`` are parameters; nothing is changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..errors import InvalidMessage, NoMessages, NotFound
from ..functions import expr

MAX_SKIPPED = 1000


def pending(log: DataFrame, read: int, now: int) -> DataFrame:
    """Unread live messages; both conditions reach the Parquet scan."""
    return log.where((F.col("msg_id") >= read) & expr.live(now))


def fifo(log: DataFrame, read: int, now: int) -> DataFrame:
    return pending(log, read, now).orderBy("msg_id")


def expired_messages(log: DataFrame, now: int) -> DataFrame:
    return log.where(expr.expired(now))


def batch_candidates(log: DataFrame, read: int, next_id: int, n: int, now: int, consumed: DataFrame | None = None) -> DataFrame:
    """The rows a batch read of n checks, with ``alive``, ``kept`` (live so far) and ``whole`` (no id missing so far).

    At most n + 1000 rows, whatever the log's size. Messages in ``consumed`` (distinct ``msg_id``), taken out of
    turn, are passed over like expired ones.
    """
    if n <= 0:
        raise InvalidMessage("batch size must be > 0")
    avail = next_id - read
    if avail <= 0:
        raise NoMessages()
    most = min(min(n, avail) + MAX_SKIPPED, avail)
    rows = log.where((F.col("msg_id") >= read) & (F.col("msg_id") < read + most))
    order = Window.orderBy("msg_id")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    live = expr.live(now)
    if consumed is not None:
        taken = consumed.where((F.col("msg_id") >= read) & (F.col("msg_id") < read + most)).select("msg_id", F.lit(True).alias("__taken"))
        rows = rows.join(F.broadcast(taken), "msg_id", "left")  # at most n + 1000 ids
        live = live & F.col("__taken").isNull()
    rows = rows.withColumn("alive", live).drop("__taken").withColumn("whole", F.row_number().over(order) == F.col("msg_id") - read + 1)
    return rows.where("whole").withColumn("kept", F.sum(F.col("alive").cast("long")).over(upto))


def batch(log: DataFrame, read: int, next_id: int, n: int, now: int, consumed: DataFrame | None = None) -> DataFrame:
    """At most n live messages in order; expired and consumed ones are passed over, the first missing id ends the batch."""
    rows = batch_candidates(log, read, next_id, n, now, consumed)
    return rows.where(F.col("alive") & (F.col("kept") <= n)).drop("alive", "whole", "kept")


def batch_cursor(log: DataFrame, read: int, next_id: int, n: int, now: int, consumed: DataFrame | None = None) -> DataFrame:
    """``new_read``: one past the n-th live row, else past the last row checked."""
    rows = batch_candidates(log, read, next_id, n, now, consumed)
    nth = F.min(F.when(F.col("alive") & (F.col("kept") == n), F.col("msg_id")))
    return rows.agg((F.coalesce(nth, F.max("msg_id"), F.lit(read - 1)) + 1).alias("new_read"))


def next_message(log: DataFrame, read: int, now: int) -> DataFrame:
    """The next live message and ``new_read``; only the first rows of the scan are kept on each task."""
    return fifo(log, read, now).limit(1).withColumn("new_read", F.col("msg_id") + 1)


def priority_order(log: DataFrame, read: int, now: int, window: int, consumed: DataFrame | None = None) -> DataFrame:
    """Live unread messages in priority order at one instant, with ``rank``; ``consumed`` has ids already taken."""
    rows = pending(log, read, now)
    if consumed is not None:
        rows = rows.join(consumed.select("msg_id"), "msg_id", "left_anti")
    return rows.withColumn("rank", expr.rank(now, window)).orderBy("rank", "msg_id")


def priority_paced(log: DataFrame, read: int, now: int, step: int, n: int, window: int) -> DataFrame:
    """n dequeues in priority order, the k-th (from 0) at ``now + k * step``: promotion and expiry seen anew each time.

    Each dequeue depends on the one before, so one task takes them in turn. It gets no more than it may
    need, whatever the log's size: a message that lives for K of the n turns has before it all earlier ones of
    its priority that live for K turns too, so only the first K of those can be taken; 3 n^2 / 2 rows at most.
    """
    turns = F.ceil((F.col("expires_at") - now) / step) if step > 0 else F.lit(n)
    turns = F.when(F.col("expires_at").isNull(), n).otherwise(F.least(F.lit(n), turns)).cast("int")
    rows = pending(log, read, now).select("msg_id", "ts", "priority", "expires_at", turns.alias("__k"))
    place = F.row_number().over(Window.partitionBy("priority", "__k").orderBy("msg_id"))
    # the limit by a constant is applied before the shuffle
    rows = rows.withColumn("__r", place).where(F.col("__r") <= n).where("__r <= __k")

    def drain(batches):
        import pandas as pd

        rows = pd.concat(list(batches)).sort_values("msg_id")
        queues = {p: list(rows[rows.priority == p].itertuples(index=False)) for p in (0, 1, 2)}
        at = {p: 0 for p in queues}
        out = []
        for k in range(n):
            t = now + k * step
            for p in queues:
                while at[p] < len(queues[p]) and not pd.isna(queues[p][at[p]].expires_at) and t >= queues[p][at[p]].expires_at:
                    at[p] += 1
            head = {p: queues[p][at[p]] for p in queues if at[p] < len(queues[p])}
            if not head:
                break
            starved = window > 0 and 0 in head and t - head[0].ts >= window
            p = 0 if starved else max(head)
            out.append((k, int(head[p].msg_id)))
            at[p] += 1
        yield pd.DataFrame(out, columns=["k", "msg_id"]).astype("int64")

    return rows.select("msg_id", "ts", "priority", "expires_at").coalesce(1).mapInPandas(drain, "k long, msg_id long")


def oldest_by_priority(log: DataFrame, read: int) -> DataFrame:
    return log.where(F.col("msg_id") >= read).groupBy("priority").agg(F.min("msg_id").alias("msg_id"))


def count_by_priority(log: DataFrame, read: int) -> DataFrame:
    return log.where(F.col("msg_id") >= read).groupBy("priority").agg(F.count(F.lit(1)).alias("messages"))


def next_in_priority(log: DataFrame, priority: int, after: int) -> DataFrame:
    return log.where((F.col("priority") == priority) & (F.col("msg_id") > after)).agg(F.min("msg_id").alias("msg_id"))


def seek_id(msg_id: int, next_id: int) -> int:
    """The cursor for an id, whether or not the log still holds it."""
    if msg_id <= 0:
        raise InvalidMessage("message ID must be > 0")
    if msg_id >= next_id:
        raise NotFound(f"message ID {msg_id} not yet written")
    return msg_id


def replay(log: DataFrame, msg_id: int) -> DataFrame:
    return log.where(F.col("msg_id") >= msg_id)


def seek_time(log: DataFrame, ts: int) -> DataFrame:
    """``msg_id`` of the first message at or after a time, null if none."""
    return log.where(F.col("ts") >= ts).agg(F.min("msg_id").alias("msg_id"))


def between(log: DataFrame, start: int, end: int) -> DataFrame:
    return log.where((F.col("ts") >= start) & (F.col("ts") < end))


def with_header(log: DataFrame, key: str, value: str) -> DataFrame:
    return log.where(F.col("headers")[key] == value)


def peek(log: DataFrame, read: int, next_id: int, n: int, now: int, consumed: DataFrame | None = None) -> DataFrame:
    """A batch without a cursor: id, time, and the payload's first bytes."""
    return batch(log, read, next_id, n, now, consumed).select("msg_id", "ts", expr.preview(F.col("payload")).alias("payload"), expr.written_headers(F.col("headers")).alias("headers"))


def dense_ids(rows: DataFrame, *order, start: int = 1, name: str = "msg_id") -> DataFrame:
    """rows with dense ids from ``start`` in the given order, without putting all rows in one task.

    Rows are dealt by ranges of the order; the ranges' sizes, one row each, give each range its offset.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    placed = cut(placed)  # the ranges come from a sample: fix them before they are counted
    part = F.shiftright("__m", 33)
    sizes = placed.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = sizes.withColumn("__b", F.sum("__n").over(before) - F.col("__n")).drop("__n")
    # one row for each partition, so the broadcast is bounded
    out = placed.withColumn("__p", part).join(F.broadcast(sizes), "__p")
    return out.withColumn(name, F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__b") + start).drop("__m", "__p", "__b")


def stats(log: DataFrame, read: int, dlq: int = 0, retries: int = 0, dedup: int = 0, segments: int = 0) -> DataFrame:
    """One row: totals by id, so that removed messages still count, as cursors do."""
    top = F.coalesce(F.max("msg_id"), F.lit(0))
    return log.agg(
        top.alias("total"), F.greatest(top + 1 - read, F.lit(0)).alias("pending"), (top + 1).alias("next_id"), F.lit(read).cast("long").alias("read_id"),
        F.lit(segments).cast("long").alias("segments"), F.lit(dlq).cast("long").alias("dlq"), F.lit(retries).cast("long").alias("retries"), F.lit(dedup).cast("long").alias("dedup"),
    )


def consumed_percent(of: DataFrame) -> DataFrame:
    share = F.format_string("%.1f%%", (F.col("total") - F.col("pending")) * 100.0 / F.col("total"))
    return of.withColumn("consumed", F.when(F.col("total") > 0, share))


def inspect(of: DataFrame) -> DataFrame:
    """The statistics as one JSON document."""
    return consumed_percent(of).select(F.to_json(F.struct("*")).alias("document"))


def recovered_next(log: DataFrame) -> DataFrame:
    return log.agg((F.coalesce(F.max("msg_id"), F.lit(0)) + 1).alias("next_id"))
