"""Segments: rotation, offsets, sparse index, retention. Sizes come as a column ``bytes`` of each entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import segment_name
from ..options import Retention

HEADER = 64
INTERVAL = 4096
#: Bounds that are put in a plan as they are.
MAX_LITERALS = 5000


def by_count(log: DataFrame, most: int) -> DataFrame:
    """``segment`` 0, 1, ...: an expression of the id, so no shuffle and partitions can be pruned by it."""
    return log.withColumn("segment", F.floor((F.col("msg_id") - 1) / most).cast("long"))


def boundaries(log: DataFrame, max_bytes: int = 0, max_messages: int = 0, max_time: int = 0, carry: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """``segment, first_id``: where each segment of a size, count or time rotation begins.

    A segment is closed before a write once it holds max_bytes, max_messages or lasts max_time; where it
    closes depends on where it began, so sizes pass through one task in order, with a few numbers of state.
    Rows are sorted by ranges of ids in parallel and packed, some thousand to a value, into 4 bytes each (more
    where ids have gaps or times count); the one task puts the values in order and folds them. A log that is
    appended to needs this for the new rows only: ``carry`` is the open segment's ordinal, bytes and messages.
    """

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            ids, sizes, ts = (b.column(c).to_numpy() for c in ("msg_id", "bytes", "ts"))
            if not len(ids):
                continue
            gaps = b"" if ids[-1] - ids[0] == len(ids) - 1 else ids.tobytes()
            wide = sizes.max() >= 1 << 31 or sizes.min() < 0
            row = {"first": [int(ids[0])], "n": [len(ids)], "ids": [gaps], "sizes": [(sizes if wide else sizes.astype(np.int32)).tobytes()], "ts": [ts.tobytes() if max_time else b""]}
            yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("first", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("ts", pa.binary())]))

    def fold(batches):
        import numpy as np
        import pyarrow as pa

        ordinal, held, count = carry
        began, opened = None, carry[1] > 0 or carry[2] > 0
        for first, n, ids, sizes, ts in ((v.as_py() for v in row) for b in batches for row in zip(*b.columns, strict=True)):
            ids = np.frombuffer(ids, np.int64) if ids else np.arange(first, first + n)
            sizes = np.frombuffer(sizes, np.int64 if len(sizes) == 8 * n else np.int32)
            ts = np.frombuffer(ts, np.int64) if ts else np.zeros(n, np.int64)
            total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            out, at = [], 0
            if n and not opened:
                out.append((ordinal, int(ids[0])))
                opened, began = True, int(ts[0])
            if n and began is None:
                began = int(ts[0])
            while at < n:
                # the first row before which the segment is full
                stop = n
                if max_bytes:
                    stop = min(stop, max(at, int(np.searchsorted(total, total[at] + max_bytes - held))))
                if max_messages:
                    stop = min(stop, max(at, at + max_messages - count))
                if max_time:
                    stop = min(stop, max(at, int(np.searchsorted(ts, began + max_time))))
                if stop < n:
                    ordinal += 1
                    held, count, at, began = 0, 0, stop, int(ts[stop])
                    out.append((ordinal, int(ids[stop])))
                else:
                    held += int(total[n] - total[at])
                    count += n - at
                    at = n
            cols = list(zip(*out, strict=True)) if out else [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["segment", "first_id"])

    rows = log.select(F.col("msg_id").cast("long").alias("msg_id"), F.col("bytes").cast("long").alias("bytes"), F.col("ts").cast("long").alias("ts"))
    packed = rows.repartitionByRange("msg_id").sortWithinPartitions("msg_id").mapInArrow(pack, "first long, n long, ids binary, sizes binary, ts binary")
    return packed.repartition(1).sortWithinPartitions("first").mapInArrow(fold, "segment long, first_id long")


def assign(log: DataFrame, bounds: DataFrame) -> DataFrame:
    """log with the ``segment`` each id falls in; ids before the first bound have none.

    Up to MAX_LITERALS bounds, a row for each segment, are an array in the plan that is searched in place.
    Beyond, bounds and ids are dealt by spans of ids as long as a segment on average, and meet there.
    """
    b = bounds.orderBy("first_id").limit(MAX_LITERALS + 1).collect()
    if not b:
        return log.withColumn("segment", F.lit(None).cast("long"))
    if len(b) > MAX_LITERALS:
        return _assign_by_spans(log, bounds)
    starts, names = (F.lit([r[c] for r in b]).cast("array<long>") for c in ("first_id", "segment"))
    # binary search for the last start at or before the id
    powers = F.lit([1 << k for k in range(len(b).bit_length() - 1, -1, -1)])
    lo = F.aggregate(powers, F.lit(0), lambda acc, k: F.when(F.get(starts, acc + k - 1) <= F.col("msg_id"), acc + k).otherwise(acc))
    return log.withColumn("segment", F.when(lo > 0, F.get(names, lo - 1)))


def _assign_by_spans(log: DataFrame, bounds: DataFrame) -> DataFrame:
    facts = bounds.agg(F.count(F.lit(1)).alias("n"), F.min("first_id").alias("a"), F.max("first_id").alias("z")).first()
    top = max(facts["z"], log.agg(F.max("msg_id")).first()[0] or 0) + 1
    span = max(1, (top - facts["a"]) // facts["n"])
    # one row for each segment: a window over all of them is small beside the log
    until = F.lead("first_id").over(Window.orderBy("first_id"))
    b = bounds.select("segment", "first_id", F.coalesce(until, F.lit(top)).alias("__to"))
    own = F.explode(F.sequence(F.floor(F.col("first_id") / span), F.floor((F.col("__to") - 1) / span))).alias("__span")
    b = b.where("__to > first_id").select(F.col("segment").alias("__segment"), F.col("first_id").alias("__from"), "__to", own)
    rows = log.drop("segment").withColumn("__span", F.floor(F.col("msg_id") / span))
    met = rows.join(b, (rows["__span"] == b["__span"]) & (F.col("msg_id") >= F.col("__from")) & (F.col("msg_id") < F.col("__to")), "left")
    return met.select(*[rows[c] for c in rows.columns if c != "__span"], F.col("__segment").alias("segment"))


def offsets(log: DataFrame) -> DataFrame:
    """``offset`` of each entry in its segment's file. A segment's size is bounded by rotation, so its window is too."""
    w = Window.partitionBy("segment").orderBy("msg_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return log.withColumn("offset", F.lit(HEADER) + F.sum("bytes").over(w) - F.col("bytes"))


def at(log: DataFrame, segment: int, offset: int) -> DataFrame:
    """The entry at an offset of a segment, if one begins there, with ``next_offset``; log has ``segment`` and ``offset``."""
    return log.where((F.col("segment") == segment) & (F.col("offset") == offset)).withColumn("next_offset", F.col("offset") + F.col("bytes"))


def onward(log: DataFrame, segment: int, offset: int = HEADER) -> DataFrame:
    """The entries of a segment from an offset on, in order."""
    return log.where((F.col("segment") == segment) & (F.col("offset") >= offset)).orderBy("offset")


def summary(log: DataFrame, most: int, first_base: int = 1) -> DataFrame:
    """A row for each segment: ``base, name, min_id, max_id, messages, bytes, modified, is_active``."""
    seg = log.groupBy("segment").agg(F.min("msg_id").alias("min_id"), F.max("msg_id").alias("max_id"), F.count(F.lit(1)).alias("messages"), F.sum("bytes").alias("bytes"), F.max("ts").alias("modified"))
    seg = seg.withColumn("base", F.col("segment") * most + first_base)
    last = Window.orderBy(F.desc("segment"))  # a row for each segment
    return seg.withColumn("name", segment_name(F.col("base"))).withColumn("is_active", F.row_number().over(last) == 1)


def duplicate_bases(segments: DataFrame) -> DataFrame:
    return segments.groupBy("base").agg(F.count(F.lit(1)).alias("files")).where("files > 1")


def sparse_index(log: DataFrame, interval: int = INTERVAL) -> DataFrame:
    """``segment, msg_id, offset, ts`` of the entries that a sparse index holds: the first, then each ``interval`` bytes on.

    log has ``segment`` and ``offset``. A segment, which rotation bounds, is passed in order in batches.
    """

    def pick(batches):
        import numpy as np
        import pyarrow as pa

        segment, last = None, 0
        for b in batches:
            seg, off = b.column("segment").to_numpy(), b.column("offset").to_numpy()
            take = []
            edges = [0, *(np.flatnonzero(np.diff(seg)) + 1), len(seg)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                at = lo
                if seg[lo] != segment:
                    segment, last = seg[lo], off[lo]
                    take.append(lo)
                    at = lo + 1
                while (at := at + int(np.searchsorted(off[at:hi], last + interval))) < hi:
                    take.append(at)
                    last = off[at]
                    at += 1
            yield b.take(pa.array(take, pa.int64()))

    rows = log.select(*[F.col(c).cast("long").alias(c) for c in ("segment", "msg_id", "offset", "ts")])
    return rows.repartition("segment").sortWithinPartitions("segment", "msg_id").mapInArrow(pick, "segment long, msg_id long, offset long, ts long")


def index_floor(index: DataFrame, probes: DataFrame) -> DataFrame:
    """``segment, msg_id, floor_id, floor_offset``: for each probe the last index entry of its segment at or before it.

    An as-of join by a running last value over both sides in order, so no row meets more than one other.
    """
    side = index.select("segment", "msg_id", F.struct(F.col("msg_id").alias("i"), F.col("offset").alias("o")).alias("e"))
    ask = probes.select("segment", "msg_id", F.lit(None).cast("struct<i:long,o:long>").alias("e"), F.lit(1).alias("side"))
    w = Window.partitionBy("segment").orderBy("msg_id", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = side.withColumn("side", F.lit(0)).unionByName(ask)
    found = both.withColumn("e", F.last("e", ignorenulls=True).over(w)).where("side = 1")
    return found.select("segment", "msg_id", F.col("e.i").alias("floor_id"), F.col("e.o").alias("floor_offset"))


def removable(closed: DataFrame, policy: Retention, now: int, read: int | None = None) -> DataFrame:
    """The closed segments (``base, bytes, modified``) that retention removes.

    In order of base: the oldest go while there are more than max_segments, if older than max_age, or if
    what is from them on is over max_size; min_segments and the last one stay. The oldest beyond
    max_segments are removed first of all, so the fold is a running count. With ``read``, segments that
    hold unread messages (``max_id`` at or past it) stay.
    """
    order = Window.orderBy("base")  # a row for each segment
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.count(F.lit(1)).over(everything)
    rows = closed.withColumn("__n", n).withColumn("__i", F.row_number().over(order) - 1)
    rows = rows.withColumn("__rest", F.sum("bytes").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    hit: Column = F.lit(False)
    if policy.max_age:
        hit = hit | (F.lit(now) - F.col("modified") > policy.max_age)
    if policy.max_segments:
        hit = hit | (F.col("__n") - F.col("__i") > policy.max_segments)
    if policy.max_size:
        hit = hit | (F.col("__rest") > policy.max_size)
    rows = rows.withColumn("__hit", hit & (F.col("__i") < F.col("__n") - 1))
    rows = rows.withColumn("__gone", F.sum(F.col("__hit").cast("long")).over(upto))
    rows = rows.where(F.col("__hit") & (F.col("__gone") <= F.col("__n") - policy.min_segments))
    if read is not None:
        rows = rows.where(F.col("max_id") < read)
    return rows.drop("__n", "__i", "__rest", "__hit", "__gone")
