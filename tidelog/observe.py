"""Hooks for metrics and log lines: what a log calls, a collector, and a listener for streams."""

from __future__ import annotations

import logging
import threading
from dataclasses import dataclass, field

from pyspark.sql.streaming import StreamingQueryListener

from .functions.expr import BUCKET_ENDS, BUCKET_VALUES

#: Level names by their number, 0 to 3.
LEVELS = ("DEBUG", "INFO", "WARN", "ERROR")


def level_name(level: int) -> str:
    return LEVELS[level] if 0 <= level < len(LEVELS) else "UNKNOWN"


class Metrics:
    """What a log reports; sizes in bytes, times in nanoseconds. Each method does nothing: override what is wanted."""

    def enqueued(self, size: int, took: int) -> None: ...

    def dequeued(self, size: int, took: int) -> None: ...

    def enqueued_batch(self, count: int, size: int, took: int) -> None: ...

    def dequeued_batch(self, count: int, size: int, took: int) -> None: ...

    def enqueue_failed(self) -> None: ...

    def dequeue_failed(self) -> None: ...

    def sought(self) -> None: ...

    def compacted(self, segments: int, size: int, took: int) -> None: ...

    def compaction_failed(self) -> None: ...

    def state(self, pending: int, segments: int, next_id: int, read_id: int) -> None: ...


def _histogram() -> list[int]:
    return [0] * len(BUCKET_VALUES)


@dataclass
class Snapshot:
    """Totals since the last reset."""

    enqueues: int = 0
    dequeues: int = 0
    enqueue_batches: int = 0
    dequeue_batches: int = 0
    enqueue_errors: int = 0
    dequeue_errors: int = 0
    seeks: int = 0
    enqueued_bytes: int = 0
    dequeued_bytes: int = 0
    compactions: int = 0
    compaction_errors: int = 0
    segments_removed: int = 0
    bytes_freed: int = 0
    last_compaction: int = 0
    pending: int = 0
    segments: int = 0
    next_id: int = 0
    read_id: int = 0
    enqueue_times: list[int] = field(default_factory=_histogram)
    dequeue_times: list[int] = field(default_factory=_histogram)

    def percentile(self, times: list[int], share: float) -> int:
        """The value in nanoseconds of the first bucket whose running count reaches floor(total * share); 0 if there are none."""
        total, upto = sum(times), 0
        if not total:
            return 0
        for n, value in zip(times, BUCKET_VALUES, strict=True):
            upto += n
            if upto >= int(total * share):
                return value
        return BUCKET_VALUES[-1]


class Collector(Metrics):
    """Counts everything a log reports, for any number of threads."""

    def __init__(self, name: str = "", clock=None):
        import time

        self.name, self.clock, self._lock, self._now = name, clock or time.time, threading.Lock(), Snapshot()

    def _add(self, took: int | None = None, times: str = "", **counts: int) -> None:
        with self._lock:
            for k, n in counts.items():
                setattr(self._now, k, getattr(self._now, k) + n)
            if took is not None:
                micros = took // 1000
                getattr(self._now, times)[next((i for i, end in enumerate(BUCKET_ENDS) if micros < end), len(BUCKET_ENDS))] += 1

    def enqueued(self, size, took):
        self._add(took, "enqueue_times", enqueues=1, enqueued_bytes=size)

    def dequeued(self, size, took):
        self._add(took, "dequeue_times", dequeues=1, dequeued_bytes=size)

    def enqueued_batch(self, count, size, took):
        self._add(took, "enqueue_times", enqueues=count, enqueue_batches=1, enqueued_bytes=size)

    def dequeued_batch(self, count, size, took):
        self._add(took, "dequeue_times", dequeues=count, dequeue_batches=1, dequeued_bytes=size)

    def enqueue_failed(self):
        self._add(enqueue_errors=1)

    def dequeue_failed(self):
        self._add(dequeue_errors=1)

    def sought(self):
        self._add(seeks=1)

    def compacted(self, segments, size, took):
        self._add(compactions=1, segments_removed=segments, bytes_freed=size)
        with self._lock:
            self._now.last_compaction = int(self.clock())

    def compaction_failed(self):
        self._add(compaction_errors=1)

    def state(self, pending, segments, next_id, read_id):
        with self._lock:
            self._now.pending, self._now.segments, self._now.next_id, self._now.read_id = pending, segments, next_id, read_id

    def snapshot(self) -> Snapshot:
        from dataclasses import replace

        with self._lock:
            return replace(self._now, enqueue_times=list(self._now.enqueue_times), dequeue_times=list(self._now.dequeue_times))

    def reset(self) -> None:
        with self._lock:
            self._now = Snapshot()


class StreamMetrics(StreamingQueryListener):
    """Reports the batches of streaming queries over a log: ``spark.streams.addListener(StreamMetrics(collector))``.

    Rows are counted as Spark counts them: as often as a batch reads them, twice where its handler sorts.
    """

    def __init__(self, metrics: Metrics):
        self.metrics = metrics

    def onQueryStarted(self, event): ...

    def onQueryProgress(self, event):
        p = event.progress
        if p.numInputRows:
            self.metrics.dequeued_batch(p.numInputRows, 0, int(p.batchDuration or 0) * 1_000_000)

    def onQueryIdle(self, event): ...

    def onQueryTerminated(self, event):
        if event.exception:
            self.metrics.dequeue_failed()


class Logger:
    """Where a log writes its lines; fields are key words. By default Python's logging, under the name ``tidelog``."""

    def __init__(self, to: logging.Logger | None = None):
        self.to = to or logging.getLogger("tidelog")

    def _line(self, level: int, text: str, fields: dict) -> None:
        if self.to.isEnabledFor(level):
            self.to.log(level, "%s%s", text, "".join(f" {k}={v}" for k, v in fields.items()))

    def debug(self, text: str, **fields) -> None:
        self._line(logging.DEBUG, text, fields)

    def info(self, text: str, **fields) -> None:
        self._line(logging.INFO, text, fields)

    def warn(self, text: str, **fields) -> None:
        self._line(logging.WARNING, text, fields)

    def error(self, text: str, **fields) -> None:
        self._line(logging.ERROR, text, fields)
