"""A log on shared storage: the only part that changes anything.

Data is Parquet under ``data/<batch>/segment=<ordinal>``, each batch in a folder with a name of its own. What
is committed is the highest state file ``state/<version>.json``, made exclusively: it names the batches of
data, of ids taken out of turn and of deduplication keys, so what a dead writer left behind is never read.
A write shows up whole or not at all, with everything that belongs to it; readers have no side effects; of
two writers one fails with Locked, and a writer that dies holds nothing.

A state names at most BATCHES batches itself; full lists go into files of their own that the state names.
Old state files are removed, all but the last KEPT.
"""

from __future__ import annotations

import json
import os
import shutil
import threading
import time
import uuid
from collections.abc import Callable, Iterable
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from . import schema
from .errors import InvalidMessage, Locked, LogClosed, LogError, NoMessages, NotFound
from .functions import codec, expr
from .operators import dedup, retry, segments, views
from .options import Options, Retention, check_disjoint, check_path
from .sources.store import Store

INPUT = "payload binary, ttl long, headers map<string,string>, priority byte, compression byte"
START = {"next": 1, "read": 1, "segment": 0, "held": 0, "count": 0, "opened": 0, "retry": {}, "removed_below": 0, "removed": [], "lists": [], "data": [], "consumed": [], "dedup": None, "sent": []}
#: Batches a state names itself, ids files it names before they are made one, and state files that are kept.
BATCHES, FOLD, KEPT = 1000, 64, 100


class Log:
    def __init__(self, spark: SparkSession, path: str, options: Options | None = None, clock: Callable[[], int] = time.time_ns):
        self.spark, self.path, self.options, self.clock = spark, check_path(path), options or Options(), clock
        if self.options.dlq_path:
            check_disjoint(self.path, self.options.dlq_path)
        self.store = Store(spark, self.path)
        free = self.options.min_free_bytes and self._free_bytes()
        if free is not None and free < self.options.min_free_bytes:
            raise LogError("not enough free disk space")
        self.metrics, self.logger = self.options.metrics, self.options.logger
        self.closed = False
        self._done = threading.Event()

    def _free_bytes(self) -> int | None:
        """Free space where the log is, or is to be; None where a store does not tell."""
        if "://" in self.path:
            left = self.store.fs.getStatus(self.store.path(self.path)).getRemaining() if self.store.fs.exists(self.store.path(self.path)) else self.store.fs.getStatus().getRemaining()
            return left if 0 < left < 1 << 62 else None
        at = os.path.abspath(self.path)
        while not os.path.exists(at):
            at = os.path.dirname(at)
        return shutil.disk_usage(at).free

    # state

    def _open(self) -> None:
        if self.closed:
            raise LogClosed()

    @property
    def version(self) -> int:
        return max((int(n.split(".")[0]) for n in self.store.names("state") if n.endswith(".json")), default=0)

    @property
    def state(self) -> dict:
        v = self.version
        return START | json.loads(self.store.read(f"state/{v:020d}.json")) if v else dict(START)

    def _commit(self, version: int, **changes) -> None:
        state = self.state
        if self.version != version - 1:
            raise Locked("another writer has committed")
        new = START | state | changes
        if len(new["data"]) > BATCHES:
            name = f"lists/{uuid.uuid4().hex}.json"
            self.store.create(name, json.dumps(new["data"]).encode())
            new |= {"data": [], "lists": [*new["lists"], name]}
        if not self.store.create(f"state/{version:020d}.json", json.dumps(new).encode()) or self.version > version + KEPT // 2:
            raise Locked("another writer has committed")
        if version % KEPT == 0:
            for n in self.store.names("state"):
                if int(n.split(".")[0]) <= version - KEPT:
                    self.store.delete(f"state/{n}")

    @contextmanager
    def _reported(self, failed: Callable[[], None]):
        try:
            yield
        except Exception as error:
            failed()
            self.logger.debug("operation failed", error=error)
            raise

    # reading

    def table(self) -> DataFrame:
        """The committed entries with payloads as they were given."""
        self._open()
        rows = self.entries()
        payload = F.when(F.col("compression") > 0, codec.gunzip(F.when(F.col("compression") > 0, F.col("payload")))).otherwise(F.col("payload"))
        return rows.withColumn("payload", payload) if self._compressed() else rows

    def _compressed(self) -> bool:
        return bool(self.state.get("compressed"))

    def entries(self) -> DataFrame:
        state = self.state
        names = [n for name in state["lists"] for n in json.loads(self.store.read(name))] + state["data"]
        if not names:
            return self.spark.createDataFrame([], schema.ENTRY)
        rows = self.spark.read.schema(schema.ENTRY).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/{n}" for n in names]).select(*schema.ENTRY.names)
        rows = rows.where(F.col("segment") >= state["removed_below"]) if state["removed_below"] else rows
        return rows.where(~F.col("segment").isin(state["removed"])) if state["removed"] else rows

    def segment(self, ordinal: int) -> DataFrame:
        """The entries of one segment with their offsets in it; other segments are not read."""
        return segments.offsets(self.entries().where(F.col("segment") == ordinal))

    def read_at(self, ordinal: int, offset: int) -> Row:
        """The entry at an offset of a segment."""
        self._open()
        got = segments.at(self.segment(ordinal), ordinal, offset).collect()
        if not got:
            raise NotFound(f"no entry at offset {offset} of segment {ordinal}")
        return got[0]

    def segments(self) -> DataFrame:
        return segments.summary(self.entries(), self.options.rotation.max_messages)

    # writing

    def enqueue(self, payload: bytes, ttl: int | None = None, headers: dict | None = None, priority: int = 0, compression: int | None = None) -> int:
        """Append one message and return its id. Prefer ``append``: each call is a job."""
        if ttl is not None and ttl <= 0:
            raise InvalidMessage("TTL must be positive")
        began = time.perf_counter_ns()
        with self._reported(self.metrics.enqueue_failed):
            made = self._append(self._rows([(bytes(payload), ttl, headers or None, priority, self.options.compression if compression is None else compression)]), empty_ok=True)[0]
        self.metrics.enqueued(len(payload), time.perf_counter_ns() - began)
        return made

    def enqueue_batch(self, payloads: Iterable[bytes]) -> tuple[int, int]:
        began, given = time.perf_counter_ns(), [bytes(p) for p in payloads]
        with self._reported(self.metrics.enqueue_failed):
            made = self._append(self._rows([(p, None, None, 0, 0) for p in given]), empty_ok=True)
        self.metrics.enqueued_batch(len(given), sum(map(len, given)), time.perf_counter_ns() - began)
        return made

    def _rows(self, rows: list[tuple]) -> DataFrame:
        if not rows:
            raise InvalidMessage("empty batch")
        return self.spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], INPUT + ", order long")

    def append(self, rows: DataFrame, *order: str) -> tuple[int, int]:
        """Append rows with ``payload`` and any of ``ttl, headers, priority, compression``, ids in the given order.

        All rows are checked before anything is written. Returns the first and last id.
        """
        began = time.perf_counter_ns()
        with self._reported(self.metrics.enqueue_failed):
            first, last = self._append(self._shaped(rows, *order), empty_ok=False)
        self.metrics.enqueued_batch(last - first + 1, 0, time.perf_counter_ns() - began)
        return first, last

    def _shaped(self, rows: DataFrame, *order: str) -> DataFrame:
        have = set(rows.columns)
        kinds = dict(x.strip().split(" ", 1) for x in INPUT.replace("map<string,string>", "map<string;string>").split(","))
        cols = [(F.col(c) if c in have else F.lit(None)).cast(k.replace(";", ",")).alias(c) for c, k in kinds.items()]
        default = self.options.compression
        rows = rows.select(*cols, F.struct(*order).alias("order") if order else F.monotonically_increasing_id().alias("order"))
        rows = rows.withColumn("priority", F.coalesce("priority", F.lit(0)).cast("byte"))
        rows = rows.withColumn("compression", F.when(F.coalesce("compression", F.lit(0)) == 0, default).otherwise(F.col("compression")).cast("byte"))
        return rows.withColumn("ttl", F.when(F.col("ttl") > 0, F.col("ttl")))

    def _append(self, rows: DataFrame, empty_ok: bool, **also) -> tuple[int, int]:
        """``also`` is committed with the rows."""
        self._open()
        state, version, now = self.state, self.version + 1, self.clock()
        if not empty_ok and rows.where(F.octet_length("payload") == 0).limit(1).count():
            raise InvalidMessage("payload cannot be empty")
        rows = views.dense_ids(rows, "order", start=state["next"])
        rows = rows.withColumn("ts", F.lit(now).cast("long")).withColumn("expires_at", F.col("ts") + F.col("ttl"))
        rows = rows.withColumn("headers", F.when(F.size("headers") > 0, F.col("headers")))
        codes = expr.invalid_reason(self.options.max_message_bytes)
        facts = rows.agg(F.count(F.lit(1)).alias("n"), F.min(codes).alias("bad"), F.max("compression").alias("z"), F.count_if(F.col("payload").isNull()).alias("none")).first()
        if not facts["n"]:
            raise InvalidMessage("empty batch")
        if facts["bad"] or facts["none"]:
            raise InvalidMessage(f"invalid {facts['bad'] or 'payload'}")
        packed = bool(facts["z"])
        if packed:
            z = codec.compress(self.options.compression_level, self.options.compression_min_bytes)
            rows = rows.withColumn("__z", F.when(F.col("compression") > 0, z(F.when(F.col("compression") > 0, F.col("payload")))))
            rows = rows.withColumn("payload", F.coalesce("__z.payload", "payload")).withColumn("compression", F.coalesce("__z.compression", F.lit(0)).cast("byte")).drop("__z")
        rows = rows.withColumn("bytes", expr.entry_bytes(compression="compression")).withColumn("entry_type", F.lit(schema.DATA).cast("byte"))
        r = self.options.rotation
        limits = {"max_bytes": r.max_bytes if r.by in ("size", "both") else 0, "max_messages": r.max_messages if r.by in ("count", "both") else 0, "max_time": r.max_time if r.by == "time" else 0}
        bounds = segments.boundaries(rows, **limits, carry=(state["segment"], state["held"], state["count"]))
        bounds = bounds.unionByName(self.spark.createDataFrame([(state["segment"], 0)], "segment long, first_id long")).groupBy("first_id").agg(F.max("segment").alias("segment"))
        rows = segments.assign(rows, bounds).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.ENTRY.fields])
        batch = f"batch={version:020d}-{uuid.uuid4().hex[:8]}"
        rows.write.partitionBy("segment").parquet(f"{self.path}/data/{batch}")
        done = self.spark.read.parquet(f"{self.path}/data/{batch}")
        last = done.agg(F.max("segment")).first()[0]
        held = done.where(F.col("segment") == last).agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")).first()
        same = last == state["segment"]
        first, end = state["next"], state["next"] + facts["n"] - 1
        changes = {"next": end + 1, "segment": int(last), "held": int(held["b"] + (state["held"] if same else 0)), "count": int(held["n"] + (state["count"] if same else 0)), "compressed": packed or self._compressed()}
        self._commit(version, **changes, data=[*state["data"], batch], opened=state["opened"] if same and state["opened"] else now, **also)
        self.logger.debug("appended", first=first, last=end, segment=int(last))
        return first, end

    def append_distinct(self, rows: DataFrame, *order: str, key: str = "dedup_id", window: int = 0) -> DataFrame:
        """Append the rows whose key is new within its window; returns the keys tracked from now on.

        A window of 0 takes the log's; if that is 0 too nothing is tracked and all rows are written.
        """
        self._open()
        default = self.options.dedup_window
        if not default:
            self.append(rows, *order)
            return self.spark.createDataFrame([], schema.DEDUP)
        now, w = self.clock(), window or default
        tracked = self.dedup_state(now)
        keyed = rows.where(F.when(F.col(key).isNull() | (F.col(key) == ""), F.raise_error(F.lit("deduplication ID cannot be empty")).cast("boolean")).otherwise(True)).withColumn("key_hash", F.sha2(F.col(key), 256))
        fresh = keyed.join(tracked.select("key_hash"), "key_hash", "left_anti").withColumn("__o", F.struct(*order) if order else F.monotonically_increasing_id())
        firsts = fresh.groupBy("key_hash").agg(F.min_by(F.struct(*rows.columns), "__o").alias("r"), F.min("__o").alias("__o"))
        new = firsts.select("key_hash", "r.*", "__o")
        start = self.state["next"]
        ids = views.dense_ids(new, "__o", start=start)
        if not ids.limit(1).count():
            return tracked
        room = max(0, self.options.dedup_max_entries - tracked.count())
        added = ids.where(F.col("msg_id") < start + room).select("key_hash", "msg_id", F.lit(now + w).cast("long").alias("expires_at"))
        name = f"dedup/batch={self.version + 1:020d}-{uuid.uuid4().hex[:8]}"
        tracked.unionByName(added).write.parquet(f"{self.path}/{name}")
        self._append(self._shaped(ids, "msg_id"), empty_ok=False, dedup=name)
        return self.dedup_state(now)

    def dedup_state(self, now: int | None = None) -> DataFrame:
        name = self.state["dedup"]
        if not name:
            return self.spark.createDataFrame([], schema.DEDUP)
        return dedup.clean(self.spark.read.schema(schema.DEDUP).parquet(f"{self.path}/{name}"), self.clock() if now is None else now)

    # consuming

    def dequeue(self) -> Row:
        """The next message: by priority if the log has priorities, else the oldest."""
        self._open()
        began = time.perf_counter_ns()
        with self._reported(self.metrics.dequeue_failed):
            try:
                got = self._next_by_priority() if self.options.priorities else self._batch(1)[0]
            except NoMessages:
                raise NoMessages() from None
        self.metrics.dequeued(len(got["payload"]), time.perf_counter_ns() - began)
        return got

    def _next_by_priority(self) -> Row:
        now, state, version = self.clock(), self.state, self.version + 1
        taken = self.consumed()
        got = views.priority_order(self.table(), state["read"], now, self.options.starvation, taken).limit(1).collect()
        if not got:
            raise NoMessages()
        name = f"consumed/batch={version:020d}-{uuid.uuid4().hex[:8]}"
        names, read = [*state["consumed"], name], state["read"]
        own = self.spark.createDataFrame([(got[0]["msg_id"],)], "msg_id long")
        if len(names) > FOLD:  # one file of what is still ahead of the cursor, which goes past what is all taken
            own = taken.unionByName(own)
            left = self.entries().where(F.col("msg_id") >= read).join(own, "msg_id", "left_anti").agg(F.min("msg_id")).first()[0]
            names, read = [name], left if left is not None else state["next"]
            own = own.where(F.col("msg_id") >= read)
        own.write.parquet(f"{self.path}/{name}")
        self._commit(version, consumed=names, read=read)
        return got[0]

    def dequeue_batch(self, n: int) -> list[Row]:
        """At most n messages in order of id, even with priorities; the cursor moves past what was checked."""
        self._open()
        began = time.perf_counter_ns()
        with self._reported(self.metrics.dequeue_failed):
            got = self._batch(n)
        self.metrics.dequeued_batch(len(got), sum(len(r["payload"]) for r in got), time.perf_counter_ns() - began)
        return got

    def _batch(self, n: int) -> list[Row]:
        now, state = self.clock(), self.state
        log, taken = self.table(), self.consumed() if state["consumed"] else None
        got = views.batch(log, state["read"], state["next"], n, now, taken).orderBy("msg_id").collect()
        new = views.batch_cursor(log, state["read"], state["next"], n, now, taken).first()["new_read"]
        if new == state["read"]:
            raise NotFound(f"message ID {new} not found")
        self._commit(self.version + 1, read=new)
        if not got:
            self.logger.debug("only expired or taken messages", read=new)
            raise NoMessages("no messages could be read")
        return got

    def consumed(self) -> DataFrame:
        """Ids at or after the cursor that were taken out of turn."""
        state = self.state
        if not state["consumed"]:
            return self.spark.createDataFrame([], "msg_id long")
        return self.spark.read.schema("msg_id long").parquet(*[f"{self.path}/{n}" for n in state["consumed"]]).where(F.col("msg_id") >= state["read"]).distinct()

    def peek(self, n: int) -> list[Row]:
        self._open()
        state = self.state
        return views.peek(self.table(), state["read"], state["next"], n, self.clock(), self.consumed() if state["consumed"] else None).orderBy("msg_id").collect()

    def seek_id(self, msg_id: int) -> None:
        """Move the cursor; what was taken out of turn from there on is given again, as after a replay."""
        self._open()
        self._commit(self.version + 1, read=views.seek_id(msg_id, self.state["next"]), consumed=[])
        self.metrics.sought()

    def seek_time(self, ts: int) -> None:
        self._open()
        found = views.seek_time(self.entries(), ts).first()["msg_id"]
        if found is None:
            raise NotFound("no messages found at or after timestamp")
        self._commit(self.version + 1, read=found, consumed=[])
        self.metrics.sought()

    def stream(self, handler: Callable[[Row], None], most: int | None = None) -> int:
        """Give messages to the handler until none is left; a message is taken before it is given."""
        n = 0
        while most is None or n < most:
            try:
                handler(self.dequeue())
            except NoMessages:
                break
            n += 1
        return n

    # acknowledgements

    def dlq(self) -> Log | None:
        o = self.options
        if not o.dlq_path:
            return None
        keep = Retention(max_age=o.dlq_max_age, max_size=o.dlq_max_size) if o.dlq_max_age or o.dlq_max_size else None
        return Log(self.spark, o.dlq_path, Options(rotation=o.rotation, retention=keep, min_free_bytes=0), self.clock)

    def ack(self, msg_id: int) -> None:
        self._open()
        if self.options.dlq_path:
            self._bury()
        tracked = dict(self.state["retry"])
        if self.options.dlq_path and tracked.pop(str(msg_id), None):
            self._commit(self.version + 1, retry=tracked)

    def nack(self, msg_id: int, reason: str) -> bool:
        """Count a failure; True if that sent the message to the dead letters.

        That a message is dying is committed with the count, and that it was sent with the dead letter; so a
        crash in between loses nothing, and what is dying is sent once, by the next nack or ack at the latest.
        """
        self._open()
        if not self.options.dlq_path:
            return False
        self._bury()
        tracked, now = dict(self.state["retry"]), self.clock()
        n = tracked.get(str(msg_id), {"retry_count": 0})["retry_count"] + 1
        dies = bool(self.options.max_retries) and n >= self.options.max_retries
        if dies and not self.entries().where(F.col("msg_id") == msg_id).limit(1).count():
            raise NotFound(f"message ID {msg_id} not found")
        tracked[str(msg_id)] = {"retry_count": n, "last_failure": now, "reason": reason} | ({"dying": uuid.uuid4().hex} if dies else {})
        self._commit(self.version + 1, retry=tracked)
        if dies:
            self._bury()
        return dies

    def _bury(self) -> None:
        """Send what is dying to the dead letters, unless that was done, and forget it."""
        dying = {k: r for k, r in self.state["retry"].items() if r.get("dying")}
        if not dying:
            return
        dead = self.dlq()
        for k, r in dying.items():
            sent = dead.state["sent"]
            if r["dying"] not in sent:
                died = self.spark.createDataFrame([(1, int(k), r["retry_count"], r["reason"], r["last_failure"])], "seq long, msg_id long, retry_count long, reason string, ts long")
                rows = retry.dead_letters(self.table(), died.withColumn("reason", expr.sanitize(F.col("reason"))))
                rows = rows.select("payload", F.lit(None).cast("long").alias("ttl"), "headers", F.lit(0).cast("byte").alias("priority"), F.lit(0).cast("byte").alias("compression"), F.lit(0).alias("order"))
                if rows.limit(1).count():  # compaction may have removed it since
                    # what this log has forgotten cannot be sent again: only what is dying now needs to be kept
                    dead._append(rows, empty_ok=True, sent=[*[x for x in sent if x in {y["dying"] for y in dying.values()}], r["dying"]])
                self.logger.warn("message sent to the dead letters", msg_id=k, retries=r["retry_count"])
        left = {k: r for k, r in self.state["retry"].items() if k not in dying}
        self._commit(self.version + 1, retry=left)

    def clear(self) -> None:
        """Take all that is pending as read, whatever its priority."""
        self._open()
        self._commit(self.version + 1, read=self.state["next"], consumed=[])

    def clear_retries(self) -> None:
        """Forget all failures."""
        self._open()
        self._commit(self.version + 1, retry={})

    def retry_info(self, msg_id: int) -> dict | None:
        return self.state["retry"].get(str(msg_id))

    def requeue(self, dlq_id: int) -> int:
        """Append a dead letter's payload to the log again; the dead letter stays."""
        self._open()
        dead = self.dlq()
        if dead is None:
            raise LogError("DLQ not configured")
        rows = retry.requeued(dead.table().where(F.col("msg_id") == dlq_id))
        if not rows.limit(1).count():
            raise NotFound(f"message ID {dlq_id} not found")
        return self._append(rows.select("payload", F.lit(None).cast("long").alias("ttl"), "headers", F.lit(0).cast("byte").alias("priority"), F.lit(0).cast("byte").alias("compression"), F.lit(0).alias("order")), empty_ok=True)[0]

    # care

    def compact(self, policy: Retention | None = None) -> dict:
        """Remove the closed segments that retention names; returns ``segments, bytes, oldest_age``.

        Compaction does not look at the cursor unless ``protect_unread`` is set; a cursor inside what is removed
        moves to the first message that is left, so that reading goes on there.
        """
        self._open()
        policy = policy or self.options.retention
        if policy is None:
            return {"segments": 0, "bytes": 0, "oldest_age": 0}
        began = time.perf_counter_ns()
        with self._reported(self.metrics.compaction_failed):
            now, state, version = self.clock(), self.state, self.version + 1
            every = self.segments().collect()  # a row for each segment
            gone = segments.removable(self.spark.createDataFrame(every, self.segments().schema).where("NOT is_active"), policy, now, state["read"] if self.options.protect_unread else None).collect() if every else []
            if gone:
                names = {int(r["segment"]) for r in gone}
                left = sorted((r for r in every if int(r["segment"]) not in names), key=lambda r: r["segment"])
                below = int(left[0]["segment"]) if left else state["segment"]
                removed = sorted(x for x in {*state["removed"], *names} if x > below)
                read = state["read"]
                if any(r["min_id"] <= read <= r["max_id"] for r in gone) or (left and read < left[0]["min_id"]):
                    read = min((r["min_id"] for r in left if r["max_id"] >= read), default=state["next"])
                    self.logger.warn("unread messages removed", read=read)
                self._commit(version, removed_below=below, removed=removed, read=max(read, state["read"]))
                for b in self.store.names("data"):
                    for n in names:
                        self.store.delete(f"data/{b}/segment={n}")
        done = {"segments": len(gone), "bytes": sum(r["bytes"] for r in gone), "oldest_age": max((now - r["modified"] for r in gone), default=0)}
        if gone:
            self.metrics.compacted(done["segments"], done["bytes"], time.perf_counter_ns() - began)
            self.logger.info("compacted", **done)
        return done

    def clean_dedup(self) -> int:
        """Drop the deduplication keys whose window has ended; returns how many."""
        self._open()
        state, version = self.state, self.version + 1
        if not state["dedup"]:
            return 0
        held = self.spark.read.schema(schema.DEDUP).parquet(f"{self.path}/{state['dedup']}")
        now = self.clock()
        n = held.count() - dedup.clean(held, now).count()
        if n:
            name = f"dedup/batch={version:020d}-{uuid.uuid4().hex[:8]}"
            dedup.clean(held, now).write.parquet(f"{self.path}/{name}")
            self._commit(version, dedup=name)
            self.logger.debug("deduplication keys removed", entries=n)
        return n

    def maintain(self) -> dict:
        """One round of what runs beside a log: compaction, clean-up of deduplication keys, gauges. A writer that commits meanwhile wins."""
        try:
            done = self.compact()
            done["dedup"] = self.clean_dedup()
        except Locked:
            done = {"segments": 0, "bytes": 0, "oldest_age": 0, "dedup": 0}
        s = self.stats()
        self.metrics.state(s["pending"], s["segments"], s["next_id"], s["read_id"])
        return done

    def maintain_every(self, seconds: float) -> threading.Thread:
        """Maintain the log from a thread of its own until it is closed. A failure is reported and does not end it."""
        self._open()

        def run():
            while not self._done.wait(seconds):
                try:
                    self.maintain()
                except Exception as error:
                    self.logger.error("maintenance failed", error=error)

        thread = threading.Thread(target=run, daemon=True, name="tidelog-maintenance")
        thread.start()
        return thread

    def active(self) -> dict:
        """``segment, bytes, messages, age`` of the open segment."""
        self._open()
        s = self.state
        return {"segment": s["segment"], "bytes": s["held"], "messages": s["count"], "age": self.clock() - s["opened"] if s["opened"] else 0}

    def adopt(self, entries: DataFrame, next_id: int, read_id: int = 1, retry: dict | None = None, tracked: DataFrame | None = None) -> None:
        """Take over an existing queue: its entries with their ids (``base`` and the columns that segment files give), its cursor and state.

        The log must be new. Segments are kept as they were cut.
        """
        self._open()
        if self.version:
            raise LogError("only a new log can take over a queue")
        bases = [r["base"] for r in entries.select("base").distinct().orderBy("base").collect()]  # a row for each segment file
        ordinal = self.spark.createDataFrame([(b, i) for i, b in enumerate(bases)], "base long, segment long")
        rows = entries.join(ordinal, "base").withColumn("compression", F.lit(0).cast("byte")).withColumn("bytes", expr.entry_bytes())
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.ENTRY.fields])
        batch = f"batch={1:020d}-{uuid.uuid4().hex[:8]}"
        rows.write.partitionBy("segment").parquet(f"{self.path}/data/{batch}")
        held = self.spark.read.parquet(f"{self.path}/data/{batch}").where(F.col("segment") == len(bases) - 1).agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n"), F.min("ts").alias("t")).first()
        name = None
        if tracked is not None:
            name = f"dedup/batch={1:020d}-{uuid.uuid4().hex[:8]}"
            tracked.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.DEDUP.fields]).write.parquet(f"{self.path}/{name}")
        self._commit(1, data=[batch], next=next_id, read=read_id, segment=max(0, len(bases) - 1), held=int(held["b"] or 0), count=int(held["n"]), opened=int(held["t"] or 0), retry=retry or {}, dedup=name)

    def stats(self) -> dict:
        self._open()
        s, dead = self.state, self.dlq()
        n = self.entries().select("segment").distinct().count()
        top = s["next"] - 1
        return {
            "total": top, "pending": s["next"] - s["read"], "next_id": s["next"], "read_id": s["read"], "segments": n, "dlq": dead.state["next"] - 1 if dead else 0,
            "retries": len(s["retry"]), "dedup": self.dedup_state().count(),
        }

    def sync(self) -> None:
        """A commit is durable when its call returns."""
        self._open()

    def close(self) -> None:
        self.closed = True
        self._done.set()
