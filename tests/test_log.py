"""The stateful log, with a clock of its own."""

import pytest

from tidelog.cli import main
from tidelog.errors import InvalidMessage, Locked, LogClosed, NoMessages, NotFound
from tidelog.log import Log
from tidelog.options import Options, Retention, Rotation


class Clock:
    def __init__(self):
        self.t = 1_000

    def __call__(self):
        return self.t


def make(spark, path, clock=None, **options):
    return Log(spark, str(path), Options(min_free_bytes=0, **options), clock or Clock())


def texts(rows):
    return [bytes(r["payload"]).decode() for r in rows]


def test_fifo_reopen_seek_and_stats(spark, tmp_path):
    log = make(spark, tmp_path / "q", rotation=Rotation("count", max_messages=10))
    assert log.enqueue_batch([f"msg-{i}".encode() for i in range(25)]) == (1, 25)
    assert log.enqueue(b"") == 26
    assert texts(log.dequeue_batch(20)) == [f"msg-{i}" for i in range(20)]
    again = make(spark, tmp_path / "q", rotation=Rotation("count", max_messages=10))
    assert again.dequeue()["msg_id"] == 21
    s = again.stats()
    assert (s["total"], s["pending"], s["next_id"], s["read_id"], s["segments"]) == (26, 5, 27, 22, 3)
    again.seek_id(3)
    assert texts(again.peek(2)) == ["msg-2", "msg-3"] and texts(again.dequeue_batch(1)) == ["msg-2"]
    for bad, error in ((0, InvalidMessage), (27, NotFound)):
        with pytest.raises(error):
            again.seek_id(bad)
    with pytest.raises(NotFound):
        again.seek_time(10**9)
    again.seek_time(0)
    seen = []
    assert again.stream(lambda r: seen.append(r["msg_id"]), most=2) == 2 and seen == [1, 2]
    assert main(["stats", str(tmp_path / "q")]) == 0 and main(["peek", str(tmp_path / "q"), "1"]) == 0 and main(["nonsense"]) == 2
    again.close()
    with pytest.raises(LogClosed):
        again.dequeue()


def test_ttl_priority_and_compression(spark, tmp_path):
    clock = Clock()
    log = make(spark, tmp_path / "q", clock, priorities=True, starvation=100, compression=1, compression_min_bytes=100)
    rows = [(b"low", None, 0), (b"high" * 200, None, 2), (b"gone", 5, 2), (b"medium", None, 1)]
    log.append(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "payload binary, ttl long, priority byte, i int"), "i")
    assert log.entries().where("compression = 1").count() == 1
    clock.t += 50
    assert texts([log.dequeue(), log.dequeue()]) == ["high" * 200, "medium"]
    log.enqueue(b"high2", priority=2)
    clock.t += 60
    assert texts([log.dequeue(), log.dequeue()]) == ["low", "high2"]
    with pytest.raises(NoMessages):
        log.dequeue()
    with pytest.raises(InvalidMessage):
        log.enqueue(b"x", ttl=0)
    with pytest.raises(InvalidMessage):
        log.enqueue(b"x", priority=3)
    with pytest.raises(InvalidMessage):
        log.enqueue_batch([])
    with pytest.raises(InvalidMessage):
        log.append(spark.createDataFrame([(b"",)], "payload binary"))


def test_dead_letters(spark, tmp_path):
    log = make(spark, tmp_path / "q", dlq_path=str(tmp_path / "dead"), max_retries=3)
    log.enqueue(b"job", headers={"a": "b"})
    log.dequeue()
    assert [log.nack(1, f"failure {i}") for i in (1, 2)] == [False, False] and log.retry_info(1)["retry_count"] == 2
    assert log.nack(1, "failure 3\nstack") and log.retry_info(1) is None
    dead = log.dlq().table().collect()
    assert texts(dead) == ["job"] and dead[0]["headers"]["dlq.retry_count"] == "3" and dead[0]["headers"]["dlq.failure_reason"] == "failure 3"
    assert log.requeue(1) == 2
    back = log.dequeue()
    assert texts([back]) == ["job"] and back["headers"] == {"a": "b"}
    log.nack(2, "x")
    log.ack(2)
    assert log.retry_info(2) is None
    with pytest.raises(NotFound):
        log.requeue(9)


def test_distinct_and_compaction(spark, tmp_path):
    clock = Clock()
    log = make(spark, tmp_path / "q", clock, dedup_window=100, rotation=Rotation("count", max_messages=2))
    keys = lambda *ks: spark.createDataFrame([(k.encode(), k, i) for i, k in enumerate(ks)], "payload binary, dedup_id string, i int")
    log.append_distinct(keys("p1", "p2", "p1"), "i")
    clock.t += 10
    log.append_distinct(keys("p1", "p3"), "i")
    assert texts(log.table().orderBy("msg_id").collect()) == ["p1", "p2", "p3"]
    clock.t += 95
    log.append_distinct(keys("p1", "p3"), "i")
    assert texts(log.table().orderBy("msg_id").collect()) == ["p1", "p2", "p3", "p1"]
    log.enqueue_batch([b"x"] * 4)
    done = log.compact(Retention(max_segments=2))
    assert done["segments"] == 1 and log.entries().agg({"msg_id": "min"}).first()[0] == 3
    assert log.compact()["segments"] == 0


def test_two_writers(spark, tmp_path):
    a, b = make(spark, tmp_path / "q"), make(spark, tmp_path / "q")
    a.enqueue(b"1")
    v = b.version
    a.enqueue(b"2")
    with pytest.raises(Locked):
        b._commit(v + 1, next=99)
    assert a.state["next"] == 3


def rows_of(spark, *priorities):
    return spark.createDataFrame([(f"m{i + 1}".encode(), p, i) for i, p in enumerate(priorities)], "payload binary, priority byte, i int")


def test_batches_after_priority_reads(spark, tmp_path):
    log = make(spark, tmp_path / "q", priorities=True)
    log.append(rows_of(spark, 0, 0, 2, 0, 2, 0), "i")
    assert log.dequeue()["msg_id"] == 3
    assert [r["msg_id"] for r in log.peek(10)] == [1, 2, 4, 5, 6]
    assert [r["msg_id"] for r in log.dequeue_batch(3)] == [1, 2, 4]
    assert log.dequeue()["msg_id"] == 5 and log.dequeue()["msg_id"] == 6
    with pytest.raises(NoMessages):
        log.dequeue_batch(10)
    log.append(rows_of(spark, 1), "i")
    assert [r["msg_id"] for r in log.dequeue_batch(10)] == [7]
    log.seek_id(2)
    assert log.dequeue()["msg_id"] == 3
    log.clear()
    with pytest.raises(NoMessages):
        log.dequeue()


def test_taken_ids_are_folded(spark, tmp_path, monkeypatch):
    from tidelog import log as module

    monkeypatch.setattr(module, "FOLD", 2)
    monkeypatch.setattr(module, "BATCHES", 1)
    monkeypatch.setattr(module, "KEPT", 4)
    log = make(spark, tmp_path / "q", priorities=True)
    for p in (2, 2, 0, 2, 1):
        log.append(rows_of(spark, p), "i")
    assert log.state["lists"] and len(log.state["data"]) <= 1
    assert [log.dequeue()["msg_id"] for _ in range(5)] == [1, 2, 4, 5, 3]
    assert log.state["read"] == 6 and len(log.state["consumed"]) == 1
    assert len(log.store.names("state")) <= 8 and log.stats()["total"] == 5


def test_compaction_of_unread_segments(spark, tmp_path):
    log = make(spark, tmp_path / "q", rotation=Rotation("count", max_messages=2))
    log.enqueue_batch([f"m{i}".encode() for i in range(8)])
    assert log.compact(Retention(max_segments=2))["segments"] == 1
    assert [r["msg_id"] for r in log.dequeue_batch(3)] == [3, 4, 5] and log.dequeue()["msg_id"] == 6
    log.seek_id(1)
    with pytest.raises(NotFound, match="message ID 1 not found"):
        log.dequeue()
    with pytest.raises(NotFound):
        log.dequeue_batch(2)
    kept = make(spark, tmp_path / "k", rotation=Rotation("count", max_messages=2), protect_unread=True)
    kept.enqueue_batch([b"x"] * 8)
    assert kept.compact(Retention(max_segments=2))["segments"] == 0


def test_what_dead_writers_leave_behind(spark, tmp_path):
    log = make(spark, tmp_path / "q", dedup_window=100)
    log.enqueue(b"1")
    state = tmp_path / "q" / "state"
    (state / f"{2:020d}.json.lock").write_text("")
    (state / f"{2:020d}.json.0123.part").write_text("{")
    log.entries().write.mode("overwrite").parquet(f"{tmp_path}/q/data/batch={2:020d}-dead/segment=0")
    log.entries().selectExpr("'h' AS key_hash", "msg_id", "ts + 1000 AS expires_at").write.parquet(f"{tmp_path}/q/dedup/batch={2:020d}-dead")
    assert log.enqueue(b"2") == 2 and log.entries().count() == 2 and log.dedup_state().count() == 0
    assert log.store.create("x", b"1") and not log.store.create("x", b"2") and log.store.read("x") == b"1"


def test_dying_messages_are_sent_once(spark, tmp_path, monkeypatch):
    log = make(spark, tmp_path / "q", dlq_path=str(tmp_path / "dead"), max_retries=1)
    log.enqueue_batch([b"a", b"b"])
    with pytest.raises(NotFound):
        log.nack(9, "x")
    assert log.retry_info(9) is None
    commit, calls = Log._commit, []

    def dies(self, version, **changes):
        calls.append(changes)
        if len(calls) == crash:
            raise RuntimeError("gone")
        commit(self, version, **changes)

    monkeypatch.setattr(Log, "_commit", dies)
    for msg_id, crash in ((1, 2), (2, 3)):  # before the dead letter is committed, and before it is forgotten
        calls.clear()
        with pytest.raises(RuntimeError):
            log.nack(msg_id, "x")
        crash = 0
        log.ack(7)
        assert log.retry_info(msg_id) is None
    assert sorted(texts(log.dlq().table().collect())) == ["a", "b"]
    log.nack(1, "again")
    log.clear_retries()
    assert log.retry_info(1) is None


def test_maintenance_and_hooks(spark, tmp_path):
    from tidelog.observe import Collector, Logger

    lines, clock = [], Clock()

    class Lines(Logger):
        def _line(self, level, text, fields):
            lines.append((text, fields))

    c = Collector()
    log = make(spark, tmp_path / "q", clock, rotation=Rotation("count", max_messages=2), retention=Retention(max_segments=1), dedup_window=10, metrics=c, logger=Lines())
    log.append_distinct(spark.createDataFrame([(b"x", "k1", 1), (b"y", "k2", 2)], "payload binary, dedup_id string, i int"), "i")
    log.enqueue_batch([b"abc"] * 4)
    log.enqueue(b"abcd")
    assert log.active() == {"segment": 3, "bytes": 34, "messages": 1, "age": 0}
    clock.t += 50
    assert log.active()["age"] == 50
    done = log.maintain()
    assert done["segments"] == 2 and done["dedup"] == 2 and log.maintain()["segments"] == 0
    log.dequeue()
    log.seek_id(6)
    with pytest.raises(InvalidMessage):
        log.enqueue(b"x", priority=7)
    s = c.snapshot()
    assert (s.enqueues, s.enqueue_batches, s.enqueued_bytes, s.enqueue_errors, s.dequeues, s.seeks, s.compactions, s.segments_removed) == (5, 1, 16, 1, 1, 1, 1, 2)
    assert (s.next_id, s.segments) == (8, 2) and any(t == "compacted" for t, _ in lines)
    thread = log.maintain_every(0.01)
    log.close()
    thread.join(60)
    assert not thread.is_alive()


def test_reading_at_an_offset(spark, tmp_path):
    log = make(spark, tmp_path / "q", rotation=Rotation("count", max_messages=2))
    log.enqueue_batch([b"one", b"two", b"three"])
    first = log.read_at(0, 64)
    assert first["msg_id"] == 1 and log.read_at(0, first["next_offset"])["msg_id"] == 2 and log.read_at(1, 64)["msg_id"] == 3
    assert [r["msg_id"] for r in log.segment(1).collect()] == [3]
    with pytest.raises(NotFound):
        log.read_at(0, 65)


def test_taking_over_a_queue(spark, tmp_path):
    import hashlib
    import json
    import struct

    from tidelog.errors import LogError
    from tidelog.sources import binary, state

    old = tmp_path / "old"
    rows = [(i, 100 + i, f"m{i}".encode(), i % 3, None, {"k": "v"} if i % 2 else None, 1 if i < 4 else 4) for i in range(1, 7)]
    spark.dataSource.register(binary.SegmentSink)
    binary.encode_segments(spark.createDataFrame(rows, "msg_id long, ts long, payload binary, priority byte, expires_at long, headers map<string,string>, base long")).write.format("tidelog_segments").mode("append").save(str(old))
    (old / "metadata.dat").write_bytes(struct.pack("<IQQI", 1, 7, 3, 0))
    (old / ".retry_state.json").write_text(json.dumps({"version": 1, "entries": [{"msg_id": 2, "retry_count": 1, "last_failure": "2024-01-31T00:00:00Z"}]}))
    (old / ".dedup_state.json").write_text(json.dumps({"version": 1, "entries": [{"dedup_id": hashlib.sha256(b"k1").hexdigest(), "message_id": 1, "offset": 64, "enqueued_at": 1, "expires_at": 5000}]}))
    log = make(spark, tmp_path / "new", dedup_window=100, dlq_path=str(tmp_path / "dead"))
    state.take_over(log, str(old))
    assert [r["msg_id"] for r in log.dequeue_batch(2)] == [3, 4] and log.retry_info(2)["retry_count"] == 1
    log.append_distinct(spark.createDataFrame([(b"x", "k1", 1), (b"y", "k2", 2)], "payload binary, dedup_id string, i int"), "i")
    assert texts(log.table().where("msg_id > 6").collect()) == ["y"] and [r["segment"] for r in log.segments().orderBy("segment").collect()] == [0, 1]
    with pytest.raises(LogError):
        state.take_over(log, str(old))


def test_stream_metrics(spark, tmp_path):
    import time

    from tidelog import schema
    from tidelog.observe import Collector, StreamMetrics
    from tidelog.streaming import consume

    log = make(spark, tmp_path / "q")
    log.enqueue_batch([b"a", b"b", b"c"])
    log.entries().select(*schema.MESSAGE.names).write.parquet(str(tmp_path / "m"))
    c, seen = Collector(), []
    listener = StreamMetrics(c)
    spark.streams.addListener(listener)
    try:
        stream = consume.messages(spark, str(tmp_path / "m"), schema.MESSAGE)
        consume.consume(stream, lambda rows, n: seen.extend(r.msg_id for r in rows.collect()), str(tmp_path / "c"), drain=True).awaitTermination()
        for _ in range(300):
            if c.snapshot().dequeues:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert sorted(seen) == [1, 2, 3] and c.snapshot().dequeue_batches == 1 and c.snapshot().dequeues >= 3
