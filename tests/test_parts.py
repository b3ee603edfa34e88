"""Formulas, the binary format, rotation, retention, deduplication and retries on small inputs."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.errors import InvalidMessage, NoMessages, NotFound
from tidelog.functions import codec, expr
from tidelog.operators import dedup, metrics, retry, segments, views
from tidelog.options import Options, Retention, Rotation, check_disjoint, check_path

MSG = "msg_id long, ts long, payload binary, priority byte, expires_at long, headers map<string,string>"
headers = st.none() | st.dictionaries(st.text(max_size=6), st.text(max_size=6), min_size=1, max_size=3)


@given(st.integers(1, 2**63 - 1), st.integers(1, 2**62), st.binary(max_size=200), st.integers(0, 2), st.none() | st.integers(1, 2**62), headers)
@settings(max_examples=200, deadline=None)
def test_entry_round_trip(msg_id, ts, payload, priority, expires, heads):
    data = codec.encode_entry(msg_id, ts, payload, priority, expires, heads)
    e, after = codec.decode_entry(data)
    assert after == len(data)
    assert (e["msg_id"], e["ts"], e["payload"], e["priority"], e["expires_at"], e["headers"]) == (msg_id, ts, payload, priority, expires, heads)
    size = 30 + len(payload) + (priority > 0) + 8 * bool(expires) + (2 + sum(4 + len(k.encode()) + len(v.encode()) for k, v in heads.items()) if heads else 0)
    assert len(data) == size


@given(st.binary(min_size=1, max_size=50), st.integers(0, 10**6))
@settings(max_examples=100, deadline=None)
def test_a_flipped_byte_is_found(payload, where):
    data = bytearray(codec.encode_entry(7, 8, payload))
    data[where % (len(data) - 8) + 4 if where % (len(data) - 8) + 4 < len(data) - 4 else 4] ^= 0x55
    with pytest.raises(ValueError):
        codec.decode_entry(bytes(data))


def test_checksum_gzip_headers_and_index():
    assert codec.crc32c_bytes(b"123456789") == 0xE3069283

    def plain(data):
        c = 0xFFFFFFFF
        for b in data:
            c ^= b
            for _ in range(8):
                c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    import random

    rows = [random.Random(n).randbytes(n) for n in [*range(12), 63, 64, 65, 127, 128, 129, 1000, 4096, 5000, 70_000]] + [bytes(100), b"\xff" * 100]
    assert codec.crc32c_many(rows).tolist() == [plain(r) for r in rows] and not len(codec.crc32c_many([]))
    for level in (-2, -1, 0, 1, 9):
        assert codec.gunzip_bytes(codec.gzip_bytes(b"ab" * 5000, level)) == b"ab" * 5000
    with pytest.raises(ValueError):
        codec.gunzip_bytes(codec.gzip_bytes(b"x" * 1000), most=999)
    with pytest.raises(ValueError):
        codec.gunzip_bytes(codec.gzip_bytes(b"x" * 1000)[:-3])
    with pytest.raises(ValueError):
        codec.gzip_bytes(b"", 10)
    head = codec.encode_segment_header(1, 2, 3, 4)
    assert len(head) == 64 and codec.decode_segment_header(head)["max_id"] == 4
    with pytest.raises(ValueError):
        codec.decode_segment_header(b"\0" + head[1:])
    assert codec.decode_index(codec.encode_index(5, [(1, 64, 9), (2, 5000, 10)])) == (5, [(1, 64, 9), (2, 5000, 10)])


def test_segment_files(spark, tmp_path):
    from tidelog.sources import binary

    rows = [(i, 100 + i, f"msg-{i}".encode() * 300, 0, None, {"k": "v"} if i % 2 else None, 1 if i <= 10 else 11) for i in range(1, 21)]
    log = spark.createDataFrame(rows, MSG + ", base long")
    spark.dataSource.register(binary.SegmentSink)
    binary.encode_segments(log).write.format("tidelog_segments").mode("append").save(str(tmp_path / "d"))
    path = str(tmp_path / "d")
    assert sorted(p.name for p in (tmp_path / "d").iterdir()) == [f"{b:020d}.{s}" for b in (1, 11) for s in ("idx", "log")]
    got = {r.msg_id: r for r in binary.read_entries(spark, path).collect()}
    assert {i: bytes(got[i].payload) for i in got} == {r[0]: r[2] for r in rows} and got[3].headers == {"k": "v"}
    assert {r.base: (r.min_id, r.max_id, r.valid) for r in binary.read_headers(spark, path).collect()} == {1: (1, 10, True), 11: (11, 20, True)}
    sizes = {r[0]: len(codec.encode_entry(*r[:4], None, r[5])) for r in rows}
    offsets = {i: 64 + sum(sizes[j] for j in range(1 if i <= 10 else 11, i)) for i in sizes}
    assert {i: got[i].offset for i in got} == offsets
    index, last = [], None
    for i in sorted(sizes):
        if i in (1, 11) or offsets[i] - last >= 4096:
            index.append((1 if i <= 10 else 11, i, offsets[i], 100 + i))
            last = offsets[i]
    assert sorted(tuple(r) for r in binary.read_index(spark, path).collect()) == index and 2 < len(index) < 20
    name = tmp_path / "d" / f"{11:020d}.log"
    name.write_bytes(name.read_bytes()[:-20])
    torn = binary.read_entries(spark, path, "DROPTAIL").collect()
    assert sum(r.error is None for r in torn) == 19 and sum(r.error is not None for r in torn) == 1
    with pytest.raises(Exception, match="cut off"):
        binary.read_entries(spark, path).collect()
    (tmp_path / "d" / "junk.log").write_bytes(b"x")
    assert binary.files(spark, path).count() == 2


def test_expressions(spark):
    df = spark.createDataFrame([(0, 1000, 2500), (1, 1000, 2500), (5, 1000, 2500), (63, 1000, 2500), (2, 250, 100)], "n long, b long, m long")
    assert [r.x for r in df.select(expr.backoff(F.col("n"), F.col("b"), F.col("m")).alias("x")).collect()] == [1000, 2000, 2000, 1000, 250]
    with pytest.raises(Exception, match="base delay"):
        spark.createDataFrame([(1, 0, 5)], "n long, b long, m long").select(expr.backoff(F.col("n"), F.col("b"), F.col("m"))).collect()
    r = spark.createDataFrame([("a\nb",), ("x" * 300,), (None,), ("",)], "r string").select(expr.sanitize(F.col("r")).alias("x")).collect()
    assert [x.x for x in r] == ["a", "x" * 253 + "...", None, ""]
    wide = spark.createDataFrame([("é" * 129,), ("x" + "é" * 130,), ("漢" * 90 + "\nrest",), ("é" * 128,)], "r string").select(expr.sanitize(F.col("r")).alias("x"), expr.sanitized_bytes(F.col("r")).alias("b")).collect()
    assert [x.x for x in wide] == ["é" * 126 + "...", "x" + "é" * 126 + "...", "漢" * 84 + "...", "é" * 128]
    assert [bytes(x.b) for x in wide] == [t.encode()[:253] + b"..." for t in ("é" * 129, "x" + "é" * 130, "漢" * 90)] + [("é" * 128).encode()]
    assert [x.n for x in spark.range(3).select(expr.compression_name(F.col("id")).alias("n")).collect()] == ["none", "gzip", "unknown(2)"]
    names = spark.createDataFrame([("00000000000000000042.log",), ("42.log",), ("99999999999999999999.log",)], "n string")
    assert [x.b for x in names.select(expr.segment_base(F.col("n")).alias("b")).collect()] == [42, None, None]
    assert spark.range(1).select(expr.iso_millis(F.lit(1_706_659_200_123_456_789)).alias("t")).first().t == "2024-01-31T00:00:00.123Z"
    kept = spark.createDataFrame([(1000, 949), (1000, 950), (500, 1)], "o long, c long").select(expr.worth_compressing(F.col("o"), F.col("c"), 1000).alias("k"))
    assert [r.k for r in kept.collect()] == [True, False, False]


def test_batches(spark):
    rows = [(i, i, b"", 0, 0 if i <= 1500 else None, None) for i in range(1, 1601)]
    log = spark.createDataFrame(rows, MSG)
    assert views.batch(log, 1, 1601, 10, 5).count() == 0
    assert views.batch_cursor(log, 1, 1601, 10, 5).first().new_read == 1011
    assert [r.msg_id for r in views.batch(log, 1011, 1601, 3, 5).orderBy("msg_id").collect()] == [1501, 1502, 1503]
    gap = log.where("msg_id <> 1502")
    assert [r.msg_id for r in views.batch(gap, 1501, 1601, 3, 5).collect()] == [1501]
    assert views.batch_cursor(gap, 1501, 1601, 3, 5).first().new_read == 1502
    with pytest.raises(NoMessages):
        views.batch(log, 1601, 1601, 1, 0)
    with pytest.raises(InvalidMessage):
        views.batch(log, 1, 1601, 0, 0)


@given(st.integers(-5, 200), st.integers(1, 100))
@settings(max_examples=50, deadline=None)
def test_seek_bounds(msg_id, next_id):
    if msg_id <= 0:
        with pytest.raises(InvalidMessage):
            views.seek_id(msg_id, next_id)
    elif msg_id >= next_id:
        with pytest.raises(NotFound):
            views.seek_id(msg_id, next_id)
    else:
        assert views.seek_id(msg_id, next_id) == msg_id


def test_priorities(spark):
    order = ["low1", "high1", "medium1", "low2", "high2", "medium2"]
    p = {"l": 0, "m": 1, "h": 2}
    log = spark.createDataFrame([(i + 1, i, n.encode(), p[n[0]], None, None) for i, n in enumerate(order)], MSG)
    names = lambda df: [bytes(r.payload).decode() for r in df.collect()]
    assert names(views.priority_order(log, 1, 100, 0)) == ["high1", "high2", "medium1", "medium2", "low1", "low2"]
    assert names(views.priority_order(log, 1, 5, 5)) == ["low1", "high1", "high2", "medium1", "medium2", "low2"]


def test_rotation(spark):
    sizes = [50, 60, 10, 200, 5, 5, 90, 100, 1]
    log = spark.createDataFrame([(i + 1, 10 * i, n) for i, n in enumerate(sizes)], "msg_id long, ts long, bytes long")

    def plain(max_bytes=0, most=0, span=0, carry=(0, 0, 0)):
        seg, held, count = carry
        began, out = None, []
        for i, n in enumerate(sizes):
            began = 10 * i if began is None else began
            if count and (max_bytes and held >= max_bytes or most and count >= most or span and 10 * i - began >= span):
                seg, held, count, began = seg + 1, 0, 0, 10 * i
            if not count:
                out.append((seg, i + 1))
            held, count = held + n, count + 1
        return out

    for kw in ({"max_bytes": 100}, {"max_messages": 4}, {"max_bytes": 100, "max_messages": 2}, {"max_time": 30}):
        want = plain(kw.get("max_bytes", 0), kw.get("max_messages", 0), kw.get("max_time", 0))
        assert [tuple(r) for r in segments.boundaries(log, **kw).collect()] == want, kw
    # rows out of order, ids with gaps, sizes beyond 32 bits, several partitions
    wide = [(3 * i + 1, i, n << 30) for i, n in enumerate(sizes)]
    gaps = spark.createDataFrame(wide[::-1], "msg_id long, ts long, bytes long").repartition(3)
    want = [(g, 3 * (i - 1) + 1) for g, i in plain(100)]
    assert [tuple(r) for r in segments.boundaries(gaps, max_bytes=100 << 30).collect()] == want
    assert segments.boundaries(log.limit(0), max_bytes=100).count() == 0
    carried = segments.boundaries(log, max_bytes=100, carry=(3, 95, 2)).collect()
    assert [tuple(r) for r in carried][:2] == [(4, 2), (5, 5)]  # 145 after row 1; rows 2 to 4 hold 270


def test_retention(spark):
    def plain(rows, p, now):
        gone = []
        if len(rows) <= p.min_segments:
            return gone
        for i, (base, size, modified) in enumerate(rows):
            if len(rows) - len(gone) <= p.min_segments or i == len(rows) - 1:
                break
            rest = sum(r[1] for r in rows[i:])
            if p.max_age and now - modified > p.max_age or p.max_segments and len(rows) - len(gone) > p.max_segments or p.max_size and rest > p.max_size:
                gone.append(base)
        return gone

    rows = [(i * 5 + 1, 650, 10 * i) for i in range(5)]
    df = spark.createDataFrame(rows, "base long, bytes long, modified long")
    for p in (Retention(max_segments=3), Retention(max_size=1890), Retention(max_age=1, min_segments=2), Retention(max_age=25, max_segments=4), Retention(max_age=1, min_segments=0), Retention(max_size=1, min_segments=9), Retention()):
        assert sorted(r.base for r in segments.removable(df, p, 50).collect()) == plain(rows, p, 50), p
    unread = df.withColumn("max_id", F.col("base") + 4)
    assert [r.base for r in segments.removable(unread, Retention(max_segments=1), 50, read=8).collect()] == [1]


def test_dedup(spark):
    rows = [(1, 0, "a"), (2, 5, "a"), (3, 10, "a"), (4, 19, "a"), (5, 20, "a"), (6, 3, "b")]
    log = spark.createDataFrame(rows, "msg_id long, ts long, dedup_id string")
    got = {r.msg_id: r.original_id for r in dedup.decide(log, 10).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6}
    assert {r.msg_id for r in dedup.state(dedup.decide(log, 10), 13).collect()} == {3, 5}
    assert dedup.duplicates(dedup.decide(log, 0)).count() == 0
    own = log.withColumn("w", F.when(F.col("msg_id") == 1, 4))
    assert {r.msg_id: r.original_id for r in dedup.decide(own, 10, own_window="w").collect()}[2] == 2
    with pytest.raises(InvalidMessage):
        dedup.decide(log, -1)
    with pytest.raises(Exception, match="cannot be empty"):
        dedup.decide(spark.createDataFrame([(1, 1, "")], log.schema), 5).collect()


def test_retries(spark):
    rows = [(1, 7, "nack"), (2, 7, "nack"), (3, 7, "ack"), (4, 7, "nack"), (5, 7, "nack"), (6, 7, "nack"), (7, 7, "nack"), (8, 9, "nack")]
    out = spark.createDataFrame([(s, m, o, f"failure {s}\nstack", s) for s, m, o in rows], "seq long, msg_id long, outcome string, reason string, ts long")
    assert [(r.seq, r.msg_id, r.retry_count, r.reason) for r in retry.dead(out, 3).collect()] == [(6, 7, 3, "failure 6")]
    assert sorted((r.msg_id, r.retry_count) for r in retry.state(out, 3).collect()) == [(7, 1), (9, 1)]
    assert retry.dead(out, 0).count() == 0 and dict((r.msg_id, r.retry_count) for r in retry.state(out, 0).collect()) == {7: 4, 9: 1}


def test_histogram(spark):
    df = spark.createDataFrame([(500,)] * 100, "duration long")
    assert {r.percent: r.value_ns for r in metrics.percentiles(df).collect()} == {50: 500_000, 95: 500_000, 99: 500_000}
    assert {r.value_ns for r in metrics.percentiles(df.limit(0)).collect()} == {0}
    assert metrics.percentiles(df.limit(1), (50,)).first().value_ns == 500


def test_options():
    for bad in ({"compression": 2}, {"compression_level": 10}, {"max_retries": -1}, {"max_message_bytes": -1}, {"dlq_path": "a/../b"}):
        with pytest.raises(ValueError):
            Options(**bad)
    for bad in ("", "a/../b", "a//b", ".."):
        with pytest.raises(ValueError):
            check_path(bad)
    for pair in (("/a/b", "/a/b/c"), ("/a/b/c", "/a/b"), ("/a", "/a")):
        with pytest.raises(ValueError):
            check_disjoint(*pair)
    with pytest.raises(ValueError):
        Rotation(max_messages=0)
    with pytest.raises(ValueError):
        Retention(max_age=-1)


def test_offsets_of_a_segment(spark):
    log = spark.createDataFrame([(i, i // 4, 10 * i) for i in range(1, 12)], "msg_id long, segment long, bytes long")
    placed = segments.offsets(log)
    assert [(r.msg_id, r.next_offset) for r in segments.at(placed, 1, 104).collect()] == [(5, 154)]
    assert segments.at(placed, 1, 105).count() == 0 and segments.at(placed, 9, 64).count() == 0
    assert [r.msg_id for r in segments.onward(placed, 1, 104).collect()] == [5, 6, 7] and [r.msg_id for r in segments.onward(placed, 0).collect()] == [1, 2, 3]


def test_many_segments(spark):
    n = 200_000
    log = spark.range(1, n + 1).select(F.col("id").alias("msg_id"), F.lit(0).alias("ts"), F.lit(100).alias("bytes"))
    bounds = segments.boundaries(log, max_messages=1)
    assert bounds.count() == n
    placed = segments.assign(log.select("msg_id"), bounds)
    assert placed.where("segment = msg_id - 1").count() == n
    few = spark.createDataFrame([(3, 5), (4, 9), (7, 100)], "segment long, first_id long")
    ids = spark.createDataFrame([(i, 0) for i in (1, 5, 8, 9, 99, 100, 5000)], "msg_id long, segment long")
    want = [(1, None), (5, 3), (8, 3), (9, 4), (99, 4), (100, 7), (5000, 7)]
    for found in (segments.assign(ids, few), segments._assign_by_spans(ids, few)):
        assert sorted(tuple(r) for r in found.select("msg_id", "segment").collect()) == want
    assert segments.assign(ids, few.limit(0)).where("segment IS NULL").count() == 7


def test_state_files(spark, tmp_path):
    import json
    import struct

    from tidelog.sources import state

    (tmp_path / "metadata.dat").write_bytes(struct.pack("<IQQI", 1, 7, 3, 0))
    (tmp_path / ".retry_state.json").write_text(json.dumps({"version": 1, "max_retries": 3, "entries": [{"msg_id": 5, "retry_count": 2, "last_failure": "2024-01-31T01:00:00.123456789+01:00", "failure_reason": "x"}, {"msg_id": 6, "retry_count": 1, "last_failure": "2024-01-31T00:00:00Z"}]}, indent=2))
    (tmp_path / ".dedup_state.json").write_text(json.dumps({"version": 1, "entries": [{"dedup_id": h, "message_id": i, "offset": 64, "enqueued_at": 1, "expires_at": e} for h, i, e in (("a", 1, 10), ("b", 2, 11))]}))
    assert tuple(state.read_metadata(spark, str(tmp_path)).first()) == (7, 3)
    second = 1_706_659_200 * 10**9
    assert sorted(tuple(r) for r in state.read_retry(spark, str(tmp_path)).collect()) == [(5, 2, second + 123_456_789, "x"), (6, 1, second, "")]
    assert [tuple(r) for r in state.read_dedup(spark, str(tmp_path), 10).collect()] == [("b", 2, 64, 1, 11)]
    for name in ("metadata.dat", ".retry_state.json", ".dedup_state.json"):
        (tmp_path / name).unlink()
    assert state.read_metadata(spark, str(tmp_path)).count() == state.read_retry(spark, str(tmp_path)).count() == state.read_dedup(spark, str(tmp_path), 0).count() == 0
    (tmp_path / "metadata.dat").write_bytes(struct.pack("<IQQI", 2, 7, 3, 0))
    (tmp_path / ".retry_state.json").write_text('{"version": 2, "entries": []}')
    (tmp_path / ".dedup_state.json").write_text("nonsense")
    for read, what in ((state.read_metadata, "version"), (state.read_retry, "version"), (lambda s, p: state.read_dedup(s, p, 0), "invalid")):
        with pytest.raises(Exception, match=what):
            read(spark, str(tmp_path)).collect()


def test_collector():
    from tidelog import observe

    c = observe.Collector("q", clock=lambda: 42)
    c.enqueued(10, 500_000)
    c.enqueued_batch(3, 30, 5_000_000)
    c.dequeued(10, 999)
    c.enqueue_failed(), c.dequeue_failed(), c.sought(), c.compaction_failed()
    c.compacted(2, 100, 1)
    c.state(1, 2, 3, 4)
    s = c.snapshot()
    assert (s.enqueues, s.enqueue_batches, s.enqueued_bytes, s.dequeues, s.enqueue_errors, s.dequeue_errors, s.seeks, s.compaction_errors) == (4, 1, 40, 1, 1, 1, 1, 1)
    assert (s.compactions, s.segments_removed, s.bytes_freed, s.last_compaction, s.pending, s.segments, s.next_id, s.read_id) == (1, 2, 100, 42, 1, 2, 3, 4)
    assert [s.percentile(s.enqueue_times, p) for p in (0.5, 0.99, 1.0)] == [500_000, 500_000, 5_000_000] and s.percentile([0] * 10, 0.5) == 0
    c.reset()
    assert c.snapshot().enqueues == 0 and s.enqueues == 4
    assert [observe.level_name(i) for i in range(-1, 5)] == ["UNKNOWN", "DEBUG", "INFO", "WARN", "ERROR", "UNKNOWN"]


def test_checkpoint_folder():
    from types import SimpleNamespace as Fake

    from tidelog.checkpoints import folder

    session = lambda named, master: Fake(conf=Fake(get=lambda key, default=None: named), sparkContext=Fake(master=master, getCheckpointDir=lambda: "/made"))
    assert folder(session("hdfs://x/y", "spark://a")) == "hdfs://x/y" and folder(session(None, "local[2]")) == "/made"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        folder(session(None, "spark://a"))
