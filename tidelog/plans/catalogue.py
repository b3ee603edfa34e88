"""Queries over the message log, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codec, expr
from ..operators import dedup, metrics, retry, segments, views
from ..options import Retention
from . import logs
from .logs import BATCH, NOW, PER_SEGMENT, READ, RETRIES, SEGMENT_BYTES, STARVE, WINDOW

QUERIES: dict = {}
SQL: dict[str, str] = {}

M = """m AS (
  SELECT event_id + 1 AS msg_id, epoch_us(ts) AS ts, props AS payload, event_type, user_id, 'user-' || user_id AS dedup_id, CAST(floor(value) AS BIGINT) AS duration,
         CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END AS priority,
         epoch_us(ts) + CASE event_type WHEN 'view' THEN 86400000000 WHEN 'click' THEN 604800000000 END AS expires_at
  FROM events),
b AS (
  SELECT *, CAST(30 + strlen(payload) + CASE WHEN priority > 0 THEN 1 ELSE 0 END + CASE WHEN expires_at IS NOT NULL THEN 8 ELSE 0 END
         + 2 + 4 + 4 + strlen(event_type) + 4 + 4 + strlen(CAST(user_id AS VARCHAR)) AS BIGINT) AS bytes FROM m)"""
LIVE = f"(expires_at IS NULL OR {NOW} < expires_at)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _next(log) -> int:
    return views.recovered_next(log).first()["next_id"]


def _rows(df):
    return df.select("msg_id", "ts", F.col("payload").cast("string").alias("payload"), F.col("priority").cast("long").alias("priority"))


ROWS = "msg_id, ts, payload, CAST(priority AS BIGINT) AS priority"


@query("pending_fifo", f"WITH {M} SELECT {ROWS} FROM m WHERE msg_id >= {READ} AND {LIVE} ORDER BY msg_id")
def pending_fifo(spark, d):
    return _rows(views.fifo(logs.messages(spark, d), READ, NOW))


@query("dequeue_next", f"WITH {M} SELECT msg_id, payload, msg_id + 1 AS new_read FROM m WHERE msg_id >= {READ} AND {LIVE} ORDER BY msg_id LIMIT 1")
def dequeue_next(spark, d):
    return views.next_message(logs.messages(spark, d), READ, NOW).select("msg_id", F.col("payload").cast("string").alias("payload"), "new_read")


def _candidates(source: str, read: int, n: int) -> str:
    return f"""s AS (SELECT max(msg_id) + 1 AS nxt FROM {source}),
k AS (SELECT least(least({n}, nxt - {read}) + 1000, nxt - {read}) AS k FROM s),
c AS (SELECT *, sum(CASE WHEN {LIVE} THEN 1 ELSE 0 END) OVER (ORDER BY msg_id) AS kept FROM {source}, k WHERE msg_id >= {read} AND msg_id < {read} + k)"""


@query("dequeue_batch", f"WITH {M}, {_candidates('m', READ, BATCH)} SELECT {ROWS} FROM c WHERE {LIVE} AND kept <= {BATCH}")
def dequeue_batch(spark, d):
    log = logs.messages(spark, d)
    return _rows(views.batch(log, READ, _next(log), BATCH, NOW))


CURSOR = f"SELECT coalesce(min(CASE WHEN {LIVE} AND kept = {BATCH} THEN msg_id END), max(msg_id)) + 1 AS new_read FROM c"


@query("dequeue_batch_cursor", f"WITH {M}, {_candidates('m', READ, BATCH)} {CURSOR}")
def dequeue_batch_cursor(spark, d):
    log = logs.messages(spark, d)
    return views.batch_cursor(log, READ, _next(log), BATCH, NOW)


def _expired_first(spark, d):
    log = logs.messages(spark, d).withColumn("alive", expr.live(NOW)).withColumnRenamed("msg_id", "old_id")
    return views.dense_ids(log, "alive", "old_id")


R = f"r AS (SELECT * EXCLUDE (msg_id), msg_id AS old_id, row_number() OVER (ORDER BY {LIVE}, msg_id) AS msg_id FROM m)"


@query("dequeue_batch_expired_run", f"WITH {M}, {R}, {_candidates('r', 1, BATCH)}, t AS ({CURSOR}) SELECT new_read, (SELECT count(*) FROM c WHERE {LIVE} AND kept <= {BATCH}) AS got FROM t")
def dequeue_batch_expired_run(spark, d):
    log = _expired_first(spark, d)
    n = _next(log)
    got = views.batch(log, 1, n, BATCH, NOW).agg(F.count(F.lit(1)).alias("got"))
    return views.batch_cursor(log, 1, n, BATCH, NOW).join(F.broadcast(got))  # one row each


@query("dense_renumbering", f"WITH {M}, {R} SELECT msg_id, old_id FROM r")
def dense_renumbering(spark, d):
    return _expired_first(spark, d).select("msg_id", "old_id")


@query("expired_messages", f"WITH {M} SELECT {ROWS} FROM m WHERE expires_at IS NOT NULL AND {NOW} >= expires_at")
def expired_messages(spark, d):
    return _rows(views.expired_messages(logs.messages(spark, d), NOW))


def _rank(window: int) -> str:
    return f"CASE WHEN {window} > 0 AND priority = 0 AND {NOW} - ts >= {window} THEN 0 WHEN priority = 2 THEN 1 WHEN priority = 1 THEN 2 ELSE 3 END"


@query("priority_drain", f"WITH {M} SELECT {ROWS}, CAST({_rank(STARVE)} AS BIGINT) AS rank FROM m WHERE msg_id >= {READ} AND {LIVE} ORDER BY rank, msg_id")
def priority_drain(spark, d):
    rows = views.priority_order(logs.messages(spark, d), READ, NOW, STARVE)
    return rows.select("msg_id", "ts", F.col("payload").cast("string").alias("payload"), F.col("priority").cast("long").alias("priority"), F.col("rank").cast("long").alias("rank"))


@query("priority_drain_nostarve", f"WITH {M} SELECT msg_id, CAST({_rank(0)} AS BIGINT) AS rank FROM m WHERE msg_id >= {READ} AND {LIVE} ORDER BY rank, msg_id")
def priority_drain_nostarve(spark, d):
    return views.priority_order(logs.messages(spark, d), READ, NOW, 0).select("msg_id", F.col("rank").cast("long").alias("rank"))


PACE, PACED, PACE_STARVE = 3_600_000_000, 200, 25 * 86_400_000_000


def _head(p: int, of: str = "min(c.msg_id)") -> str:
    """Of the first live message of a priority after what was taken of it."""
    return f"(SELECT {of} FROM c WHERE c.priority = {p} AND c.msg_id > d.c{p} AND (c.expires_at IS NULL OR {NOW} + (d.k + 1) * {PACE} < c.expires_at))"


@query(
    "priority_paced",
    f"""WITH RECURSIVE {M}, c AS MATERIALIZED (SELECT msg_id, ts, priority, expires_at FROM m WHERE msg_id >= {READ}),
d(k, c0, c1, c2, msg_id) AS (
  SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT)
  UNION ALL
  SELECT k, CASE WHEN p = h0 THEN p ELSE c0 END, CASE WHEN p = h1 THEN p ELSE c1 END, CASE WHEN p = h2 THEN p ELSE c2 END, p FROM (
    SELECT *, CASE WHEN {NOW} + k * {PACE} - t0 >= {PACE_STARVE} THEN h0 ELSE coalesce(h2, h1, h0) END AS p FROM (
      SELECT d.k + 1 AS k, d.c0, d.c1, d.c2, {_head(0)} AS h0, {_head(0, "arg_min(c.ts, c.msg_id)")} AS t0, {_head(1)} AS h1, {_head(2)} AS h2
      FROM d WHERE d.k + 1 < {PACED} AND d.msg_id IS NOT NULL)))
SELECT k, msg_id FROM d WHERE k >= 0 AND msg_id IS NOT NULL""",
)
def priority_paced(spark, d):
    return views.priority_paced(logs.messages(spark, d), READ, NOW, PACE, PACED, PACE_STARVE)


@query("priority_oldest", f"WITH {M} SELECT CAST(priority AS BIGINT) AS priority, min(msg_id) AS msg_id FROM m WHERE msg_id >= {READ} GROUP BY priority")
def priority_oldest(spark, d):
    return views.oldest_by_priority(logs.messages(spark, d), READ).select(F.col("priority").cast("long").alias("priority"), "msg_id")


@query("priority_counts", f"WITH {M} SELECT CAST(priority AS BIGINT) AS priority, count(*) AS messages FROM m WHERE msg_id >= {READ} GROUP BY priority")
def priority_counts(spark, d):
    return views.count_by_priority(logs.messages(spark, d), READ).select(F.col("priority").cast("long").alias("priority"), "messages")


@query("priority_next", f"WITH {M} SELECT min(msg_id) AS msg_id FROM m WHERE priority = 2 AND msg_id > 500")
def priority_next(spark, d):
    return views.next_in_priority(logs.messages(spark, d), 2, 500)


@query("seek_id_replay", f"WITH {M} SELECT {ROWS} FROM m WHERE msg_id >= 500")
def seek_id_replay(spark, d):
    log = logs.messages(spark, d)
    return _rows(views.replay(log, views.seek_id(500, _next(log))))


@query("seek_timestamp", f"WITH {M} SELECT min(msg_id) AS msg_id FROM m WHERE ts >= 1705276800000000")
def seek_timestamp(spark, d):
    return views.seek_time(logs.messages(spark, d), 1705276800000000)


@query("time_range_replay", f"WITH {M} SELECT {ROWS} FROM m WHERE ts >= 1704672000000000 AND ts < 1704758400000000")
def time_range_replay(spark, d):
    return _rows(views.between(logs.messages(spark, d), 1704672000000000, 1704758400000000))


@query("point_lookup", f"WITH {M} SELECT {ROWS} FROM m WHERE msg_id = 777")
def point_lookup(spark, d):
    return _rows(logs.messages(spark, d).where("msg_id = 777"))


@query("header_filter", f"WITH {M} SELECT {ROWS} FROM m WHERE event_type = 'error'")
def header_filter(spark, d):
    return _rows(views.with_header(logs.messages(spark, d), "type", "error"))


@query("header_projection", f"WITH {M} SELECT msg_id, 'type=' || event_type || ';user=' || user_id || ';' AS headers, CAST(user_id AS VARCHAR) AS user_name FROM m")
def header_projection(spark, d):
    return logs.messages(spark, d).select("msg_id", expr.written_headers(F.col("headers")).alias("headers"), F.col("headers")["user"].alias("user_name"))


@query("peek", f"WITH {M}, {_candidates('m', READ, BATCH)} SELECT msg_id, ts, payload, 'type=' || event_type || ';user=' || user_id || ';' AS headers FROM c WHERE {LIVE} AND kept <= {BATCH}")
def peek(spark, d):
    log = logs.messages(spark, d)
    return views.peek(log, READ, _next(log), BATCH, NOW).withColumn("payload", F.col("payload").cast("string"))


@query("payload_preview", "SELECT doc_id, CASE WHEN strlen(text) > 100 THEN left(hex(text), 200) || '2E2E2E' ELSE hex(text) END AS preview_hex FROM documents")
def payload_preview(spark, d):
    """Every document; in hex, as a cut may fall inside a character."""
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.hex(expr.preview(F.col("text").cast("binary"))).alias("preview_hex"))


@query("entry_bytes", f"WITH {M} SELECT msg_id, bytes FROM b")
def entry_bytes(spark, d):
    return logs.messages(spark, d).select("msg_id", "bytes")


@query("segments_by_count", f"WITH {M} SELECT msg_id, (msg_id - 1) // {PER_SEGMENT} AS segment FROM b")
def segments_by_count(spark, d):
    return segments.by_count(logs.messages(spark, d), PER_SEGMENT).select("msg_id", "segment")


OFFSETS = f"o AS (SELECT *, (msg_id - 1) // {PER_SEGMENT} AS segment, CAST(64 + sum(bytes) OVER (PARTITION BY (msg_id - 1) // {PER_SEGMENT} ORDER BY msg_id) - bytes AS BIGINT) AS \"offset\" FROM b)"


def _offsets(spark, d):
    return segments.offsets(segments.by_count(logs.messages(spark, d), PER_SEGMENT))


@query("entry_offsets", f'WITH {M}, {OFFSETS} SELECT msg_id, segment, "offset" FROM o')
def entry_offsets(spark, d):
    return _offsets(spark, d).select("msg_id", "segment", F.col("offset").cast("long").alias("offset"))


SEG = f"""g AS (SELECT (msg_id - 1) // {PER_SEGMENT} AS segment, min(msg_id) AS min_id, max(msg_id) AS max_id, count(*) AS messages, CAST(sum(bytes) AS BIGINT) AS bytes, max(ts) AS modified FROM b GROUP BY 1),
t AS (SELECT *, segment * {PER_SEGMENT} + 1 AS base, lpad(CAST(segment * {PER_SEGMENT} + 1 AS VARCHAR), 20, '0') || '.log' AS name, segment = max(segment) OVER () AS is_active FROM g)"""


def _segments(spark, d):
    return segments.summary(segments.by_count(logs.messages(spark, d), PER_SEGMENT), PER_SEGMENT)


@query("segment_stats", f"WITH {M}, {SEG} SELECT base, name, min_id, max_id, messages, bytes, modified, is_active FROM t")
def segment_stats(spark, d):
    return _segments(spark, d).select("base", "name", "min_id", "max_id", "messages", "bytes", "modified", "is_active")


@query("segment_name_parse", f"WITH {M}, {SEG} SELECT name, base FROM t")
def segment_name_parse(spark, d):
    return _segments(spark, d).select("name", expr.segment_base(F.col("name")).alias("base"))


@query("segment_sequence_check", "SELECT CAST(l_orderkey AS BIGINT) AS base, count(*) AS files FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def segment_sequence_check(spark, d):
    return segments.duplicate_bases(spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").cast("long").alias("base")))


def _fold(size: int, count: int) -> str:
    """Segment starts by jumping from one to the next over running sums."""
    return f"""p AS MATERIALIZED (SELECT msg_id, CAST(sum(bytes) OVER (ORDER BY msg_id) - bytes AS BIGINT) AS upto FROM b),
f(segment, first_id, base) AS (
  SELECT CAST(0 AS BIGINT), min(msg_id), CAST(0 AS BIGINT) FROM p
  UNION ALL
  SELECT segment + 1, n.msg_id, n.upto FROM (
    SELECT f.segment, (SELECT min(msg_id) FROM p WHERE p.msg_id > f.first_id AND ({f"p.upto - f.base >= {size}" if size else "false"} OR {f"p.msg_id - f.first_id >= {count}" if count else "false"})) AS nid FROM f) x
  JOIN p n ON n.msg_id = x.nid)
SELECT segment, first_id FROM f"""


@query("segments_by_size", f"WITH RECURSIVE {M}, {_fold(SEGMENT_BYTES, 0)}")
def segments_by_size(spark, d):
    return segments.boundaries(logs.messages(spark, d), max_bytes=SEGMENT_BYTES)


@query("segments_by_both", f"WITH RECURSIVE {M}, {_fold(SEGMENT_BYTES, 777)}")
def segments_by_both(spark, d):
    return segments.boundaries(logs.messages(spark, d), max_bytes=SEGMENT_BYTES, max_messages=777)


@query(
    "segment_assignment",
    f"WITH RECURSIVE {M}, {_fold(SEGMENT_BYTES, 0).replace('SELECT segment, first_id FROM f', '')} SELECT m.msg_id, max(f.segment) AS segment FROM m JOIN f ON f.first_id <= m.msg_id GROUP BY m.msg_id",
)
def segment_assignment(spark, d):
    log = logs.messages(spark, d)
    return segments.assign(log.select("msg_id"), segments.boundaries(log, max_bytes=SEGMENT_BYTES))


INDEX = f"""{OFFSETS}, q AS MATERIALIZED (SELECT segment, msg_id, "offset", ts FROM o),
x(segment, msg_id, "offset", ts) AS (
  SELECT segment, msg_id, "offset", ts FROM q WHERE "offset" = 64
  UNION ALL
  SELECT q.segment, q.msg_id, q."offset", q.ts FROM (
    SELECT x.segment, (SELECT min(msg_id) FROM q WHERE q.segment = x.segment AND q.msg_id > x.msg_id AND q."offset" - x."offset" >= 4096) AS nid FROM x) y
  JOIN q ON q.msg_id = y.nid)"""


@query("sparse_index", f'WITH RECURSIVE {M}, {INDEX} SELECT segment, msg_id, "offset", ts FROM x')
def sparse_index(spark, d):
    return segments.sparse_index(_offsets(spark, d))


@query("index_floor_lookup", f'WITH RECURSIVE {M}, {INDEX} SELECT q.segment, q.msg_id, x.msg_id AS floor_id, x."offset" AS floor_offset FROM q ASOF JOIN x ON x.segment = q.segment AND x.msg_id <= q.msg_id')
def index_floor_lookup(spark, d):
    """Every message is looked up."""
    log = _offsets(spark, d)
    return segments.index_floor(segments.sparse_index(log), log.select("segment", "msg_id"))


@query("read_at_offset", f'WITH {M}, {OFFSETS} SELECT segment, "offset", msg_id, payload, CAST("offset" + bytes AS BIGINT) AS next_offset FROM o WHERE segment = 2 AND "offset" = (SELECT "offset" FROM o WHERE msg_id = 2 * {PER_SEGMENT} + 17)')
def read_at_offset(spark, d):
    """The entry at one offset, which the message 16 after the segment's first has."""
    log = _offsets(spark, d)
    offset = log.where(F.col("msg_id") == 2 * PER_SEGMENT + 17).select("offset").first()
    rows = segments.at(log, 2, offset[0] if offset else -1)
    return rows.select("segment", F.col("offset").cast("long").alias("offset"), "msg_id", F.col("payload").cast("string").alias("payload"), F.col("next_offset").cast("long").alias("next_offset"))


@query("read_from_offset", f'WITH {M}, {OFFSETS} SELECT msg_id, "offset" FROM o WHERE segment = 0 AND "offset" >= 30000')
def read_from_offset(spark, d):
    return segments.onward(_offsets(spark, d), 0, 30000).select("msg_id", F.col("offset").cast("long").alias("offset"))


def _retained(policy: Retention) -> str:
    hits = ["false"]
    if policy.max_age:
        hits.append(f"{NOW} - modified > {policy.max_age}")
    if policy.max_segments:
        hits.append(f"n - removed > {policy.max_segments}")
    if policy.max_size:
        hits.append(f"rest > {policy.max_size}")
    hit = f"({' OR '.join(hits)}) AND i < n - 1 AND n - removed > {policy.min_segments}"
    return f"""WITH RECURSIVE {M}, {SEG},
c AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY base) - 1 AS i, count(*) OVER () AS n, CAST(sum(bytes) OVER (ORDER BY base ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest FROM t WHERE NOT is_active),
w(i, removed, gone, base) AS (
  SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT), false, CAST(0 AS BIGINT)
  UNION ALL
  SELECT c.i, w.removed + CASE WHEN {hit.replace('removed', 'w.removed').replace(' i ', ' c.i ')} THEN 1 ELSE 0 END, {hit.replace('removed', 'w.removed').replace(' i ', ' c.i ')}, c.base
  FROM w JOIN c ON c.i = w.i + 1)
SELECT base FROM w WHERE gone"""


def _retention(name: str, policy: Retention) -> None:
    def run(spark, d):
        return segments.removable(_segments(spark, d).where("NOT is_active"), policy, NOW).select("base")

    query(name, _retained(policy))(run)


_retention("retention_count", Retention(max_segments=3))
_retention("retention_size", Retention(max_size=300_000))
_retention("retention_age", Retention(max_age=15 * 86_400_000_000))
_retention("retention_combined", Retention(max_age=25 * 86_400_000_000, max_segments=5, max_size=400_000, min_segments=2))

DEDUP = f"""e AS MATERIALIZED (SELECT dedup_id, ts, msg_id FROM m),
a(dedup_id, ts, msg_id) AS (
  SELECT dedup_id, min(ts), min(msg_id) FROM e GROUP BY dedup_id
  UNION ALL
  SELECT y.dedup_id, y.nts, (SELECT min(msg_id) FROM e WHERE e.dedup_id = y.dedup_id AND e.ts = y.nts) FROM (
    SELECT a.dedup_id, (SELECT min(ts) FROM e WHERE e.dedup_id = a.dedup_id AND e.ts >= a.ts + {WINDOW}) AS nts FROM a) y
  WHERE y.nts IS NOT NULL)"""


def _decided(spark, d):
    return dedup.decide(logs.messages(spark, d), WINDOW)


@query("dedup_accepted", f"WITH RECURSIVE {M}, {DEDUP} SELECT sha256(dedup_id) AS key_hash, msg_id, ts FROM a")
def dedup_accepted(spark, d):
    return dedup.accepted(_decided(spark, d)).select("key_hash", "msg_id", "ts")


@query(
    "dedup_duplicates",
    f"WITH RECURSIVE {M}, {DEDUP} SELECT e.msg_id, max(a.msg_id) AS original_id FROM e JOIN a ON a.dedup_id = e.dedup_id AND a.msg_id <= e.msg_id GROUP BY e.msg_id HAVING max(a.msg_id) <> e.msg_id",
)
def dedup_duplicates(spark, d):
    return dedup.duplicates(_decided(spark, d)).select("msg_id", "original_id")


@query("dedup_active_state", f"WITH RECURSIVE {M}, {DEDUP} SELECT sha256(dedup_id) AS key_hash, msg_id, ts + {WINDOW} AS expires_at FROM a WHERE {NOW - 2 * 86_400_000_000} < ts + {WINDOW}")
def dedup_active_state(spark, d):
    return dedup.state(_decided(spark, d), NOW - 2 * 86_400_000_000)


@query("dedup_counts", f"WITH RECURSIVE {M}, {DEDUP} SELECT count(*) AS entries, count(*) FILTER ({NOW - 2 * 86_400_000_000} < ts + {WINDOW}) AS active FROM a")
def dedup_counts(spark, d):
    return dedup.counts(dedup.accepted(_decided(spark, d)), NOW - 2 * 86_400_000_000)


OUT = f"""{M},
u AS (SELECT event_id AS seq, event_id % 97 + 1 AS msg_id, CASE WHEN event_type = 'purchase' THEN 'ack' ELSE 'nack' END AS outcome, event_type AS reason, event_type || chr(10) || props AS full_reason, epoch_us(ts) AS ts FROM events),
i AS (SELECT *, sum(CASE WHEN outcome = 'ack' THEN 1 ELSE 0 END) OVER (PARTITION BY msg_id ORDER BY seq) AS island FROM u),
k AS (SELECT *, row_number() OVER (PARTITION BY msg_id, island ORDER BY seq) AS nacks, max(island) OVER (PARTITION BY msg_id) AS last_island FROM i WHERE outcome = 'nack'),
top AS (SELECT msg_id, max(island) AS last_island FROM i GROUP BY msg_id)"""


@query(
    "retry_state",
    f"WITH {OUT}, l AS (SELECT k.msg_id, max(nacks) % {RETRIES} AS retry_count, max(ts) AS last_failure, max_by(full_reason, seq) AS reason FROM k JOIN top ON top.msg_id = k.msg_id AND top.last_island = k.island GROUP BY k.msg_id) SELECT * FROM l WHERE retry_count > 0",
)
def retry_state(spark, d):
    return retry.state(logs.outcomes(spark, d), RETRIES)


@query(
    "dlq_messages",
    f"""WITH {OUT} SELECT k.seq, m.payload, 'dlq.failure_reason=' || k.reason || ';dlq.last_failure=' || k.ts || ';dlq.original_msg_id=' || k.msg_id || ';dlq.retry_count={RETRIES};type=' || m.event_type || ';user=' || m.user_id || ';' AS headers
FROM k JOIN m USING (msg_id) WHERE nacks % {RETRIES} = 0""",
)
def dlq_messages(spark, d):
    rows = retry.dead_letters(logs.messages(spark, d), retry.dead(logs.outcomes(spark, d), RETRIES), written=True)
    return rows.select("seq", F.col("payload").cast("string").alias("payload"), expr.written_headers(F.col("headers")).alias("headers"))


@query("dlq_requeue", f"WITH {OUT} SELECT k.seq, m.payload, 'type=' || m.event_type || ';user=' || m.user_id || ';' AS headers FROM k JOIN m USING (msg_id) WHERE nacks % {RETRIES} = 0")
def dlq_requeue(spark, d):
    rows = retry.requeued(retry.dead_letters(logs.messages(spark, d), retry.dead(logs.outcomes(spark, d), RETRIES)))
    return rows.select("seq", F.col("payload").cast("string").alias("payload"), expr.written_headers(F.col("headers")).alias("headers"))


@query(
    "backoff_schedule",
    """WITH p AS (SELECT n, b, m FROM (SELECT unnest(range(0, 70)) AS n), (VALUES (1000, 300000), (1000, 2500), (250, 100)) v(b, m))
SELECT CAST(n AS BIGINT) AS retries, CAST(b AS BIGINT) AS base, CAST(m AS BIGINT) AS most,
       CAST(CASE WHEN n <= 0 OR n >= 63 THEN b ELSE greatest(b, CAST(least(pow(2, n), m // b) AS BIGINT) * b) END AS BIGINT) AS delay FROM p""",
)
def backoff_schedule(spark, d):
    v = F.array(*[F.struct(F.lit(b).cast("long").alias("base"), F.lit(m).cast("long").alias("most")) for b, m in ((1000, 300000), (1000, 2500), (250, 100))])
    rows = spark.range(70).select(F.col("id").alias("retries"), F.explode(v).alias("v")).select("retries", "v.base", "v.most")
    return rows.withColumn("delay", expr.backoff(F.col("retries"), F.col("base"), F.col("most")))


LINE = "hex(split_part(text, chr(10), 1))"


@query("sanitize_reason", f"SELECT doc_id, CASE WHEN length({LINE}) > 512 THEN left({LINE}, 506) || '2E2E2E' ELSE {LINE} END AS reason_hex FROM documents")
def sanitize_reason(spark, d):
    """In hex, as a cut may fall inside a character."""
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.hex(expr.sanitized_bytes(F.col("text"))).alias("reason_hex"))


@query(
    "invalid_messages",
    f"""WITH {M}, f AS (SELECT msg_id AS row_id, (msg_id - 1) % 10 AS k, * FROM m)
SELECT row_id, CASE WHEN k = 1 THEN 'msg_id' WHEN k = 2 THEN 'ts' WHEN k = 0 THEN 'priority' WHEN k = 3 THEN 'expires_at' END AS error FROM f WHERE k <= 3""",
)
def invalid_messages(spark, d):
    return logs.with_faults(logs.messages(spark, d)).select("row_id", expr.invalid_reason().alias("error")).where("error IS NOT NULL")


@query("oversized_messages", "SELECT doc_id FROM documents WHERE strlen(text) > 2048")
def oversized_messages(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.lit(1).alias("msg_id"), F.lit(1).alias("ts"), F.lit(0).alias("priority"), F.lit(None).cast("long").alias("expires_at"), F.col("text").alias("payload"), F.lit(None).cast("map<string,string>").alias("headers"))
    return docs.where(expr.invalid_reason(2048) == "payload").select("doc_id")


STATS = f"SELECT max(msg_id) AS total, max(msg_id) + 1 - {READ} AS pending, max(msg_id) + 1 AS next_id, CAST({READ} AS BIGINT) AS read_id FROM m"


@query("queue_stats", f"WITH {M} {STATS}")
def queue_stats(spark, d):
    return views.stats(logs.messages(spark, d), READ).select("total", "pending", "next_id", "read_id")


@query("inspect_consumed", f"WITH {M}, s AS ({STATS}) SELECT total, printf('%.1f%%', (total - pending) * 100.0 / total) AS consumed FROM s")
def inspect_consumed(spark, d):
    return views.consumed_percent(views.stats(logs.messages(spark, d), READ)).select("total", "consumed")


@query("inspect_document", f"""WITH {M}, s AS ({STATS}) SELECT '{{"total":' || total || ',"pending":' || pending || ',"consumed":"' || printf('%.1f%%', (total - pending) * 100.0 / total) || '"}}' AS document FROM s""")
def inspect_document(spark, d):
    return views.inspect(views.stats(logs.messages(spark, d), READ).select("total", "pending"))


@query("recover_next_id", f"WITH {M} SELECT max(msg_id) + 1 AS next_id FROM m")
def recover_next_id(spark, d):
    return views.recovered_next(logs.messages(spark, d))


CASES = "CASE " + " ".join(f"WHEN duration < {10**k} THEN {k}" for k in range(9)) + " ELSE 9 END"


@query("latency_histogram", f"WITH {M} SELECT CAST({CASES} AS BIGINT) AS bucket, count(*) AS observations FROM m GROUP BY 1")
def latency_histogram(spark, d):
    return metrics.histogram(logs.messages(spark, d)).select(F.col("bucket").cast("long").alias("bucket"), "observations")


@query(
    "latency_percentiles",
    f"""WITH {M}, h AS (SELECT {CASES} AS bucket, count(*) AS n FROM m GROUP BY 1), r AS (SELECT bucket, sum(n) OVER (ORDER BY bucket) AS upto, sum(n) OVER () AS total FROM h)
SELECT CAST(p AS BIGINT) AS percent, [500, 5000, 50000, 500000, 5000000, 50000000, 500000000, 5000000000, 50000000000, 100000000000][CAST(min(bucket) AS BIGINT) + 1] AS value_ns
FROM r, (VALUES (50), (95), (99)) v(p) WHERE upto >= floor(total * p / 100) GROUP BY p""",
)
def latency_percentiles(spark, d):
    return metrics.percentiles(logs.messages(spark, d))


@query(
    "op_counters",
    f"""WITH {M}, x AS (SELECT *, msg_id % 50 = 0 AS bad FROM m)
SELECT count(*) FILTER (event_type = 'click' AND NOT bad) AS enqueues, count(*) FILTER (event_type = 'view' AND NOT bad) AS dequeues, count(*) FILTER (event_type = 'signup' AND NOT bad) AS batches,
       count(*) FILTER (event_type = 'purchase' AND NOT bad) AS seeks, count(*) FILTER (event_type NOT IN ('click', 'view', 'signup', 'purchase') AND NOT bad) AS compactions, count(*) FILTER (bad) AS errors,
       CAST(sum(CASE WHEN event_type = 'signup' THEN duration ELSE 1 END) FILTER (NOT bad) AS BIGINT) AS messages, CAST(sum(strlen(payload)) FILTER (NOT bad) AS BIGINT) AS bytes FROM x""",
)
def op_counters(spark, d):
    return metrics.counters(logs.operations(logs.messages(spark, d)))


@query("compress_roundtrip", "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, sha256(text) AS digest FROM documents")
def compress_roundtrip(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("text").cast("binary").alias("raw"))
    packed = docs.withColumn("z", codec.compress()("raw"))
    back = packed.withColumn("back", F.when(F.col("z.compression") == 1, codec.gunzip(F.when(F.col("z.compression") == 1, F.col("z.payload")))).otherwise(F.col("z.payload")))
    return back.select("doc_id", F.octet_length("back").cast("long").alias("n_bytes"), F.sha2("back", 256).alias("digest"))


@query(
    "crc32c_check",
    f"""WITH {M}, t AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(CAST(b AS BIGINT), [CAST(0 AS BIGINT) FOR i IN range(8)]), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 2197175160 ELSE 0 END))) AS tab),
x AS (SELECT msg_id, [CAST('0x' || hex(payload)[2 * i - 1:2 * i] AS BIGINT) FOR i IN range(1, strlen(payload) + 1)] AS bytes FROM m)
SELECT msg_id, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS crc FROM x, t""",
)
def crc32c_check(spark, d):
    return logs.messages(spark, d).select("msg_id", codec.crc32c("payload").alias("crc"))


@query("binary_roundtrip", f"WITH {M} SELECT msg_id, ts, payload, CAST(priority AS BIGINT) AS priority, expires_at, 'type=' || event_type || ';user=' || user_id || ';' AS headers FROM m")
def binary_roundtrip(spark, d):
    from ..sources import binary

    base = segments.by_count(logs.messages(spark, d), PER_SEGMENT).withColumn("base", F.col("segment") * PER_SEGMENT + 1)
    files = binary.encode_segments(base).where("name LIKE '%.log'")
    rows = binary.decode_files(files.select(expr.segment_base(F.col("name")).alias("base"), "content"))
    return rows.select("msg_id", "ts", F.col("payload").cast("string").alias("payload"), F.col("priority").cast("long").alias("priority"), "expires_at", expr.written_headers(F.col("headers")).alias("headers"))


def _stream(spark, d, build):
    """Drain a stream over the log into a table and read it."""
    import uuid

    from ..checkpoints import folder
    from ..streaming import consume

    at = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    log = logs.messages(spark, d)
    log.write.parquet(f"{at}/log")
    stream = consume.messages(spark, f"{at}/log", log.schema)
    build(consume, stream, at)
    return spark.read.parquet(f"{at}/out")


@query("stream_fifo", SQL["pending_fifo"])
def stream_fifo(spark, d):
    def build(consume, stream, at):
        consume.consume(stream, lambda rows, n: _rows(rows).write.mode("append").parquet(f"{at}/out"), f"{at}/checkpoint", READ, lambda: NOW, drain=True).awaitTermination()

    return _stream(spark, d, build)


@query("stream_dedup", SQL["dedup_accepted"])
def stream_dedup(spark, d):
    def build(consume, stream, at):
        rows = consume.dedup(stream, WINDOW, 1_000_000)
        rows.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    return _stream(spark, d, build).select("key_hash", "msg_id", "ts")
