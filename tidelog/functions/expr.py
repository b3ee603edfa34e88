"""Column expressions of the log: validity, expiry, rank, sizes, names, buckets.

Times and ``now`` are integers of one unit, chosen by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DLQ_KEYS = ("dlq.original_msg_id", "dlq.retry_count", "dlq.failure_reason", "dlq.last_failure")
#: Upper ends of the histogram's buckets in microseconds, the last open, and the value each stands for in nanoseconds.
BUCKET_ENDS = tuple(10**k for k in range(9))
BUCKET_VALUES = (500, 5_000, 50_000, 500_000, 5_000_000, 50_000_000, 500_000_000, 5_000_000_000, 50_000_000_000, 100_000_000_000)


def expired(now: int, expires: str = "expires_at") -> Column:
    """At the very instant of its expiry a message is expired."""
    return F.col(expires).isNotNull() & (F.lit(now) >= F.col(expires))


def live(now: int, expires: str = "expires_at") -> Column:
    return F.col(expires).isNull() | (F.lit(now) < F.col(expires))


def rank(now: int, window: int, priority: str = "priority", ts: str = "ts") -> Column:
    """0 starved low, 1 high, 2 medium, 3 low; a window of 0 starves nothing."""
    p = F.col(priority)
    starved = (p == 0) & (F.lit(now) - F.col(ts) >= window) if window > 0 else F.lit(False)
    return F.when(starved, 0).when(p == 2, 1).when(p == 1, 2).otherwise(3)


def entry_bytes(payload="payload", priority="priority", expires="expires_at", headers="headers", compression: str | None = None) -> Column:
    """Bytes of a stored entry: 30, the payload, and what is optional."""
    h = F.col(headers)
    pairs = F.aggregate(F.map_entries(h), F.lit(0), lambda a, e: a + 4 + F.octet_length(e["key"]) + F.octet_length(e["value"]))
    size = F.lit(30) + F.octet_length(payload) + F.when(F.col(priority) > 0, 1).otherwise(0) + F.when(F.col(expires).isNotNull(), 8).otherwise(0)
    size = size + F.when(h.isNotNull() & (F.size(h) > 0), F.lit(2) + pairs).otherwise(0)
    if compression:
        size = size + F.when(F.col(compression) > 0, 1).otherwise(0)
    return size.cast("long")


def invalid_reason(max_bytes: int = 10 << 20, msg_id="msg_id", ts="ts", priority="priority", expires="expires_at", payload="payload", headers="headers") -> Column:
    """Code of the first check a message fails, null if it passes all."""
    h = F.col(headers)
    wide = F.exists(F.map_entries(h), lambda e: (F.octet_length(e["key"]) > 65535) | (F.octet_length(e["value"]) > 65535))
    code = F.when(F.col(msg_id).isNull() | (F.col(msg_id) <= 0), "msg_id").when(F.col(ts).isNull() | (F.col(ts) <= 0), "ts")
    code = code.when(~F.col(priority).between(0, 2), "priority").when(F.col(expires) <= F.col(ts), "expires_at")
    if max_bytes:
        code = code.when(F.octet_length(payload) > max_bytes, "payload")
    return code.when(h.isNotNull() & ((F.size(h) > 65535) | wide), "headers")


def sanitized_bytes(reason: Column) -> Column:
    """First line as UTF-8, cut to 256 bytes with an ellipsis."""
    line = F.substring_index(reason, "\n", 1).cast("binary")
    return F.when(F.octet_length(line) > 256, F.concat(F.substring(line, 1, 253), F.lit(b"..."))).otherwise(line)


def sanitize(reason: Column) -> Column:
    """The same as text: a character that the cut falls into goes as a whole, so that headers stay valid."""
    line = F.substring_index(reason, "\n", 1)
    data = line.cast("binary")
    cut = F.coalesce(*[F.when(F.is_valid_utf8(F.substring(data, 1, n).cast("string")), F.substring(data, 1, n).cast("string")) for n in (253, 252, 251, 250)])
    return F.when(F.octet_length(line) > 256, F.concat(cut, F.lit("..."))).otherwise(line)


def backoff(retries: Column, base: Column, most: Column) -> Column:
    """base * 2^retries, at most the largest multiple of base that fits; base at least. A base of 0 is an error."""
    n = F.least(retries, F.lit(62)).cast("int")
    grown = F.least(F.pow(F.lit(2.0), n).cast("long"), F.floor(most / base).cast("long")) * base
    base_ok = F.when(base > 0, base).otherwise(F.raise_error(F.lit("base delay must be positive")).cast("long"))
    return F.when((retries <= 0) | (retries >= 63), base_ok).otherwise(F.greatest(base_ok, grown))


def segment_name(base: Column, suffix: str = "log") -> Column:
    return F.concat(F.lpad(base.cast("string"), 20, "0"), F.lit("." + suffix))


def segment_base(name: Column, suffix: str = "log") -> Column:
    """The base in a file name, null for other names."""
    digits = F.regexp_extract(name, rf"(?:^|/)([0-9]{{20}})\.{suffix}$", 1)
    return F.when(digits != "", digits.cast("decimal(20,0)")).try_cast("long")


def preview(payload: Column, most: int = 100) -> Column:
    return F.when(F.octet_length(payload) > most, F.concat(F.substring(payload, 1, most), F.lit(b"..."))).otherwise(payload)


def written_headers(headers: Column) -> Column:
    """Headers as ``k=v;`` in order of key."""
    pairs = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit("="), e["value"], F.lit(";")))
    return F.coalesce(F.array_join(pairs, ""), F.lit(""))


def strip_dlq(headers: Column) -> Column:
    return F.map_filter(headers, lambda k, _: ~k.isin(*DLQ_KEYS))


def enrich_dlq(headers: Column, msg_id: Column, retries: Column, reason: Column, failed: Column) -> Column:
    own = F.create_map(*[x for k, v in zip(DLQ_KEYS, (msg_id, retries, reason, failed), strict=True) for x in (F.lit(k), F.coalesce(v.cast("string"), F.lit("")))])
    return F.map_concat(F.coalesce(strip_dlq(headers), F.create_map().cast("map<string,string>")), own)


def bucket(micros: Column) -> Column:
    """Histogram bucket 0-9 of a duration in whole microseconds."""
    out = F.lit(len(BUCKET_ENDS))
    for i in range(len(BUCKET_ENDS) - 1, -1, -1):
        out = F.when(micros < BUCKET_ENDS[i], i).otherwise(out)
    return out


def compression_name(kind: Column) -> Column:
    return F.when(kind == 0, "none").when(kind == 1, "gzip").otherwise(F.concat(F.lit("unknown("), kind.cast("string"), F.lit(")")))


def worth_compressing(size: Column, packed: Column, least: Column | int) -> Column:
    """Kept if the original is large enough and over 5 % is saved."""
    return (size >= least) & (packed < size * 0.95)


def iso_millis(ns: Column) -> Column:
    """RFC 3339 in UTC with milliseconds, whatever the session's zone."""
    ms = F.floor(ns / 1_000_000)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86_400_000).cast("int"))
    rest = F.pmod(ms, F.lit(86_400_000))
    two = lambda x, n=2: F.lpad(F.floor(x).cast("long").cast("string"), n, "0")
    clock = F.concat(two(rest / 3_600_000), F.lit(":"), two(rest / 60_000 % 60), F.lit(":"), two(rest / 1000 % 60), F.lit("."), two(rest % 1000, 3), F.lit("Z"))
    return F.concat(day.cast("string"), F.lit("T"), clock)
