"""Schemas of the message log and its state tables."""

from __future__ import annotations

from pyspark.sql import types as T

LOW, MEDIUM, HIGH = 0, 1, 2
DATA, TOMBSTONE, CHECKPOINT = 1, 2, 3
PLAIN, GZIP = 0, 1
FLAG_COMPRESSED, FLAG_TTL, FLAG_HEADERS, FLAG_PRIORITY = 1, 4, 8, 16


def _f(name, kind, null=True):
    return T.StructField(name, kind, null)


MESSAGE = T.StructType([
    _f("msg_id", T.LongType(), False), _f("ts", T.LongType(), False), _f("payload", T.BinaryType(), False), _f("priority", T.ByteType(), False),
    _f("expires_at", T.LongType()), _f("headers", T.MapType(T.StringType(), T.StringType())),
])
#: What a log stores: a message, how its payload is coded, its size on disk and its segment.
ENTRY = T.StructType([*MESSAGE.fields, _f("entry_type", T.ByteType(), False), _f("compression", T.ByteType(), False), _f("bytes", T.LongType(), False), _f("segment", T.LongType(), False)])
SEGMENTS = T.StructType([_f("base", T.LongType()), _f("min_id", T.LongType()), _f("max_id", T.LongType()), _f("messages", T.LongType()), _f("bytes", T.LongType()), _f("modified", T.LongType())])
RETRY = T.StructType([_f("msg_id", T.LongType()), _f("retry_count", T.LongType()), _f("last_failure", T.LongType()), _f("reason", T.StringType())])
DEDUP = T.StructType([_f("key_hash", T.StringType()), _f("msg_id", T.LongType()), _f("expires_at", T.LongType())])
