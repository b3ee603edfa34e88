"""State files of an existing queue as DataFrames, and taking over such a queue.

Their names begin with a dot, which Spark's file sources pass over, and each is one document of bounded size;
so they are read through the file system and parsed as columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import LogError
from .binary import read_entries
from .store import Store

# Names, version and layout of the state files.
METADATA, RETRY, DEDUP = "metadata.dat", ".retry_state.json", ".dedup_state.json"
VERSION, METADATA_BYTES = 1, 24
RETRY_JSON = "version int, max_retries int, entries array<struct<msg_id:long,retry_count:long,last_failure:string,failure_reason:string>>"
DEDUP_JSON = "version int, entries array<struct<dedup_id:string,message_id:long,offset:long,enqueued_at:long,expires_at:long>>"


def _unsigned(data: Column, at: int, size: int) -> Column:
    """A little-endian number of bytes from ``at`` (from 0) on."""
    byte = lambda i: F.conv(F.hex(F.substring(data, at + i + 1, 1)), 16, 10).cast("decimal(38,0)")
    return sum((byte(i) * F.lit(256**i).cast("decimal(20,0)") for i in range(1, size)), byte(0)).cast("long")


def _fail(text: str) -> Column:
    return F.raise_error(F.lit(text)).cast("boolean")


def parse_metadata(rows: DataFrame) -> DataFrame:
    """``next_id, read_id`` of metadata files given as ``content``; a short file, another version or an id of 0 is an error."""
    c = F.col("content")
    ok = F.when(F.octet_length(c) < METADATA_BYTES, _fail("metadata is cut off")).when(_unsigned(c, 0, 4) != VERSION, _fail("unsupported metadata version")).otherwise(True)
    rows = rows.where(ok).select(_unsigned(c, 4, 8).alias("next_id"), _unsigned(c, 12, 8).alias("read_id"))
    return rows.where(F.when((F.col("next_id") == 0) | (F.col("read_id") == 0), _fail("message ids of 0 in metadata")).otherwise(True))


def _entries(rows: DataFrame, schema: str, what: str) -> DataFrame:
    doc = rows.select(F.from_json(F.col("content"), schema).alias("d"))
    ok = F.when(F.col("d.version").isNull(), _fail(f"invalid {what} state")).when(F.col("d.version") != VERSION, _fail(f"unsupported {what} state version")).otherwise(True)
    return doc.where(ok).select(F.explode("d.entries").alias("e")).select("e.*")


def nanos(rfc3339: Column) -> Column:
    """Nanoseconds since 1970 of a time with a zone and up to nine decimals."""
    rest = F.rpad(F.regexp_extract(rfc3339, r"\.([0-9]+)", 1), 9, "0")
    whole = F.regexp_replace(rfc3339, r"\.[0-9]+", "")
    return F.unix_micros(F.to_timestamp(whole)) * 1000 + rest.cast("long")


def parse_retry(rows: DataFrame) -> DataFrame:
    """``msg_id, retry_count, last_failure, reason`` of retry states given as ``content``."""
    return _entries(rows, RETRY_JSON, "retry").select("msg_id", "retry_count", nanos(F.col("last_failure")).alias("last_failure"), F.coalesce("failure_reason", F.lit("")).alias("reason"))


def parse_dedup(rows: DataFrame, now: int) -> DataFrame:
    """``key_hash, msg_id, offset, enqueued_at, expires_at`` of deduplication states given as ``content``, without what has expired."""
    e = _entries(rows, DEDUP_JSON, "deduplication").where(F.lit(now) < F.col("expires_at"))
    return e.select(F.col("dedup_id").alias("key_hash"), F.col("message_id").alias("msg_id"), "offset", "enqueued_at", "expires_at")


def _content(spark: SparkSession, path: str, name: str, kind: str) -> DataFrame:
    store = Store(spark, path)
    data = [store.read(name)] if store.exists(name) else []
    return spark.createDataFrame([(d if kind == "binary" else d.decode(),) for d in data], f"content {kind}")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return parse_metadata(_content(spark, path, METADATA, "binary"))


def read_retry(spark: SparkSession, path: str) -> DataFrame:
    """The open retries of the queue at a path; none without a state file."""
    return parse_retry(_content(spark, path, RETRY, "string"))


def read_dedup(spark: SparkSession, path: str, now: int) -> DataFrame:
    """The deduplication keys of the queue at a path that are active at ``now``; none without a state file."""
    return parse_dedup(_content(spark, path, DEDUP, "string"), now)


def take_over(log, path: str, mode: str = "FAILFAST") -> None:
    """Fill a new log with the queue at a path: its entries with their ids and segments, cursor, retries and deduplication keys.

    Without a metadata file the next id follows the last one and the cursor is at the first.
    """
    spark = log.spark
    entries = read_entries(spark, path, mode).where("error IS NULL").drop("error", "offset")
    meta = read_metadata(spark, path).collect()
    last = entries.agg(F.max("msg_id")).first()[0]
    if last is None:
        raise LogError("no entries to take over")
    retry = {str(r["msg_id"]): {"retry_count": r["retry_count"], "last_failure": r["last_failure"], "reason": r["reason"]} for r in read_retry(spark, path).collect()}
    log.adopt(entries, max(last + 1, meta[0]["next_id"] if meta else 1), meta[0]["read_id"] if meta else 1, retry, read_dedup(spark, path, log.clock()))
