"""Binary segment and index files as DataFrames, and the way back.

Files are read with Spark's own ``binaryFile`` source, one task for a few files, so any store does; a file
is at most a segment, which rotation bounds. Writing goes through a Python data source whose tasks each
write whole files and whose commit moves them into place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions import codec
from ..functions.expr import segment_base, segment_name

ENTRIES = "base long, offset long, msg_id long, ts long, payload binary, priority byte, expires_at long, headers map<string,string>, compression byte, entry_type byte, error string"


def files(spark: SparkSession, path: str, suffix: str = "log") -> DataFrame:
    """``base, path, length, modified``: segment files by name; files with other names are passed over."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    return rows.select(segment_base(F.col("path"), suffix).alias("base"), "path", "length", "modified").where("base IS NOT NULL")


def read_entries(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """All entries of the segments under a path, payloads decompressed, with their offsets.

    mode FAILFAST raises on a bad entry; DROPTAIL ends the segment there, with a last row that has only
    ``base``, ``offset`` and ``error``.
    """
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(path).select(segment_base(F.col("path")).alias("base"), "content").where("base IS NOT NULL")
    return decode_files(rows, mode)


def decode_files(rows: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """The entries of segment files given as ``base, content``."""
    if mode not in ("FAILFAST", "DROPTAIL"):
        raise ValueError(f"unknown mode {mode!r}")

    def run(batches):
        for pdf in batches:
            import pandas as pd

            for base, data in zip(pdf["base"], pdf["content"], strict=True):
                out, at = [], codec.SEGMENT_HEADER
                try:
                    codec.decode_segment_header(data)
                    for at, e, after in codec.decode_entries(data, codec.SEGMENT_HEADER):  # noqa: B007
                        if e["compression"]:
                            e["payload"] = codec.gunzip_bytes(e["payload"])
                        out.append((base, at, e["msg_id"], e["ts"], e["payload"], e["priority"], e["expires_at"], e["headers"], e["compression"], e["entry_type"], None))
                except ValueError as error:
                    at = getattr(error, "at", at)
                    if mode == "FAILFAST":
                        raise ValueError(f"segment {base}, offset {at}: {error}") from error
                    out.append((base, at, *[None] * 8, str(error)))
                yield pd.DataFrame(out, columns=[x.strip().split(" ")[0] for x in ENTRIES.split(", ")]).astype({c: "Int64" for c in ("base", "offset", "msg_id", "ts", "priority", "expires_at", "compression", "entry_type")})

    return rows.mapInPandas(run, ENTRIES)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """``base, created_at, min_id, max_id, valid, error`` of each segment file's header."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for base, data in zip(pdf["base"], pdf["content"], strict=True):
                try:
                    h = codec.decode_segment_header(data)
                    ok = h["base"] == base and (not h["max_id"] or h["min_id"] <= h["max_id"])
                    out.append((base, h["created_at"], h["min_id"], h["max_id"], ok, None if ok else "header does not fit the file"))
                except ValueError as error:
                    out.append((base, None, None, None, False, str(error)))
            yield pd.DataFrame(out, columns=["base", "created_at", "min_id", "max_id", "valid", "error"]).astype({c: "Int64" for c in ("created_at", "min_id", "max_id")})

    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(path).select(segment_base(F.col("path")).alias("base"), "content").where("base IS NOT NULL")
    return rows.mapInPandas(run, "base long, created_at long, min_id long, max_id long, valid boolean, error string")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``base, msg_id, offset, ts`` of all index files under a path."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for data in pdf["content"]:
                base, rows = codec.decode_index(data)
                yield pd.DataFrame([(base, *r) for r in rows], columns=["base", "msg_id", "offset", "ts"]).astype("int64")

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.idx").load(path).select("content").mapInPandas(run, "base long, msg_id long, offset long, ts long")


def encode_segments(log: DataFrame, interval: int = 4096) -> DataFrame:
    """``name, content``: a log file and an index file for each segment (a column ``base``) of the log.

    A file is one value, so a task holds one segment, which rotation bounds.
    """

    def run(key, table):
        import pyarrow as pa
        import pyarrow.compute as pc

        table = table.take(pc.sort_indices(table, [("msg_id", "ascending")]))
        (base,) = (k.as_py() for k in key)
        cols = [table.column(c).to_pylist() for c in ("msg_id", "ts", "payload", "priority", "expires_at", "headers")]
        body = codec.encode_entries((i, t, p, r, e, dict(h) if h else None, 0, 1) for i, t, p, r, e, h in zip(*cols, strict=True))
        index, at, last = [], codec.SEGMENT_HEADER, None
        for i, t, data in zip(cols[0], cols[1], body, strict=True):
            if last is None or at - last >= interval:
                index.append((i, at, t))
                last = at
            at += len(data)
        head = codec.encode_segment_header(base, cols[1][0], cols[0][0], cols[0][-1])
        names, files_ = [f"{base:020d}.log", f"{base:020d}.idx"], [head + b"".join(body), codec.encode_index(base, index)]
        return pa.table({"name": pa.array(names, pa.string()), "content": pa.array(files_, pa.binary())})

    return log.select("base", "msg_id", "ts", "payload", "priority", "expires_at", "headers").groupBy("base").applyInArrow(run, "name string, content binary")


class SegmentSink(DataSource):
    """``df.write.format("tidelog_segments").mode("append").save(path)`` of rows ``name, content``; the path is a shared file system."""

    @classmethod
    def name(cls):
        return "tidelog_segments"

    def schema(self):
        return "name string, content binary"

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"])


class _Written(WriterCommitMessage):
    def __init__(self, names):
        self.names = names


class _Writer(DataSourceWriter):
    """Writes through the file system that the path's scheme names, on executors and driver alike."""

    def __init__(self, path):
        self.path = path

    def _store(self):
        from pyarrow import fs

        if "://" in self.path or self.path.startswith("file:"):
            return fs.FileSystem.from_uri(self.path.replace("file:/", "file:///", 1) if self.path.startswith("file:/") and not self.path.startswith("file://") else self.path)
        return fs.LocalFileSystem(), self.path

    def write(self, rows):
        store, at = self._store()
        store.create_dir(at, recursive=True)
        names = []
        for r in rows:
            with store.open_output_stream(f"{at}/{r.name}.part") as f:
                f.write(r.content)
            names.append(r.name)
        return _Written(names)

    def commit(self, messages):
        store, at = self._store()
        for m in messages:
            for n in m.names if m else ():
                store.move(f"{at}/{n}.part", f"{at}/{n}")

    def abort(self, messages):
        store, at = self._store()
        for m in messages:
            for n in m.names if m else ():
                store.delete_file(f"{at}/{n}.part")


__all__ = ["SegmentSink", "encode_segments", "files", "read_entries", "read_headers", "read_index", "segment_name"]
