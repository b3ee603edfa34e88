"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import cut

#: The six ASCII white-space characters that end a word.
WS = "\x20\x09\x0a\x0b\x0c\x0d"
WS_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes for each core below which a table of few files is dealt out.
SMALL = 64 << 20


def dealt(df: DataFrame) -> DataFrame:
    """A small table of fewer files than the session has cores, dealt out over all of them; any other as it is.

    Work on texts takes far longer than moving them, and a small file of one row group is one task. Tables of
    a size that matters have more splits than cores and are not moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SMALL * cores and len(df.inputFiles()) < cores else df


#: One in so many rows makes a key hot: there are at most so many hot keys, whatever the table.
HOT_SHARE = 1000


def look_up(rows: DataFrame, facts: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with facts, one row for each key, with ``__n``, the number of rows of that key; total is their sum.

    Keys with over a thousandth of the rows, at most a thousand, go by a broadcast, so that none of their
    rows are moved; the others are dealt by key. Null keys meet nothing. facts should be a cut table.
    """
    share = total / HOT_SHARE
    hot = facts.where((F.col("__n") > share) & F.col(key).isNotNull())
    if not hot.limit(1).count():
        return rows.join(facts.drop("__n"), key, how)
    some = F.broadcast(hot.drop("__n"))
    by_broadcast = rows.join(some, key, how)
    others = rows.where(F.col(key).isNotNull()).join(F.broadcast(hot.select(key)), key, "left_anti")
    return by_broadcast.unionByName(others.join(facts.where(F.col("__n") <= share).drop("__n"), key, how))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(name: str = "text") -> Column:
    """Number of runs of characters other than ASCII white space; null counts as 0."""
    return F.coalesce(F.regexp_count(F.col(name), F.lit(WORD)), F.lit(0)).cast("long")


def binary_column(batch, name: str) -> list:
    """The column's values as bytes or None, without decoding."""
    import pyarrow as pa

    return batch.column(name).cast(pa.binary()).to_pylist()


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, with underscores in front until no column of df has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


__all__ = ["WORD", "WS", "WS_RUN", "binary_column", "cut", "dealt", "free_name", "let", "look_up", "table", "text_or_empty", "word_count"]
