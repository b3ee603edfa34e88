"""Mixing sources to target weights by weighted fair queueing.

Each document, in a keyed shuffle of its source, gets a virtual finish time: the words its source has
queued up to it, divided by the source's target. All sources are then served in one global order of
finish time, cut where the budget is used up. By construction words arrive at a near-constant rate in
virtual time, so equal slices of it are equal shares of the work.

Running sums never put a source or the whole order in one task: within a source they go by ranges of the
shuffle key, and globally by slices of virtual time; only the slice with the cut is put in exact order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .common import HOT_SHARE, cut, dealt, table, word_count

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Copies of a row that are written in a row.
PORTION = 256


def source_targets(sized: DataFrame, weights=WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """``skey, source_size, target`` for each source; sources by code point, null last, weigh ``weights`` in turn.

    Water-filling: sources in order of capacity over weight fill up first; the rest share what remains.
    """
    per = sized.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.lit(list(weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long")
    per = per.withColumn("w", w).withColumn("cap", F.col("source_size") * repeats)
    by = Window.orderBy(F.col("cap") / F.col("w"), "skey")
    all_rows = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = (
        per.withColumn("total", F.sum("source_size").over(all_rows))
        .withColumn("before", F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cap"))
        .withColumn("rest", F.sum("w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("full", F.col("cap") * F.col("rest") <= F.col("w") * (F.col("total") - F.col("before")))
        .withColumn("used", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(all_rows))
        .withColumn("open", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(all_rows))
    )
    share = (F.col("w") * (F.col("total") - F.col("used"))).cast("double") / F.when(F.col("open") > 0, F.col("open")).cast("double")
    return per.select("skey", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def shuffled(docs: DataFrame, seed: str, own: Column, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, skey, key, size, own``: size in words, key the place in the source's shuffle."""
    source = F.col(source_col).cast("string")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        source.alias("source"),
        F.coalesce(F.concat(F.lit("="), source), F.lit("null")).alias("skey"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))).alias("key"),
        word_count(text_col).alias("size"),
        own.alias("own"),
    )


def _taken(row_count: int, finish: list[Column], queued: DataFrame, repeats: int) -> Column:
    """How many of a document's ``repeats`` passes are served before the budget is used up."""
    spark_rows = queued.select("key", "size", F.posexplode(F.array(*finish)).alias("pass", "finish")).where("size > 0 AND finish IS NOT NULL")
    slices = max(16, math.isqrt(row_count))
    sliced = spark_rows.withColumn("slice", F.floor(F.least(F.col("finish"), F.lit(4.0)) * slices))
    budget = queued.agg(F.sum("size")).first()[0] or 0
    sums = sliced.groupBy("slice").agg(F.sum("size").alias("words"))
    order = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = sums.withColumn("upto", F.sum("words").over(order)).where(F.col("upto") > budget)
    over = run.orderBy("slice").limit(1).collect()
    if not over:
        return F.lit(repeats)
    at, base = over[0]["slice"], over[0]["upto"] - over[0]["words"]
    inside = Window.partitionBy("slice").orderBy("finish", "key", "pass").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = (
        sliced.where(F.col("slice") == at)
        .withColumn("upto", F.sum("size").over(inside) + base)
        .where(F.col("upto") <= budget)
        .orderBy(F.desc("finish"), F.desc("key"), F.desc("pass"))
        .limit(1)
        .collect()
    )
    served = []
    for k, f in enumerate(finish):
        if last:
            cut_at = F.struct(F.lit(last[0]["finish"]).alias("f"), F.lit(last[0]["key"]).alias("k"), F.lit(last[0]["pass"]).alias("p"))
            ok = F.struct(f.alias("f"), F.col("key").alias("k"), F.lit(k).alias("p")) <= cut_at
        else:
            ok = F.floor(F.least(f, F.lit(4.0)) * slices) < at
        served.append(F.when(ok, 1).otherwise(0))
    return sum(served[1:], served[0])


def mix(docs: DataFrame, weights=WEIGHTS, repeats: int = MAX_REPEATS, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken``, a row for each row of docs.

    The budget is the size of all documents. A source's target is its weight's share of it, at most
    ``repeats`` times its size. copies is how often the mix holds the document, taken its words so far.
    Null texts have size 0, null sources form one source, documents without words are never taken. Rows
    that repeat an id are separate documents. An empty table gives none; reruns agree.
    """
    return _mixed(docs, F.lit(0).cast("long"), weights, repeats, seed, id_col, text_col, source_col).drop("own")


def _mixed(docs: DataFrame, own: Column, weights=WEIGHTS, repeats: int = MAX_REPEATS, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    sized = cut(shuffled(docs, seed, own, id_col, text_col, source_col))
    rows = sized.count()
    digits = max(1, math.ceil(math.log(max(rows, 2), 256)))
    sized = sized.withColumn("range", F.substring("key", 1, digits))
    targets = source_targets(sized, weights, repeats)
    sums = sized.groupBy("skey", "range").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("skey").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = sums.withColumn("base", F.sum("words").over(before) - F.col("words")).drop("words").join(targets, "skey")
    inside = Window.partitionBy("skey", "range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queued = sized.join(base, ["skey", "range"]).withColumn("queued", F.sum("size").over(inside) + F.col("base"))
    queued = cut(queued.select("doc_id", "key", "size", "source_size", "target", "queued", "own"))
    finish = [(F.lit(k) * F.col("source_size") + F.col("queued")).cast("double") / F.when(F.col("target") > 0, F.col("target")) for k in range(repeats)]
    copies = F.when(F.col("size") > 0, F.coalesce(_taken(rows, finish, queued, repeats), F.lit(0))).otherwise(0)
    return queued.withColumn("copies", copies.cast("int")).withColumn("taken", (F.col("size") * F.col("copies")).cast("long"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; columns and their names stay.

    Rows that share an id are told apart by a hash of all their columns; rows that are equal in all of them
    are interchangeable and together stand as often as the mix takes them. Null ids take part.
    """
    own = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if not isinstance(docs.schema[c].dataType, MapType)])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), own.alias("own"))
    found = _mixed(docs, own, id_col=id_col, text_col=text_col, **options)
    found = cut(found.groupBy(F.col("doc_id").alias("i"), F.col("own").alias("o")).agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("rows")).where("n > 0"))
    key = F.col("id").eqNullSafe(F.col("i")) & (F.col("own") == F.col("o"))
    out = rows.join(found.where("rows = 1"), key).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("row.*")
    total, n_many = found.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count_if(F.col("rows") > 1)).first()
    if not n_many:
        return out
    # equal rows become one on the way to the shuffle; its copies are dealt out again in portions
    many = found.where("rows > 1")
    hot = F.col("rows") > total / HOT_SHARE  # at most a thousand
    equal = rows.join(F.broadcast(many.where(hot)), key, "left_semi").unionByName(rows.join(many.where(~hot), key, "left_semi"))
    one = equal.groupBy("id", "own").agg(F.first("row").alias("row")).join(many, key)
    dealt = one.select("row", "n", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PORTION))).alias("p")).repartition("own", "p")
    again = dealt.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(PORTION), F.col("n") - F.col("p") * PORTION)))).select("row.*")
    return out.unionByName(again)


def op1(spark, sf_dir):
    return mix(dealt(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


SQL = {
    "op1_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM sized GROUP BY source),
sums AS (
  SELECT *, 3 * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total,
         CAST(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS BIGINT) - 3 * source_size AS before,
         CAST(sum(w) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest
  FROM per),
fill AS (SELECT *, cap * rest <= w * (total - before) AS is_full FROM sums),
targets AS (
  SELECT source, source_size, total,
         CASE WHEN is_full THEN CAST(cap AS DOUBLE)
              ELSE CAST(w * (total - coalesce(sum(cap) FILTER (is_full) OVER (), 0)) AS DOUBLE) / CAST(sum(w) FILTER (NOT is_full) OVER () AS DOUBLE) END AS target
  FROM fill),
queued AS (
  SELECT doc_id, s.key, s.size, source_size, target, total,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY key, s.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS q
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
served AS (
  SELECT doc_id, key, size, q, p.pass, sum(size) OVER (
           ORDER BY CAST(p.pass * source_size + q AS DOUBLE) / target, key, p.pass ROWS UNBOUNDED PRECEDING) <= total AS ok
  FROM queued, (SELECT unnest([0, 1, 2]) AS pass) p WHERE size > 0),
counted AS (SELECT doc_id, key, size, q, count(*) FILTER (ok) AS n FROM served GROUP BY ALL)
SELECT doc_id, size, source_size, target, CAST(size * coalesce(n, 0) AS BIGINT) AS taken
FROM queued LEFT JOIN counted USING (doc_id, key, size, q)
"""
}
QUERIES = {"op1_mix_sources": op1}
