"""Exact top-k inner-product search over norm-sorted vectors with SVD-rotated partial sums.

Vectors are quantized to integers. The second moments of all of them (one small matrix from each task) give
the rotation, the right singular vectors of the whole table. Candidates are cut into ranges of their length,
and a range into cells that fit a task. Every query first meets the longest vectors, a bounded number that
goes to all tasks: its k-th best score there is a floor. By Cauchy-Schwarz a candidate shorter than floor /
|q| cannot reach it, so a query is sent only to the cells of the ranges above that, and shorter candidates
are pruned before anything is moved. What is moved is queries; candidates move once.

In a cell candidates stand in descending order of length and the cell's queries stream by in blocks: once
|q| |x| is under the k-th best of every query of the block, the rest is skipped. Before that, the product
over the first rotated components plus the product of the residual lengths bounds each score; only pairs
whose bound reaches the query's k-th best are multiplied out, in integers.

Work and moved rows are queries times candidate cells at worst, as for any exact search where the bounds do
not bite: N / 20 queries and N / CELL_ROWS cells here. A task holds one cell and one block of queries.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

TOP_K = 20
QUERY_EVERY = 20
#: Queries that meet a cell together, and candidates they meet at a time.
QUERY_BLOCK = 1024
CHUNK = 1024
#: Components of the candidates that a task holds.
CELL_VALUES = 4_000_000
#: The longest vectors, which every query meets first, at most so many components; and at most so many ranges of length.
SEEDS = 2048
SEED_VALUES = 1_000_000
MAX_RANGES = 2048


def quantized(vectors: DataFrame, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, q, n2``: floor(scale * x) of each component as a long, and the squared length.

    Rows with a null id, a null vector, or a null or non-finite component are left out.
    """
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    df = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where("vec_id IS NOT NULL AND x IS NOT NULL")
    df = df.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    df = df.select("vec_id", F.transform("x", lambda v: F.floor(v * scale).cast("long")).alias("q"))
    return df.withColumn("n2", F.aggregate("q", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))


def _matrix(column, dims: int):
    """The list column as an array of dims columns; short vectors are filled up with zeros."""
    import numpy as np

    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    n = np.diff(offsets)
    if (n == dims).all():
        return flat[offsets[0] : offsets[-1]].reshape(-1, dims)
    out = np.zeros((len(n), dims), np.int64)
    for i, (a, k) in enumerate(zip(offsets[:-1], n, strict=True)):
        out[i, :k] = flat[a : a + k]
    return out


def rotation(vectors: DataFrame, dims: int):
    """The right singular vectors of the table, largest first, from its second moments."""
    import numpy as np

    def moments(batches):
        import pyarrow as pa

        total = np.zeros((dims, dims))
        for b in batches:
            x = _matrix(b.column("q"), dims).astype(np.float64)
            total += x.T @ x
        i, j = np.indices((dims, dims))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel(), pa.float64())], names=["i", "j", "v"])

    m = np.zeros((dims, dims))
    for r in vectors.select("q").mapInArrow(moments, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # dims x dims rows
        m[r["i"], r["j"]] = r["v"]
    values, basis = np.linalg.eigh(m)
    return basis[:, np.argsort(-values)]


class Cell:
    """Candidates in descending order of length, with their rotated parts."""

    def __init__(self, ids, x, basis, head: int, exact):
        import numpy as np

        order = np.argsort(-np.square(x.astype(np.float64)).sum(1), kind="stable")
        self.ids, x = ids[order], x[order]
        r = x.astype(np.float64) @ basis
        self.x, self.head = x.astype(exact), head
        self.first = r[:, :head]
        self.rest = np.sqrt(np.square(r[:, head:]).sum(1))
        self.norm = np.sqrt(np.square(r).sum(1))


class Block:
    """The k best candidates so far of each query of a block; ``floor`` is what a score must reach."""

    def __init__(self, ids, q, floor, basis, head: int, k: int, exact):
        import numpy as np

        self.ids, self.q, self.k, self.exact = ids, q.astype(exact), k, exact
        r = q.astype(np.float64) @ basis
        self.first = r[:, :head]
        self.rest = np.sqrt(np.square(r[:, head:]).sum(1))
        self.norm = np.sqrt(np.square(r).sum(1))
        self.top: list[list] = [[] for _ in ids]  # (-score, id), best first
        self.least = np.array(floor, np.float64)
        self.least_id = np.full(len(ids), np.iinfo(np.int64).max)

    def meet(self, cell: Cell) -> None:
        for at in range(0, len(cell.ids), CHUNK):
            if not self._offer(cell, slice(at, at + CHUNK)):
                break

    def _offer(self, cell: Cell, part) -> bool:
        """False if no later candidate can count."""
        import numpy as np

        longest = cell.norm[part.start]
        slack = 1e-6 * (1.0 + self.norm * longest)
        open_ = np.flatnonzero(self.norm * longest + slack >= self.least)
        if not len(open_):
            return False
        bound = self.first[open_] @ cell.first[part].T + self.rest[open_, None] * cell.rest[None, part] + slack[open_, None]
        may = bound >= self.least[open_, None]
        rows, cols = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
        if not len(rows):
            return True
        at = open_[rows]
        score = self.q[at] @ cell.x[part][cols].T
        cid = cell.ids[part][cols]
        good = (score > self.least[at, None]) | ((score == self.least[at, None]) & (cid[None, :] < self.least_id[at, None]))
        good &= cid[None, :] != self.ids[at, None]
        for i in np.flatnonzero(good.any(1)):
            j = np.flatnonzero(good[i])
            found, c = score[i, j], cid[j]
            if len(j) > self.k:
                pick = np.lexsort((c, -found))[: self.k]
                found, c = found[pick], c[pick]
            t = at[i]
            best = sorted(self.top[t] + list(zip((-found).tolist(), c.tolist(), strict=True)))[: self.k]
            self.top[t] = best
            if len(best) == self.k and -best[-1][0] >= self.least[t]:
                self.least[t], self.least_id[t] = -best[-1][0], best[-1][1]
        return True

    def rows(self):
        return [(int(q), int(c), int(-s)) for q, best in zip(self.ids, self.top, strict=True) for s, c in best]


def _range_of(bounds: list[float], value: Column) -> Column:
    """How many of the ascending bounds are at or below value, by bisection."""
    if not bounds:
        return F.lit(0)
    held = F.lit([float(b) for b in bounds])
    steps = F.lit([1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda n, k: F.when(F.get(held, n + k - 1) <= value, n + k).otherwise(n))


def top_k(vectors: DataFrame, is_query, k: int = TOP_K, cell_values: int = CELL_VALUES, seeds: int = SEEDS, head: int | None = None, **options) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other rows of each query, ties to the smaller id.

    is_query is a condition on ``vec_id``. Rows that repeat the query's id are not its candidates; repeated
    rows with other ids all are. Equal query rows give one list, and those of one id with other vectors one
    list of all their scores. Rows with a null id or vector, or a null or non-finite component, take no part;
    shorter vectors are filled up with zeros. An empty table, or one without queries, gives none. Products
    beyond a long raise an error.
    """
    import numpy as np

    data = cut(quantized(vectors, **options))
    spark = data.sparkSession
    facts = data.agg(F.max(F.size("q")).alias("dims"), F.max("n2").alias("n2"), F.count(F.lit(1)).alias("rows"), F.count(F.when(is_query, 1)).alias("queries")).first()
    dims = facts["dims"] or 0
    if not dims or not facts["queries"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # sums of products of at most the squared length: exact in doubles below 2^53
    exact = np.dtype("float64" if facts["n2"] < 2**53 else "object")
    basis = rotation(data, dims)
    head = head or max(1, dims // 4)

    # ranges of length, at most MAX_RANGES, and cells of bounded size in each
    cell_rows = max(1, min(cell_values // dims, math.ceil(facts["rows"] / spark.sparkContext.defaultParallelism)))
    n = min(MAX_RANGES, math.ceil(facts["rows"] / cell_rows))
    bounds = sorted(set(data.approxQuantile("n2", [i / n for i in range(1, n)], 1 / (4 * n)))) if n > 1 else []
    placed = data.withColumn("range", _range_of(bounds, F.col("n2")))
    held = {r["range"]: r for r in placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.max("n2").alias("n2")).collect()}
    lanes = [math.ceil(held[r]["n"] / cell_rows) if r in held else 0 for r in range(len(bounds) + 1)]
    first_cell = np.concatenate([[0], np.cumsum(lanes)]).tolist()
    cells = first_cell[-1]
    longest = np.maximum.accumulate([math.sqrt(held[r]["n2"]) if r in held else 0.0 for r in range(len(bounds) + 1)]).tolist()

    # each query's floor: its k-th best score among the longest vectors
    seeds = max(k + 1, min(seeds, SEED_VALUES // dims))
    longest_rows = data.orderBy(F.desc("n2"), "vec_id").limit(seeds).select("vec_id", "q").toArrow()  # 8 MB at most
    seed_ids = longest_rows.column("vec_id").to_numpy()
    seed_x = _matrix(longest_rows.column("q").combine_chunks(), dims)
    shared = spark.sparkContext.broadcast((seed_ids, seed_x, basis))

    def floors(batches):
        import pyarrow as pa

        ids, x, _ = shared.value
        for b in batches:
            own, q = b.column("vec_id").to_numpy(), _matrix(b.column("q"), dims)
            floor = np.full(len(own), -np.inf)
            for at in range(0, len(own), QUERY_BLOCK):
                part = slice(at, at + QUERY_BLOCK)
                score = (q[part].astype(exact) @ x.astype(exact).T).astype(np.float64)
                score[own[part, None] == ids[None, :]] = -np.inf
                if score.shape[1] >= k:
                    floor[part] = np.partition(score, -k, axis=1)[:, -k]
            norm = np.sqrt(np.square(q.astype(np.float64)).sum(1))
            # a little below, so that rounding loses no candidate; an object product is rounded to a double too
            floor = np.where(floor > -np.inf, floor - (0.0 if exact == np.float64 else 1.0) * (1 + 1e-9 * np.abs(floor)), floor)
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(norm > 0, (floor - 1e-6 * (1 + np.abs(floor))) / norm, -np.inf)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("q"), pa.array(floor), pa.array(need)], names=["vec_id", "q", "floor", "need"])

    asked = data.where(is_query).select("vec_id", "q").dropDuplicates(["vec_id", "q"]).mapInArrow(floors, "vec_id long, q array<long>, floor double, need double")
    # ranges whose longest vector is under ``need`` come first; the query goes to the cells of the others
    below = F.get(F.lit([*first_cell[:-1], cells]), _range_of([float(np.nextafter(x, np.inf)) for x in longest], F.col("need")))
    asked = asked.withColumn("below", below.cast("long")).where(F.col("below") < cells)
    asked = asked.select(F.explode(F.sequence("below", F.lit(cells - 1).cast("long"))).alias("cell"), F.lit(1).alias("side"), F.lit(0.0).alias("n2"), "vec_id", "q", "floor")
    lane = F.pmod(F.xxhash64("vec_id"), F.get(F.lit([max(1, x) for x in lanes]), F.col("range")))
    offered = placed.select((F.get(F.lit(first_cell), F.col("range")) + lane).cast("long").alias("cell"), F.lit(0).alias("side"), "n2", "vec_id", "q", F.lit(None).cast("double").alias("floor"))
    met = asked.unionByName(offered).repartition(min(cells, 20_000), "cell").sortWithinPartitions("cell", "side")

    def search(batches):
        import pyarrow as pa

        basis = shared.value[2]
        now, cell, pending = None, None, []
        for b in batches:
            key, side, floor = (b.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "side", "floor"))
            ids, x = b.column("vec_id").to_numpy(), _matrix(b.column("q"), dims)
            edges = np.flatnonzero((np.diff(key) != 0) | (np.diff(side) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(key)], strict=True):
                if lo == hi:
                    continue
                if key[lo] != now:
                    now, cell, pending = key[lo], None, []
                if side[lo] == 0:
                    pending.append((ids[lo:hi].copy(), x[lo:hi].copy()))
                    continue
                if cell is None:
                    if not pending:  # repeated ids may leave a cell empty
                        continue
                    cell = Cell(*(np.concatenate(p) for p in zip(*pending, strict=True)), basis, head, exact)
                    pending = []
                for at in range(lo, hi, QUERY_BLOCK):
                    part = slice(at, min(hi, at + QUERY_BLOCK))
                    block = Block(ids[part], x[part], floor[part], basis, head, k, exact)
                    block.meet(cell)
                    rows = block.rows()
                    cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    found = met.mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)


SQL = {
    "op3_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
}
QUERIES = {"op3_topk_search": op3}
