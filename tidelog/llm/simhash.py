"""SimHash near-duplicate groups through a byte-position inverted index with count filtering.

A 64-bit fingerprint has eight positional bytes. Two fingerprints that differ in at most four bits share at
least four of them. A list for one byte would hold a 256th of the corpus, so postings are keyed by three
positional bytes: 20 triples of positions cover every set of four. A list of over ``max_list`` is split by
each further positional byte, of which a linked pair shares one at least, so lists stay short up to
``max_list`` times 2^32 unrelated fingerprints. Within a list the shared positional bytes of a pair are
tallied; pairs reaching the guaranteed four are verified bit by bit.

A list that is still too long holds copies edited in many ways, and is not paired off. Its members post all
values within half the distance of them: two fingerprints at distance d share a value at distance d/2 of
both, so linking each member to the smallest member of a posted value connects exactly what the pairs would
have connected, with work in proportion to the members.

Only distinct fingerprints are indexed: exact copies meet in an aggregation, not in a join. Joins by a
fingerprint or a root send keys with over a thousandth of the rows by broadcast, at most a thousand keys.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, MapType, StructField, StructType

from .common import binary_column, cut, dealt, free_name, look_up, table

BITS = 64
BYTES = 8


def covering_triples(n: int = BYTES, share: int = 4) -> list[tuple[int, ...]]:
    """Position triples such that every set of ``share`` positions holds at least one.

    Turan's construction: three near-equal groups in a ring; take the triples inside a group, and those
    with two positions in a group and one in the next.
    """
    if share != 4:
        raise ValueError("the construction is for four shared positions")
    groups = [list(range(n))[i::3] for i in range(3)]
    out = []
    for i, g in enumerate(groups):
        after = groups[(i + 1) % 3]
        out += [tuple(sorted(t)) for t in combinations(g, 3)]
        out += [tuple(sorted((*two, one))) for two in combinations(g, 2) for one in after]
    return sorted(out)


def fingerprint(text: bytes, width: int = 4) -> int:
    """Fingerprint of one text as an unsigned integer; no word gives 0."""
    import numpy as np
    import xxhash

    words = text.lower().split()  # bytes: A-Z and the six ASCII blanks only
    n = len(words)
    if not n:
        return 0
    h64 = xxhash.xxh64_intdigest
    if n <= width:
        return h64(b" ".join(words), 42)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = [0, *ends[: n - width].tolist()]
    stops = (ends[width - 1 :] - 1).tolist()
    m = n - width + 1
    h = np.fromiter((h64(flat[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, m)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, m, 1 << 15):
        part = h[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, BYTES)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > m).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """``doc_id, fp`` with fp as a signed long; null and blank texts have 0. Rows are kept as they are."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            fps = np.array([fingerprint(t or b"", width) for t in binary_column(b, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _byte(fp, p: int):
    return F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255))


def links(distinct: DataFrame, max_bits: int = 4, max_list: int = 64) -> DataFrame:
    """Links ``a, b`` (a < b) between distinct fingerprints ``fp`` that connect all within ``max_bits``.

    Every link is within ``max_bits`` or goes by a shared value half-way; none is lost to long lists.
    """
    if not 0 <= max_bits <= 4:
        raise ValueError("four shared bytes are guaranteed for at most 4 differing bits")
    fp = F.col("fp")
    triples = covering_triples()
    packed = [sum((_byte(fp, p) * F.lit(1 << (8 * i)) for i, p in enumerate(t)), F.lit(k << 24).cast("long")) for k, t in enumerate(triples)]
    listed = _listed(distinct.select(fp, F.explode(F.array(*packed)).alias("key")))
    # a long list by each position outside its triple and the byte there: the key has 5 + 24 bits, 3 and 8 more
    number = F.shiftright("key", 24)
    others = F.element_at(F.lit([[p for p in range(BYTES) if p not in t] for t in triples]), (number + 1).cast("int"))
    split = listed.where(F.col("n") > max_list).select("fp", "key", F.explode(others).alias("p"))
    byte = F.expr("shiftrightunsigned(fp, CAST(8 * p AS INT))").bitwiseAND(F.lit(255))
    again = _listed(split.select("fp", (F.col("key") * 2048 + F.col("p") * 256 + byte).alias("key")))
    pairs = _pairs(listed.where(F.col("n") <= max_list), max_bits).unionByName(_pairs(again.where(F.col("n") <= max_list), max_bits)).distinct()
    hot = again.where(F.col("n") > max_list).select("fp").distinct()
    return pairs.unionByName(_midpoint_links(hot, max_bits))


def _listed(posts: DataFrame) -> DataFrame:
    """``key, fp, n``: the postings whose list has n > 1 members."""
    counts = cut(posts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return cut(look_up(posts, counts.withColumn("__n", F.col("n")), "key", total))


def _pairs(short: DataFrame, max_bits: int) -> DataFrame:
    """``a, b`` (a < b) of each list that share enough positional bytes and differ in at most max_bits."""
    a, b = short.select("key", F.col("fp").alias("a")), short.select("key", F.col("fp").alias("b"))
    pairs = a.join(b, "key").where("a < b")
    tally = sum((F.when(_byte(F.col("a"), p) == _byte(F.col("b"), p), 1).otherwise(0) for p in range(BYTES)), F.lit(0))
    return pairs.where((tally >= BYTES - max_bits) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).select("a", "b")


def _midpoint_links(hot: DataFrame, max_bits: int) -> DataFrame:
    """Each fingerprint posts all values within half of max_bits; members of a value link to its smallest."""
    masks = {
        0: "array(0L)",
        2: "concat(array(0L), transform(sequence(0, 63), i -> shiftleft(1L, i)))",
        4: "concat(array(0L), flatten(transform(sequence(0, 63), i -> transform(sequence(i, 63), j -> shiftleft(1L, i) | shiftleft(1L, j)))))",
    }[max_bits]
    posted = hot.select("fp", F.explode(F.expr(f"transform({masks}, m -> fp ^ m)")).alias("v"))
    least = posted.groupBy("v").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z")
    return posted.join(least.select("v", "a"), "v").where("fp > a").select("a", F.col("fp").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root``: the smallest node that is reachable, for each node of the edges ``a, b``.

    Large-star and small-star passes in turn (Kiveris et al., 2014) until nothing moves. Each pass is an
    aggregation and a join on the edges; no component is gathered in one place.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    count = lambda: e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    seen = count()
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("__n")))
        large = look_up(both.where("v > u"), least, "u", 2 * seen["n"])
        large = cut(large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("__n")))
        small = look_up(large, low, "u", large.count()).select("v", "m")
        e = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = count()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 4, max_list: int = 64) -> DataFrame:
    """``doc_id, fp, component_id``, a row for each row of docs.

    component_id is the smallest id reachable over links of at most ``max_bits`` differing bits. Null and
    blank texts have fingerprint 0 and link like any other; null ids take part and are never the smallest
    (a component of null ids alone has null). Repeated ids keep their rows. An empty table gives none.
    """
    return _rooted(docs, id_col, text_col, max_bits, max_list).select("doc_id", "fp", "component_id")


def _rooted(docs: DataFrame, id_col: str, text_col: str, max_bits: int = 4, max_list: int = 64) -> DataFrame:
    """The same with ``root``, the component's smallest fingerprint."""
    fps = cut(fingerprints(docs, id_col, text_col))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")))
    roots = components(links(distinct.select("fp"), max_bits, max_list))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted)
    best = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("__n")))
    sizes = rooted.agg(F.count(F.lit(1)).alias("fps"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    by_fp = cut(look_up(rooted, best, "root", sizes["fps"]).select("fp", "component_id", "root", F.col("rows").alias("__n")))
    return look_up(fps, by_fp, "fp", sizes["rows"]).select("doc_id", "fp", "component_id", "root")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of docs for each group: that with the smallest id, nulls last; columns and their names stay.

    Of rows that share this id the one with the smallest fingerprint stays, then the smallest text. Fingerprints
    are made a second time for the rows whose id is null or repeated, and for no others. Blank and null texts
    are one group. An empty table gives none.
    """
    near = cut(_rooted(docs, id_col, text_col, **options))
    total = near.count()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("fp"))).alias("b")
    best = cut(near.groupBy("root").agg(first).select(F.col("b.doc_id").alias("id"), F.col("b.fp").alias("fp")))
    again = cut(near.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1"))
    own_id, own_fp = free_name(docs, "own_id"), free_name(docs, "own_fp")
    keyed = docs.withColumn(own_id, F.col(id_col).cast("long"))
    single = keyed.join(best.where("id IS NOT NULL").join(again.select("id"), "id", "left_anti").select(F.col("id").alias(own_id)), own_id, "left_semi")
    if not again.limit(1).count() and not near.where("doc_id IS NULL").limit(1).count():
        return single.select(*docs.columns)
    shared = look_up(keyed, again.withColumnRenamed("id", own_id), own_id, total, "left_semi").unionByName(keyed.where(F.col(own_id).isNull()))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            fps = np.array([fingerprint(t or b"") for t in binary_column(b, text_col)], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps.view(np.int64))], names=[*b.schema.names, own_fp])

    marked = shared.mapInArrow(run, StructType([*shared.schema.fields, StructField(own_fp, LongType())]))
    # one row of each id and fingerprint, by a running minimum on the way to the shuffle
    rest = F.xxhash64(*[F.col(c) for c in docs.columns if not isinstance(docs.schema[c].dataType, MapType)])
    one = marked.groupBy(own_id, own_fp).agg(F.min_by(F.struct(*[F.col(c) for c in docs.columns]), F.struct(F.col(text_col), rest)).alias("row"))
    chosen = one.join(best, one[own_id].eqNullSafe(best["id"]) & (one[own_fp] == best["fp"]), "left_semi").select("row.*")
    return single.select(*docs.columns).unionByName(chosen)


def op5(spark, sf_dir):
    found = near_duplicates(dealt(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op5_simhash_dedup": op5}
SQL: dict[str, str] = {}
