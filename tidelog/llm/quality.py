"""Quality rules as a learned decision list, applied as one ordered Spark conditional expression.

Statistics of whole texts come from built-in functions only. Sequential covering grows a conjunction of
thresholds by information gain on two thirds of the labelled rows, prunes it on the other third by
(p - n) / (p + n), keeps it if its precision there is high enough, removes what it covers, and goes on.
The list rejects on its first rule that holds; a document that no rule covers is kept.

Repeated 8-word windows are found by 64-bit hashes of windows inside a text, and compared word by word
where hashes meet.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, WS_RUN, dealt, table, text_or_empty

WINDOW = 8
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Labelled rows used for fitting, the first by a hash of their id.
MAX_FIT_ROWS = 4000


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_bangs, n_lines, n_kinds``.

    A null text counts as empty. With keep, ``row`` has the whole row of docs as a struct, so that no name
    clashes. A row for each row, repeated ones too; an empty table gives none.
    """
    t = F.col("t")
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep else []
    df = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t"), *row)
    row = ["row"] if keep else []
    bare = F.btrim(t, F.lit(WS))
    df = df.select(
        "doc_id",
        *row,
        F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WS_RUN)).alias("w"),
        F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WS)) != "").alias("l"),
        F.length(F.translate(t, WS, "")).alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).alias("n_symbols"),
        (F.length(t) - F.length(F.translate(t, UPPER, ""))).alias("n_upper"),
        (F.length(t) - F.length(F.translate(t, "!?", ""))).alias("n_bangs"),
    )
    # Hashes of windows of 2, 4 and 8 words, each from two of the half length. Each array is named at
    # least twice in the next step, so that the optimizer does not move it into the per-element function.
    n = F.size("w")
    df = df.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    for step in (1, 2, 4):
        m = F.greatest(F.size("h") - F.lit(step), F.lit(0))
        df = df.withColumn("h", F.zip_with(F.slice("h", 1, m), F.slice("h", step + 1, m), lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn("twice", F.size(F.array_distinct("h")) < F.size("h"))
    z = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    # A filter on the results must not be moved below this step, where each array would be made anew for
    # each element; a step that is not deterministic stops it.
    df = df.withColumn("z", F.when(F.col("twice") & (F.monotonically_increasing_id() >= 0), z))
    words = lambda x: F.slice("w", x["i"] + 1, F.lit(WINDOW))
    meets = lambda x, y: x["h"].eqNullSafe(y["h"]) & (words(x) == words(y))
    again = F.filter(F.col("z"), lambda x, k: meets(x, F.get("z", k - 1)) | meets(x, F.get("z", k + 1)))
    starts = F.sort_array(F.transform(again, lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, p: F.struct((p + WINDOW).alias("end"), (acc["n"] + p + WINDOW - F.greatest(acc["end"], p)).alias("n")),
        lambda acc: acc["n"],
    )
    long = lambda c: c.cast("long")
    return df.select(
        "doc_id",
        long(n).alias("n_words"),
        long(F.col("word_chars")).alias("word_chars"),
        long(F.col("n_symbols")).alias("n_symbols"),
        long(F.size("l") - F.size(F.array_distinct("l"))).alias("n_dup_lines"),
        long(F.when(F.col("twice") & (F.size("z") > 0), covered).otherwise(0)).alias("n_repeat_words"),
        long(F.col("n_upper")).alias("n_upper"),
        long(F.col("n_bangs")).alias("n_bangs"),
        long(F.size("l")).alias("n_lines"),
        long(F.size(F.array_distinct("w"))).alias("n_kinds"),
        *row,
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1)).cast("double")


def features() -> dict[str, Column]:
    """What thresholds are put on."""
    return {
        "word_length": _ratio("word_chars", "n_words"),
        "symbols": _ratio("n_symbols", "n_words"),
        "dup_lines": _ratio("n_dup_lines", "n_lines"),
        "repeats": _ratio("n_repeat_words", "n_words"),
        "upper": _ratio("n_upper", "word_chars"),
        "bangs": _ratio("n_bangs", "n_words"),
        "kinds": _ratio("n_kinds", "n_words"),
    }


def learn(rows: list[tuple], names: list[str], max_rules: int = 8, max_terms: int = 3, min_precision: float = 0.97, min_cover: int = 3, cuts: int = 64) -> list[list[tuple[str, str, float]]]:
    """Rules for class 1 from rows of (feature values ..., class), each a conjunction of (name, sign, threshold).

    Rows of one class alone, or too few of class 1, give no rule.
    """
    grow = [r for i, r in enumerate(rows) if i % 3]
    prune = [r for i, r in enumerate(rows) if not i % 3]
    holds = lambda r, rule: all(r[j] > x if up else r[j] <= x for j, up, x in rule)
    found: list[list[tuple[int, bool, float]]] = []

    def counts(data, rule):
        hit = [r[-1] for r in data if holds(r, rule)]
        return sum(hit), len(hit) - sum(hit)

    while len(found) < max_rules and sum(r[-1] for r in grow) >= min_cover:
        rule: list[tuple[int, bool, float]] = []
        inside = grow
        while len(rule) < max_terms and any(not r[-1] for r in inside):
            p0 = sum(r[-1] for r in inside)
            n0 = len(inside) - p0
            best = (0.0, None)
            for j in range(len(names)):
                ordered = sorted((r[j], r[-1]) for r in inside)
                step = max(1, len(ordered) // cuts)
                # every change of class is a place to cut, thinned to about `cuts` of them, rare ends whole
                below_p = below_n = 0
                spots = {*range(step, len(ordered), step), *range(1, min(cuts, len(ordered))), *range(max(1, len(ordered) - cuts), len(ordered))}
                for i, (x, y) in enumerate(ordered):
                    if i in spots and ordered[i - 1][0] < x:
                        mid = (ordered[i - 1][0] + x) / 2
                        for up, p, n in ((False, below_p, below_n), (True, p0 - below_p, n0 - below_n)):
                            if p >= min_cover:
                                gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                                if gain > best[0] + 1e-9:
                                    best = (gain, (j, up, mid))
                    below_p += y
                    below_n += 1 - y
            if best[1] is None:
                break
            rule.append(best[1])
            inside = [r for r in inside if holds(r, rule)]
        if not rule:
            break

        def worth(terms):
            p, n = counts(prune, terms)
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        p, n = (sum(x) for x in zip(counts(prune, rule), counts(grow, rule), strict=True))
        if p < min_cover or p < min_precision * (p + n):
            break
        found.append(rule)
        grow = [r for r in grow if not holds(r, rule)]
        prune = [r for r in prune if not holds(r, rule)]
    return [[(names[j], ">" if up else "<=", x) for j, up, x in rule] for rule in found]


def expression(rules: list[list[tuple[str, str, float]]]) -> Column:
    """The ordered conditional: false (rejected) at the first rule that holds, else true (kept)."""
    feats = features()
    verdict = None
    for rule in rules:
        cond = F.lit(True)
        for name, sign, x in rule:
            cond = cond & (feats[name] > F.lit(x) if sign == ">" else feats[name] <= F.lit(x))
        verdict = F.when(cond, False) if verdict is None else verdict.when(cond, False)
    return F.lit(True) if verdict is None else verdict.otherwise(True)


def fit(docs: DataFrame, labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", **options) -> list:
    """Rules that reject label ``quality`` 0, from at most ``max_fit_rows`` labelled documents that pass the base rules.

    Ids with both labels, or labels other than 0 and 1, take no part.
    """
    good = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q2")).where("q = q2")
    chosen = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit_rows).select(F.col("doc_id").alias("__id"), "q")
    # at most max_fit_rows ids, so the broadcast is bounded
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    feats = features()
    stats = statistics(picked.select(F.struct("doc_id", "q").alias("doc_id"), "text"))
    # at most max_fit_rows ids; repeats of an id count once
    rows = stats.groupBy("doc_id").agg(F.max(base_failed()).alias("failed"), *[F.min(c).alias(k) for k, c in feats.items()])
    rows = rows.orderBy(F.xxhash64("doc_id.doc_id"), "doc_id.doc_id")
    got = [(*(r[k] for k in feats), 1 - r["doc_id"]["q"]) for r in rows.collect() if not r["failed"]]
    return learn(got, list(feats), **options)


def judge(docs: DataFrame, rules: list, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``, a row for each row of docs.

    Null and empty texts have no words, so they fail the base rules. An empty table gives none.
    """
    s = statistics(docs, id_col, text_col).withColumn("base_failed", base_failed())
    kept = ~F.col("base_failed") & expression(rules)
    return s.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with their columns; no shuffle."""
    kept = statistics(docs, keep=True).where(~base_failed() & expression(fit(docs, labels)))
    return kept.select("row.*")


def op4(spark, sf_dir):
    docs = dealt(table(spark, sf_dir, "documents"))
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))


def base(spark, sf_dir):
    """The columns of op4 that no learning goes into, which SQL can express."""
    found = judge(dealt(table(spark, sf_dir, "documents")), [])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES = {"op4_quality_rules": op4, "quality_base": base}
SQL = {
    "quality_base": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
p AS (SELECT r, unnest(range(1, len(w) - 6)) AS i, w FROM s WHERE len(w) >= 8),
q AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i:i+7]) AS n FROM p),
c AS (SELECT r, count(DISTINCT i + j) AS n FROM q, (SELECT unnest(range(0, 8)) AS j) WHERE n > 1 GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
       CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(w) < 20 OR 100 * coalesce(c.n, 0) > 30 * len(w) AS base_failed
FROM s LEFT JOIN c USING (r)
"""
}
