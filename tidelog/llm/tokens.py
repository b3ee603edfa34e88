"""Token counts by a map-side two-tier lookup, without a shuffle of pre-tokens.

The tokenizer never joins text across white space, so a pre-token here is a run of bytes without ASCII
blanks, and a document's count is the sum over its pre-tokens. Tier one is a broadcast table from the
frequent pre-tokens of a bounded sample of documents to their token counts: at most ``table_entries``
entries of at most ``max_key`` bytes. Tier two is a cache in each Python worker, of at most
``cache_entries`` such entries; what it misses is encoded in batches. The sample only decides what is
fast: every pre-token of every document is counted, whichever tier has it.
"""

from __future__ import annotations

import os
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column, dealt, table

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
MAX_KEY = 48
TABLE_ENTRIES = 50_000
CACHE_ENTRIES = 400_000
SAMPLE_DOCS = 500
SAMPLE_CHARS = 20_000

_tokenizers: dict = {}
_caches: dict = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _tokenizer(path: str):
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _tokenizers[path] = t
    return _tokenizers[path]


def encode_lengths(path: str, words: list[bytes]) -> list[int]:
    t = _tokenizer(path)
    out = []
    for at in range(0, len(words), 4096):
        out += [len(e) for e in t.encode_batch_fast([w.decode() for w in words[at : at + 4096]], add_special_tokens=False)]
    return out


def frequent_table(docs: DataFrame, path: str, text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, entries: int = TABLE_ENTRIES) -> dict[bytes, int]:
    """Token counts of the most frequent pre-tokens in the first documents found that are not over-long."""
    rows = docs.select(F.col(text_col).alias("t")).where(F.length("t").between(1, sample_chars)).take(sample_docs)
    seen = Counter()
    for r in rows:
        seen.update(w for w in r["t"].encode().split() if len(w) <= MAX_KEY)
    words = [w for w, _ in seen.most_common(entries)]
    return dict(zip(words, encode_lengths(path, words), strict=True))


def count_text(data: bytes, first: dict, cache: dict, path: str, cache_entries: int) -> int:
    words = data.split()
    found = list(map(first.get, words))
    if None not in found:
        return sum(found)
    rest = [w for w, n in zip(words, found, strict=True) if n is None]
    unknown = {w for w in rest if w not in cache}
    if unknown:
        short = [w for w in unknown if len(w) <= MAX_KEY]
        if len(cache) + len(short) > cache_entries:
            cache.clear()
            unknown = set(rest)
            short = [w for w in unknown if len(w) <= MAX_KEY]
        now = dict(zip(short, encode_lengths(path, short), strict=True))
        cache.update(now)
        if len(short) < len(unknown):
            long = [w for w in unknown if len(w) > MAX_KEY]
            now.update(zip(long, encode_lengths(path, long), strict=True))
        more = sum(n if (n := now.get(w)) is not None else cache[w] for w in rest)
    else:
        more = sum(map(cache.__getitem__, rest))
    return sum(n for n in found if n is not None) + more


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", cache_entries: int = CACHE_ENTRIES, **table_options) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``, a row for each row of docs.

    Null and empty texts have 0 bytes and 0 tokens. Special strings inside a text are tokenized as the
    library does by default, none is added. An empty table gives none.
    """
    path = path or tokenizer_path()
    shared = docs.sparkSession.sparkContext.broadcast(frequent_table(docs, path, text_col, **table_options))

    def run(batches):
        import pyarrow as pa

        first, cache = shared.value, _caches.setdefault(path, {})
        for b in batches:
            sizes, counts = [], []
            for t in binary_column(b, "text"):
                t = t or b""
                sizes.append(len(t))
                counts.append(count_text(t, first, cache, path, cache_entries))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6(spark, sf_dir):
    return count_tokens(dealt(table(spark, sf_dir, "documents")))


QUERIES = {"op6_token_counts": op6}
SQL: dict[str, str] = {}
