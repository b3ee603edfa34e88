"""Corpus pipeline: quality rules, near-duplicates, secrets, mixing, token ids.

Each stage works on all its predecessor kept and returns the columns of documents, whatever further ones they
have; the last returns ids. An empty table passes through.
"""

from __future__ import annotations

from tidelog.llm import mixing, pieces, quality, secrets, simhash
from tidelog.llm.common import table


def quality_rules(spark, docs, sf_dir):
    """Documents that the base rules or the learned list reject go; null, empty and very short texts are among them.

    Repeated rows are judged alike; ids may be null. Without labels the base rules decide alone.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark, docs, sf_dir):
    """One row of each group of near copies stays, the one with the smallest id, nulls last.

    Of rows that share that id the one with the smallest fingerprint and text stays.
    """
    return simhash.dedup(docs)


def secret_scan(spark, docs, sf_dir):
    """Secrets in the texts are masked; every row stays, null and empty texts as they are."""
    return secrets.redact(docs)


def mix_sources(spark, docs, sf_dir):
    """Each row as often as the mix takes it; rows without words are not taken, a null source is a source."""
    return mixing.mixed_documents(docs)


def token_ids(spark, docs, sf_dir):
    """Ids of each text, with sampled segmentations; a row for each row, null and empty texts have none.

    The workers keep less than by default, as they stay beside the executors' other stages.
    """
    return pieces.encode(docs, group_chars=200_000, max_edges=1_000_000)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("secret scan", secret_scan),
    ("mix sources", mix_sources),
    ("token ids", token_ids),
]

#: The learned rules, the fingerprints and the sampled ids have no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
