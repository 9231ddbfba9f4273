"""The corpus pipeline: stages over `documents`, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import decontaminate, ngram_join, packing, quality, secrets
from lectern.llm.common import cut, table


#: Distinct pieces of text that a worker keeps while it packs.
KEPT_PIECES = 120_000


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies and near copies one row stays, of the smallest id if there is one."""
    return ngram_join.first_of_each(docs, repeats=False)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document that is mostly benchmark goes."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, a row for each piece of a document. Workers have other stages to serve, so
    they keep few pieces of text, and none after a task."""
    return packing.pack(docs, kept=KEPT_PIECES)


STAGES = [
    ("quality classifier", good),
    ("n-gram Jaccard join", single),
    ("benchmark decontamination", decontaminated),
    ("secret scans", redacted),
    ("packing", packed),
]

#: No stage is in SQL's reach; tests hold the whole against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, "stage")
    return docs
