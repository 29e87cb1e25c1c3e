"""The corpus pipeline: reject toxic documents, drop repeated lines, keep one of each
near-duplicate group, drop documents with benchmark items, and encode what is left.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and
read again as the next stage's documents. No stage can be stated in SQL with
equal results, so ``ORACLE_SQL`` is None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pageloom.llm import bpe, decontaminate, line_dedup, ngram_join, toxicity
from pageloom.llm._spark import Store, give_back, table

ORACLE_SQL = None


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    give_back()  # what training took on the driver; the stages after it need the room
    return toxicity.reject(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.apply(docs, line_dedup.duplicates(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.apply(docs, ngram_join.groups(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.apply(docs, decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.apply(docs)


STAGES = [
    ("toxicity", toxic),
    ("line_dedup", lines),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("byte_bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last passes through the shared folder."""
    store, docs = Store(spark), table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = store.keep(docs)
    return docs
