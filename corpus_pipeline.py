"""A training corpus from raw documents: quality, near duplicates, benchmark passages, secrets, tokens.

Each stage takes what its predecessor kept, as stored Parquet; its decisions take effect. All but the last return the columns of
``documents``.

1. ``quality``: documents that the classifier rejects go. It is trained on the labelled documents among its input.
2. ``near_duplicates``: one document of each class of linked fingerprints stays, the one with the smallest id.
3. ``decontamination``: contaminated documents go; documents with fewer hit words than one in twenty stay as they are.
4. ``secrets``: reported spans are replaced by a mark, documents stay.
5. ``tokens``: token ids and the digests of their round trip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evigrid.llm import bpe, decontaminate, quality, secret_scan, simhash
from evigrid.llm.common import table
from evigrid.llm.queries import tokenizer_path
from evigrid.session import materialise

#: a model, components and merged token lists are beyond SQL: tests compare the stages with plain versions
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, tokenizer_path(), outputs=("ids", "digests"))


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", without_secrets),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each one's rows are stored before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
