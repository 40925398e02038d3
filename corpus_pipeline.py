"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before it
kept, and its result is written as Parquet and read again for the next one:

quality rules            rejected documents go
n-gram Jaccard join      one document of each group of near copies stays (five words, 0.8)
benchmark decontamination  documents that hold a benchmark item go
secret scans             secrets are masked in the text
SentencePiece encoding   every text gets its ids

All but the last return the columns of documents; the last adds ``ids`` and
``n_tokens``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logtide.llm import decontaminate, ngram_join, quality_rules, secret_scan, sentencepiece_codec
from logtide.llm.common import load, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, gram=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, load(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.append_ids(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark),
    ("secret scans", secrets),
    ("SentencePiece encoding", encode),
]

#: Robust estimates, components and merges are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
