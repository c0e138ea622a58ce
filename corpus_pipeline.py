"""From documents to token ids: quality rules, near-duplicate removal, secret redaction, mixing of sources, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on everything that the one before kept. All but the last return the
columns of documents. Near duplicates are documents whose sets of five-word shingles have a Jaccard similarity of 0.8.
"""

from __future__ import annotations

import public_tokenizers
from bibliarium.llm import bpe, mixing, partenum, quality, secrets
from bibliarium.llm.common import written
from pyspark.sql import DataFrame, SparkSession


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the trees reject go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep(docs, quality.train(docs, labels))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return partenum.one_of_each(docs, n=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secrets.redact(docs, secrets.train(secrets.samples(docs)))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least, those of small sources up to twice, so that weights come nearer to the target entropy."""
    return mixing.draw(docs, target_entropy=0.97, most_epochs=2.0, budget=None)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of them and of what they decode to."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("secret scan", secret_scan),
    ("source mixing", source_mixing),
    ("byte-level BPE", byte_bpe),
]
#: SQL can't express the trees, nor the merges; tests hold run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is kept as a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, "stage")
    return docs
