"""Corpus pipeline: five of the operators in a row, each stage on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
``documents``. ``run`` stores each stage's result as Parquet in the shared folder and reads it back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import byte_bpe, decontamination, secret_scan, simhash, toxicity
from quarry.llm.common import small_batches, stored, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    names = [f"c{i}" for i in range(len(docs.columns))]  # none that the score's columns replace
    scored = toxicity.score(docs.toDF(*names), model, names[docs.columns.index("text")])
    return scored.where(F.col("predicted") == 0).select(*names).toDF(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one of the least id."""
    small_batches(spark)
    return simhash.representatives(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts become [SECRET]; all documents stay, and n_chars follows the text."""
    return secret_scan.redact(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text: the documents' columns without the text, the ids and their digests."""
    small_batches(spark)
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return byte_bpe.round_trip(docs, ranks, pattern, ids=True).drop("text")


STAGES = [("toxicity", toxicity_stage), ("simhash", simhash_stage), ("decontamination", decontamination_stage),
          ("secrets", secret_stage), ("byte_bpe", bpe_stage)]

#: SQL can express neither the fitted scores nor the merges; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
