"""The corpus pipeline: stages over ``documents``, each stored before the next one reads it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import bpe, decontamination, near_duplicates, quality_rules, secrets
from tabloom.session import drop_step, materialize, work_step

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
RANKS = "byte_bpe_multi_50k.tiktoken"
_begun: list[str] = []


def step(stage: Stage) -> Stage:
    """A stage that first deletes what earlier stages stored in between, as their results are stored by now.

    A stage whose documents are still computed from such files leaves them alone.
    """

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for name in _begun:
            drop_step(spark, name, unless_read_by=docs)
        _begun[:] = [*(n for n in _begun if n != stage.__name__), stage.__name__]
        with work_step(stage.__name__):
            return stage(spark, docs, sf_dir)

    return run_stage


@step
def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base and the certified rules keep."""
    return quality_rules.passing(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@step
def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of least id."""
    return near_duplicates.first_of_each(docs)


@step
def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@step
def masked_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced by a mark and ``n_chars`` counted anew."""
    masked = secrets.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


@step
def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token ids, with a digest of what the ids decode to."""
    rows = bpe.encode_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return rows.withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", good_documents),
    ("near_duplicates", distinct_documents),
    ("decontamination", clean_documents),
    ("secrets", masked_documents),
    ("byte_bpe", encoded_documents),
]
# Byte-pair merges and a trained field have no SQL form; tests/llm holds the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
