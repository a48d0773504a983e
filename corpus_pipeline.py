"""The corpus pipeline: five stages over documents, each written as Parquet and reread for the next.

All stages but the last return the columns that they are given, whatever their names, and keep repeated rows, rows with
a null id and rows with null or empty text but for what the stage is there to drop: a text without words is no near
copy, is not contaminated and holds no secret. An empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrifold.llm.bpe import encode
from metrifold.llm.common import free_name, table, written
from metrifold.llm.decontaminate import remove_contaminated
from metrifold.llm.near_dedup import near_duplicates
from metrifold.llm.quality import classify
from metrifold.llm.secrets import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts; all where the labels are of one kind only. Null text is scored as empty."""
    accepted = free_name(docs.columns, "accepted")
    return classify(docs, table(spark, sf_dir, "labels"), accepted=accepted).where(F.col(accepted)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: five-word shingles, similarity 0.8; the least id stays, with all its rows."""
    gone = near_duplicates(docs, k=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items do not contaminate, as they are; each row is judged by its own text."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"), n=13)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found secrets replaced by a mark and n_chars of those texts set anew."""
    return redact_secrets(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with their digests; null and empty texts have none."""
    return encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=True)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("tokens", tokens)]

#: The trained classifier can't be stated in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
