"""A training-data pipeline over ``documents``: each stage works on all that the one before kept.

Quality classifier, near-dedup, benchmark decontamination, mixing to source weights, token files.
Every stage's rows are written to the shared folder and read again, so a lost executor repeats one
stage at most. SQL can express neither the classifier nor the mixing's draws, so there is no SQL.

Defined cases: each stage treats nulls, empty and very long texts, ties, repeated rows and extra
columns as its operator says, and keeps the columns of its input; null and empty texts are judged
like any other text by the classifier, are linked with nothing, hold no passage, and are taken no
times by the mix, so no tokens are written for them; rows that repeat a doc_id and a text stay once
after near-dedup; labels without a quality are ignored, and without labels all documents pass the
classifier; without a benchmark nothing is taken out; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netquarry.llm.common import written
from netquarry.llm.decontaminate import decontaminate
from netquarry.llm.mixing import apply_mix
from netquarry.llm.near_dedup import keep_one
from netquarry.llm.quality import filter_quality, fit
from netquarry.llm.token_parquet import token_digests


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labels of ``docs`` that are not held out."""
    return filter_quality(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays."""
    return keep_one(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it."""
    return apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and from them doc_id, start, n_tokens, ids_crc32."""
    return token_digests(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", leaks), ("mix", mix), ("tokens", tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
