"""The corpus pipeline: language ID, exact dedup, near dedup, secret scan, packing.

Each stage works on all that its predecessor kept and returns the columns of documents, the last one the bins.
An empty table goes through all stages; NULL texts are rejected by the first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabulon.llm.base import documents, scratch
from tabulon.llm.exact_dedup import exact_dedup
from tabulon.llm.language_id import keep_languages
from tabulon.llm.near_dedup import drop_near_copies
from tabulon.llm.packing import best_fit_packing
from tabulon.llm.secret_scan import redact

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the languages go."""
    return keep_languages(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays, the one of the least doc_id."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the least doc_id."""
    return drop_near_copies(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, with their secrets masked."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document in bins of 2,048 words."""
    return best_fit_packing(docs)


STAGES: list[tuple[str, Stage]] = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("secret_scan", secrets), ("best_fit_packing", packing)]

#: The stages' models and signatures can't be put in SQL; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
