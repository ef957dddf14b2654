"""Registered queries of the library and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marginalia.plans import answers, construction, corpus, intake, knowledge, relational, sinks, streams

MODULES: list = [relational, corpus, knowledge, streams, intake, sinks, answers, construction]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents answer the benchmark questions."""
    return corpus.document_questions(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
