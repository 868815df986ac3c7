"""All queries of the engine, with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessellum.plans import answer, extraction, graph, relational, retrieval, stores, structure

FAMILIES = [structure, relational, retrieval, extraction, graph, answer, stores]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for family in FAMILIES for name, f in family.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best section for every query: recall, fusion and reranking in one plan."""
    return retrieval.lexical_rerank(spark, sf_dir)
