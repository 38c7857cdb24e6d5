"""Queries and SQL of the training-data operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siteloom.llm import abuse, addresses, bpe, encoding, leaks, lookalikes, names, places, residue, survivors

MODULES = (survivors, encoding, places, lookalikes, names, addresses, residue, bpe, leaks, abuse)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
