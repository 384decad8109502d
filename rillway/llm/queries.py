"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules that each hold QUERIES and ORACLE_SQL.
MODULES = ["q_bpe", "q_sharding", "q_quality", "q_hyperlang", "q_secrets", "q_html", "q_mixing", "q_neardup", "q_ann", "q_substrings"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in import_module(f"rillway.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"rillway.llm.{m}").ORACLE_SQL.items()}
