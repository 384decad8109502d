"""op10: near-duplicate classes of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillway.llm import neardup
from rillway.llm.common import table


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op10_neardup": op10_neardup}
#: Signatures and components are beyond SQL; tests compare with all pairs on small tables.
ORACLE_SQL: dict[str, str] = {}
