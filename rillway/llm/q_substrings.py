"""op8: bytes of documents that repeated strings of 200 bytes cover are removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillway.llm import substrings
from rillway.llm.common import table


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


QUERIES = {"op8_substrings": op8_substrings}
#: Repeated strings at any place are beyond SQL; tests compare with a table of all strings.
ORACLE_SQL: dict[str, str] = {}
