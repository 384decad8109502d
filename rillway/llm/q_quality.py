"""op9: word and line counts of every document, and the verdict of the weakly supervised rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillway.llm import quality
from rillway.llm.common import materialize, table


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = materialize(quality.counts(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "counts")
    return quality.judge(counted, quality.fit(counted))


QUERIES = {"op9_quality": op9_quality}
#: The estimation is a loop; tests compare the counts and the verdicts with plain Python.
ORACLE_SQL: dict[str, str] = {}
