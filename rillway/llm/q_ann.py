"""op7: the 20 nearest embeddings of every embedding whose vec_id is divisible by 20."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillway.llm import graph_ann
from rillway.llm.common import table


def op7_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_ann.search(table(spark, sf_dir, "embeddings"), k=20, every=20)


QUERIES = {"op7_graph_ann": op7_graph_ann}
#: An approximate search has no SQL; tests measure recall against brute force.
ORACLE_SQL: dict[str, str] = {}
