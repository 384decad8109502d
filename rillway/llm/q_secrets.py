"""op3: secrets in every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.llm import secrets
from rillway.llm.common import materialize, table


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = materialize(secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "scanned")
    scored = materialize(secrets.score(scanned, secrets.text_model(scanned)), "scored")
    every = secrets.spans(secrets.thresholds(scored))
    return scored.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"), secrets.listed(every).alias("spans"))


QUERIES = {"op3_secrets": op3_secrets}
#: Non-overlapping matches with their places are beyond DuckDB's regular expressions; tests compare with plain Python.
ORACLE_SQL: dict[str, str] = {}
