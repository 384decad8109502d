"""op1: the language of every document, learned from the documents that are not held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.llm import hyperlang
from rillway.llm.common import table


def op1_hyperlang(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out)
    prototypes = hyperlang.train(docs.filter("not held_out"))
    return hyperlang.predict(docs, prototypes, keep=["doc_id", "held_out"])


QUERIES = {"op1_hyperlang": op1_hyperlang}
#: Random vectors and cosines over letters are beyond SQL; tests measure held-out accuracy.
ORACLE_SQL: dict[str, str] = {}
