"""op2: byte-level BPE encoding and decoding of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillway.llm import bpe
from rillway.llm.common import table


def vocabulary() -> tuple[str, str]:
    """Path of the vocabulary file (same ranks as byte_bpe_50k.tiktoken) and its pre-token pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip_digests(docs, *vocabulary())


QUERIES = {"op2_bpe": op2_bpe}
#: The merges of BPE are a loop over a text's symbols; tests compare with the tiktoken library.
ORACLE_SQL: dict[str, str] = {}
