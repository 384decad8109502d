"""The corpus pipeline: documents in, token ids out.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written as Parquet and read again as the next one's docs.  Every stage but the last returns the
columns of documents (doc_id, text, lang, source, n_chars):

1. quality: documents that the base rules or the posterior of the weakly supervised rules reject go;
2. near_duplicates: of every class the document with the least doc_id stays;
3. secrets: spans of secrets in the text are replaced by `[secret]`, and n_chars follows; no document goes;
4. mixing: each leaf of the domain-language-source tree keeps a seeded prefix within its budget, one
   epoch at most, so that no document comes back as a copy;
5. bpe: token ids of every document, with their number and digests.

Defined cases: null, empty and very short texts go in the first stage; repeated rows and equal texts are one
document after the second; a null lang or source is a leaf of its own; columns besides those of documents are
dropped on entry, whatever their names; an empty table gives an empty one of the same columns at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.llm import bpe, mixing, neardup, quality, secrets
from rillway.llm.common import drop_materialized, materialize, table, written
from rillway.llm.q_bpe import vocabulary
from rillway.llm.q_mixing import SEED, WEIGHTS, levels

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Share of the tokens that the mixing stage may keep.  Close to what the weights can use of one
#: epoch: over-represented leaves are cut, others stay whole.
MIX_PERCENT = 90


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # written out, since a filter on counts would be pushed through, and multiply, their expressions
    counted = materialize(quality.counts(docs.select(COLUMNS)), "counted")
    return quality.judge(counted, quality.fit(counted)).filter("kept").select(COLUMNS)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicate(docs.select(COLUMNS))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_epochs(docs.select(COLUMNS), levels(), WEIGHTS, MIX_PERCENT, max_epochs=1, seed=SEED).select(COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(docs.select(COLUMNS), *vocabulary(), keep=("doc_id", "lang", "source"), ids=True)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: The stages estimate, draw signatures and merge tokens, which SQL can't express; tests compare run() with
#: plain Python on a small table with copies, secrets and junk.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = written()
        docs = materialize(stage(spark, docs, sf_dir), name)
        drop_materialized(before, but=1)  # what the stage wrote on its way
    return STAGES[-1][1](spark, docs, sf_dir)
