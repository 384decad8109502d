"""The pipeline's stages on a small table, each judged on what it got."""

import os
import random

import duckdb
import pyarrow as pa
import pytest
from plain import digest, plain_quality, plain_redacted, tiktoken_encoding
from test_operators import brute_classes

import corpus_pipeline
from rillway.llm import quality
from rillway.llm.common import materialize
from rillway.llm.q_mixing import sql

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, SF), name)
        assert name == "bpe" or docs.columns == corpus_pipeline.COLUMNS
        ids.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        assert docs.count() == len(ids[-1]) and docs.count() > 0
        assert ids[-1] <= {r["doc_id"] for r in before.select("doc_id").collect()}
    quality, near, secrets, mixing, bpe = ids
    assert secrets == near and bpe == mixing and mixing < secrets
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()) == sorted(bpe)


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.count() == 0


def test_like_a_plain_version(spark, tmp_path):
    """run() on documents, copies, near copies, secrets, junk and empty texts against plain Python, stage by stage."""
    rng = random.Random(9)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS).collect()]
    long = [r for r in rows if r[1] and len(r[1].split()) > 150]
    made = [r[1] for r in long[:10]]
    for r in long[10:30]:
        words = r[1].split(" ")
        words[rng.randrange(len(words))] = "changed"
        made.append(" ".join(words))
    shuffled = lambda text: " ".join(rng.sample(text.split(), len(text.split())))
    made += [f"{shuffled(r[1])}. Then.\ntoken = abcdefgh{i}12345678 and AKIAABCDEFGHIJKLMN{i}P {'0123456789abcdef' * 2}" for i, r in enumerate(long[30:36])]
    made += [None, "", " ", "few words", "spam " * 400, " ".join("w###" for _ in range(200))]
    rows += [(10**6 + i, t, rng.choice(["en", None]), rng.choice(["src0", "src12", None]), len(t or "")) for i, t in enumerate(made)]
    spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS).schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    kept = sorted((r for r, good in zip(rows, plain_quality([r[1] for r in rows], quality.STARTS), strict=True) if good), key=lambda r: r[0])
    first = [r for i, (r, c) in enumerate(zip(kept, brute_classes([r[1] for r in kept]), strict=True)) if c == i]
    assert len(rows) > len(kept) > len(first)
    clean = [(r[0], plain_redacted(r[1]), *r[2:4]) for r in first]
    assert sum("[secret]" in r[1] for r in clean) >= 6
    duck = duckdb.connect()
    duck.register("documents", pa.table(dict(zip(("doc_id", "text", "lang", "source"), map(list, zip(*clean, strict=True)), strict=True))))
    mixed = set(duck.sql(sql(corpus_pipeline.MIX_PERCENT, 1)).df()["doc_id"])
    encoding, want = tiktoken_encoding(), {}
    for i, text, *_ in clean:
        if i in mixed:
            ids = encoding.encode_ordinary(text)
            want[i] = len(ids), digest(" ".join(map(str, ids))), digest(text)
    assert got == want and len(want) < len(clean)
