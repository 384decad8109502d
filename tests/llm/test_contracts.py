"""The registered queries on whole small tables, against plain versions."""

import os
import zlib
from collections import Counter, defaultdict

import pytest
from plain import digest, plain_base_failed, plain_quality, plain_secrets, tiktoken_encoding
from test_operators import brute_classes, plain_counts

from rillway.llm import quality
from rillway.llm.queries import queries

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def result(spark, name, sf=SMALL):
    return queries()[name](spark, sf).collect()


@pytest.fixture(scope="module")
def documents(spark):
    return {sf: {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()} for sf in (SMALL, LARGER)}


def test_op1_held_out_accuracy(spark, documents):
    docs, got = documents[LARGER], result(spark, "op1_hyperlang", LARGER)
    assert {r["doc_id"] for r in got} == set(docs) and len(got) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"] and docs[r["doc_id"]]["lang"] is not None]
    assert held and sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_op2_digests(spark, documents):
    own = tiktoken_encoding()
    for r in result(spark, "op2_bpe"):
        text = documents[SMALL][r["doc_id"]]["text"] or ""
        ids = own.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), digest(" ".join(map(str, ids))), digest(text))


def test_op3_digests(spark, documents):
    got = result(spark, "op3_secrets", LARGER)
    assert len(got) == len(documents[LARGER])
    for r in got:
        found = plain_secrets(documents[LARGER][r["doc_id"]]["text"])
        listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in found)
        kinds = Counter(k for _, k, _ in found)
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == (kinds[0], kinds[1], kinds[2], digest(listed))
        assert set(filter(None, listed.split(","))) <= set(r["spans"].split(","))


def test_op6_law(spark, documents):
    docs, got = documents[LARGER], result(spark, "op6_sharding", LARGER)
    assert Counter(r["doc_id"] for r in got) == Counter(docs.keys()) and {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}
    raw = {i: (d["text"] or "").encode() for i, d in docs.items()}
    sums, slots, homes, groups = Counter(), defaultdict(list), defaultdict(set), Counter()
    for r in got:
        data = raw[r["doc_id"]]
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
        sums[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        homes[data].add(r["shard"])
        groups[data] += r["size"]
    assert set(sums) <= set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in homes.values())
    assert max(sums.values()) <= sum(sums.values()) / 16 + max(groups.values())


def test_op9_verdicts_and_labels(spark, documents):
    docs = documents[LARGER]
    got = {r["doc_id"]: r for r in result(spark, "op9_quality", LARGER)}
    ids = sorted(docs)
    for i, kept in zip(ids, plain_quality([docs[i]["text"] for i in ids], quality.STARTS), strict=True):
        r = got[i]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == plain_counts(docs[i]["text"])
        assert (r["base_failed"], r["kept"]) == (plain_base_failed(docs[i]["text"]), kept)


def test_op10_classes(spark, documents):
    docs = documents[SMALL]
    ids = sorted(docs)
    of = brute_classes([docs[i]["text"] for i in ids])
    got = {r["doc_id"]: r["class_id"] for r in result(spark, "op10_neardup")}
    assert got == {i: ids[c] for i, c in zip(ids, of, strict=True)}
