"""Near-duplicate classes: ProbMinHash signatures, banding, exact verification.

Texts become sets of shingles of five words.  ProbMinHash draws, for every shingle, the arrivals of
a Poisson process whose rate is the shingle's weight; an arrival goes to a random register, which
keeps its earliest.  A shingle is done once its next arrival is later than every register (early
termination).  Two registers agree with the probability Jaccard similarity of the weighted sets.
Every shingle of a text weighs the same here, however often it occurs, so that this is the Jaccard
similarity of the sets, by which pairs are accepted.

Bands of ROWS registers are hashed; texts that share a band are candidates.  Equal texts are one
node.  A pair becomes a link when the Jaccard similarity of its sets of shingles, computed exactly,
reaches the threshold.  Connected nodes form a class.  In a few bands every node is first compared
with its bucket's leader, which finds most links.  Then each bucket of all bands that still holds
several classes is settled: every pair of its nodes in different classes is compared, unless a
prefix filter (see settle) proves that it cannot reach the threshold.  Large buckets are cut into
parts, and every pair of parts is settled by itself, so that memory stays bounded.

With 32 bands of 4 registers a pair at similarity 0.8 shares no band with probability 5e-8.

Defined cases: texts of fewer than five words are one shingle of all their words; equal texts are
always one class, and null counts as the empty text; texts without a word link to nothing else; rows
with equal ids and texts are one document occurring twice; an empty table gives an empty result.  Words are what white space parts.  Null ids sort first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillway.llm.common import materialize

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
#: Documents and shingles that are drawn for together; bounds memory only.
GROUP, GROUP_SHINGLES = 512, 300_000
#: Entries of the cache of word hashes, emptied when full.
CACHE_WORDS = 300_000
NO_ID = -(2**63)
#: Rows up to which a table of pairs or labels is handled in one partition.
SMALL = 200_000
#: Bands in which nodes are compared with leaders first.
FIRST_BANDS = 4
#: Bytes of sets that make a part of a bucket, nodes up to which all pairs are tried without a
#: prefix filter, and candidates that the filter lists together; these bound memory only.
PART_BYTES, FEW, LISTED = 8_000_000, 8, 2_000_000

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Words(dict):
    def __missing__(self, word: str) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_words = _Words()


def shingles(text: str | None) -> np.ndarray:
    """Hashes of a text's shingles in order, with repeats."""
    words = text.split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(WORDS, len(ids))
    out = np.full(len(ids) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix(out + ids[i : i + len(out)] * _U(0x9E3779B97F4A7C15))
    return out


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """ProbMinHash: for each (shingles, weights), the shingle that arrives first in each register."""
    doc = np.repeat(np.arange(len(sets)), [len(s) for s, _ in sets])
    item = np.concatenate([s for s, _ in sets])
    rate = np.concatenate([w for _, w in sets]).astype(np.float64)
    first = np.full(len(sets) * registers, np.inf)
    winner = np.zeros(len(sets) * registers, np.uint64)
    time = np.zeros(len(item))
    step = 0
    while len(item):
        step += 1
        draw = mix(item + _U(step * 0x9E3779B97F4A7C15 % 2**64))
        time = time - np.log1p(-((draw >> _U(11)).astype(np.float64) * 2.0**-53)) / rate
        at = doc * registers + (mix(draw ^ _U(0xD6E8FEB86659FD93)) % _U(registers)).astype(np.int64)
        early = np.flatnonzero(time < first[at])
        order = early[np.argsort(-time[early], kind="stable")]  # the earliest is written last
        first[at[order]], winner[at[order]] = time[order], item[order]
        latest = first.reshape(len(sets), registers).max(axis=1)
        on = time < latest[doc]
        doc, item, rate, time = doc[on], item[on], rate[on], time[on]
    return winner.reshape(len(sets), registers)


def bands_of(signature: np.ndarray) -> np.ndarray:
    """Signed 64-bit hashes of the bands, each with the band's number in it."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    out = np.tile(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(signature), 1))
    for r in range(ROWS):
        out = mix(out * _U(0x9E3779B97F4A7C15) + parts[:, :, r])
    return out.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, node, check, text) -> (id, node, check, bands); no bands without words."""
    for b in batches:
        texts = b.column(3).to_pylist()
        bands: list = [None] * len(texts)
        waiting: list[int] = []
        sets: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for i, t in enumerate([*texts, None]):
            last = i == len(texts)
            if not last and len(s := shingles(t)):
                distinct = np.unique(s)
                sets.append((distinct, np.ones(len(distinct))))
                waiting.append(i)
                size += len(sets[-1][0])
            if sets and (last or len(sets) >= GROUP or size >= GROUP_SHINGLES):
                for k, row in zip(waiting, bands_of(signatures(sets, BANDS * ROWS)), strict=True):
                    bands[k] = row
                waiting, sets, size = [], [], 0
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(bands, pa.list_(pa.int64()))], names=["id", "node", "check", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) -> (node, set: sorted distinct shingles as bytes)."""
    for b in batches:
        for lo in range(0, b.num_rows, 500):
            part = b.slice(lo, 500)
            sets = [np.unique(shingles(t)).tobytes() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["node", "set"])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    common = len(a) + len(b) - len(np.union1d(a, b))
    return common / (len(a) + len(b) - common)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, set_a, set_b) -> (a, b) of those that reach the threshold."""
    for b in batches:
        for lo in range(0, b.num_rows, 500):
            part = b.slice(lo, 500)
            ok = []
            for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                ok.append(_reaches(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(0).filter(mask), part.column(1).filter(mask)], names=["a", "b"])


def _reaches(x: np.ndarray, y: np.ndarray) -> bool:
    short, long = sorted((len(x), len(y)))
    return short >= THRESHOLD * long and jaccard(x, y) >= THRESHOLD


def _candidates(sets: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (x, y) of all pairs that can reach the threshold; sets in order of their sizes.

    Shingles are ordered from rare to frequent.  A set and a smaller one reach the threshold t only
    with (size + size of the smaller) t / (1 + t) shingles in common, so their first ones share one:
    of the larger set all but t size, of the smaller all but 2 t / (1 + t) size, and one more.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    m, owner = len(sets), np.repeat(np.arange(len(sets)), size)
    _, item, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    order = np.lexsort((rank[item], owner))
    rare, shared = rank[item][order], often[item][order] > 1
    place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    least = lambda share: np.ceil(share * size - 1e-9).astype(np.int64)
    probe = shared & (place <= (size - least(THRESHOLD))[owner])
    index = shared & (place <= (size - least(2 * THRESHOLD / (1 + THRESHOLD)))[owner])
    listed = np.sort(rare[index] * m + owner[index])
    x, key = owner[probe], rare[probe] * m
    lo = np.searchsorted(listed, key + np.searchsorted(size, least(THRESHOLD))[x])
    n = np.maximum(np.searchsorted(listed, key + x) - lo, 0)
    ends = np.cumsum(n)
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - n[at] + LISTED, side="right")))
        many = n[at:to]
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        pairs = np.unique(np.repeat(x[at:to], many) * m + listed[np.repeat(lo[at:to], many) + step] % m)
        yield pairs // m, pairs % m
        at = to


def settle(label: np.ndarray, part: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join all classes of a bucket that any link joins: every pair with different labels
    (and parts, where there are two) is compared, unless links already connect it or it cannot reach
    the threshold."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    ordered = [sets[i] for i in order]
    group, part = np.unique(label, return_inverse=True)[1][order], part[order]
    across = part.min() != part.max()
    m = len(sets)
    lists = [np.triu_indices(m, 1)] if m <= FEW else _candidates(ordered)
    found = []
    for x, y in lists:
        if across:
            other = part[x] != part[y]
            x, y = x[other], y[other]
        for at in range(0, len(x), 10_000):
            i, j = x[at : at + 10_000], y[at : at + 10_000]
            apart = group[i] != group[j]
            for k, l in zip(i[apart].tolist(), j[apart].tolist(), strict=True):
                if group[k] != group[l] and _reaches(ordered[k], ordered[l]):
                    found.append((int(order[k]), int(order[l])))
                    group[group == group[k]] = group[l]
    return found


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, lo, hi, part, node, label, set), equal (band, lo, hi) in a row -> links (a, b)."""

    def groups() -> Iterator[list[tuple]]:
        held, key = [], None
        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(6)]
            for i, (band, lo, hi, *row) in enumerate(zip(*columns, strict=True)):
                if (band, lo, hi) != key:
                    if held:
                        yield held
                    held, key = [], (band, lo, hi)
                held.append((*row, np.frombuffer(b.column(6)[i].as_py(), np.uint64)))
        if held:
            yield held

    for rows in groups():
        part, node, label, sets = zip(*rows, strict=True)
        links = settle(np.array(label), np.array(part), list(sets))
        if links:
            ends = [pa.array([node[link[k]] for link in links], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(ends, names=["a", "b"])


def _compact(df: DataFrame) -> tuple[DataFrame, bool]:
    """A written table in one partition if it has SMALL rows at most, and whether it has: then joins and
    sums over it need no exchange."""
    small = df.limit(SMALL + 1).count() <= SMALL
    return (df.coalesce(1) if small else df), small


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of (a, b): the least node that it is connected with.

    Labels spread along the edges and jump to their label's label; every round is written out.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    both, small = _compact(both)
    one = lambda d: d.coalesce(1) if small else d
    labels = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        labels = one(labels)
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("further"))
        new = new.join(jump, "new").select("node", "label", F.least("new", "further").alias("new"))
        new = materialize(new, "labels")
        changed = new.filter("label != new").limit(1).count()
        labels = new.select("node", F.col("new").alias("label"))
        if not changed:
            return labels


def _nodes(df: DataFrame, id_col: str, text: str, seed: int) -> DataFrame:
    """id, node and check (two hashes of the text) and text of every row."""
    t = F.coalesce(df[text], F.lit(""))
    return df.select(df[id_col].cast("long").alias("id"), F.xxhash64(F.lit(seed), t).alias("node"), F.xxhash64(F.lit(-1 - seed), t).alias("check"), t.alias("text"))


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that reach the threshold."""
    found = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    return found.select("a", "b", "set_a", "set_b").mapInArrow(_verify, "a bigint, b bigint")


def _open(named: DataFrame, sets: DataFrame) -> DataFrame:
    """(band, node, label) -> (band, lo, hi, part, node, label): the bands with several labels, by
    pairs lo <= hi of their parts.  Of bands with the same nodes one stays."""
    sized = named.join(sets.select("node", "bytes"), "node")
    same = [F.count("*").alias("n"), F.min("node").alias("n0"), F.max("node").alias("n1"), *[F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"x{i}") for i in (0, 1)]]
    bands = sized.groupBy("band").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.sum("bytes").alias("bytes"), *same).filter("l0 != l1")
    bands = bands.groupBy("n", "n0", "n1", "x0", "x1").agg(F.min("band").alias("band"), F.max(F.ceil(F.col("bytes") / PART_BYTES)).cast("int").alias("parts"))
    open_ = named.join(bands.select("band", "parts"), "band").withColumn("part", F.pmod(F.xxhash64(F.lit(2), "node"), "parts").cast("int"))
    open_ = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return materialize(open_.select("band", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "node", "label"), "open")


def classes(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, int]:
    """rows (id, node), node classes (node, class_id, class_node), and the seed of the node hashes.

    class_id is the least id of the class.
    """
    seed = 0
    while True:
        rows = materialize(_nodes(df, id_col, text, seed).mapInArrow(_sign, "id bigint, node bigint, check bigint, bands array<bigint>"), "signatures")
        nodes = rows.groupBy("node").agg(F.min(F.coalesce("id", F.lit(NO_ID))).alias("least"), F.min("check").alias("c0"), F.max("check").alias("c1"))
        nodes = materialize(nodes, "nodes")
        if not nodes.filter("c0 != c1").limit(1).count():
            break
        seed += 1  # two texts with one hash: take another hash
    banded = rows.filter("bands is not null").select("node", F.posexplode("bands").alias("place", "band")).distinct()
    leaders = banded.groupBy("band").agg(F.min("node").alias("leader"), F.count("*").alias("n")).filter("n > 1").select("band", "leader")
    buckets = materialize(banded.join(leaders, "band"), "buckets")
    # the first bands find most links; the others only have to look across the classes these make
    pairs = materialize(buckets.filter(f"node != leader and place < {FIRST_BANDS}").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    # every node that shares a bucket may have to be compared
    members = buckets.select("node").distinct().join(nodes.select("node", "least"), "node")
    texts = _nodes(df, id_col, text, seed).withColumn("least", F.coalesce("id", F.lit(NO_ID)))
    sets = materialize(texts.join(members, ["node", "least"], "left_semi").select("node", "text").mapInArrow(_sets, "node bigint, set binary").dropDuplicates(["node"]).withColumn("bytes", F.octet_length("set")), "sets")
    labels = _compact(components(_linked(pairs, sets)))[0]
    open_ = _open(buckets.select("band", "node").join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label")), sets)
    met = open_.join(sets.select("node", "set"), "node").select("band", "lo", "hi", "part", "node", "label", "set")
    met = met.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi", "node")
    links = _compact(materialize(met.mapInArrow(_settle, "a bigint, b bigint").distinct(), "links"))[0]
    # links join classes: a graph of classes, and new labels for the nodes of joined ones
    label_of = lambda n: labels.select(F.col("node").alias(n), F.col("label").alias(f"l{n}"))
    ends = links.join(label_of("a"), "a", "left").join(label_of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    merged = components(ends).select(F.col("node").alias("label"), F.col("label").alias("new"))
    labels = labels.union(links.select("a", "a").union(links.select("b", "b"))).groupBy("node").agg(F.min("label").alias("label"))
    labels = materialize(labels.join(merged, "label", "left").select("node", F.coalesce("new", "label").alias("label")), "labels")
    joined = nodes.join(labels, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label"))
    of_class = joined.groupBy("label").agg(F.min(F.struct("least", "node")).alias("first"))
    joined = joined.join(of_class, "label").select("node", F.nullif(F.col("first.least"), F.lit(NO_ID)).alias("class_id"), F.col("first.node").alias("class_node"))
    return rows.select("id", "node"), materialize(joined, "classes"), seed


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, class_id (least id of the class) and kept (the row is the one of its class that stays; a
    repeated row counts once more) of every row."""
    rows, found, _ = classes(df, id_col, text)
    kept = F.col("id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("class_node"))
    return rows.join(found, "node").select(F.col("id").alias(id_col), "class_id", kept.alias("kept"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one row of each class: that with the least id."""
    _, found, seed = classes(df, id_col, text)
    firsts = found.filter("node = class_node").select(F.col("node").alias("__node"), F.coalesce("class_id", F.lit(NO_ID)).alias("__id"))
    t = F.coalesce(F.col(text), F.lit(""))
    keyed = df.withColumn("__node", F.xxhash64(F.lit(seed), t)).withColumn("__id", F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)))
    return keyed.join(firsts, ["__node", "__id"], "left_semi").dropDuplicates(["__node", "__id"]).select(*df.columns)
