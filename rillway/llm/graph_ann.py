"""Approximate nearest neighbours by largest inner product, on robust-pruned directed graphs.

Distinct vectors go to the shard of their nearest centre, and every shard gets a graph of its own, once.
Vectors are inserted in batches: a greedy beam search from the shard's medoid proposes neighbours for
each, and robust pruning keeps a candidate only if no kept one is nearer to it by the factor ALPHA than
the inserted vector, which leaves few but diverse edges; edges are also entered backwards, and lists
that grow too long are pruned again.  A query runs a beam search in each of the shards whose centres are
nearest to it; what they return is scored exactly, in double precision on the original vectors, and merged.

How many shards a query visits is measured and not set: for SAMPLE_QUERIES queries the nearest rows are
found among all vectors, block by block, and all queries visit as many shards as hold the share COVERAGE of
those.  Centres are fitted on at most SAMPLE_NUMBERS numbers of vectors chosen by their hash; every vector
is indexed.  There are as many centres as shards of SHARD_VECTORS vectors, up to MAX_CENTRES; from there
on shards grow with the table.  A shard that gets more than twice its share is dealt to several by hash,
and queries that meet in one shard are dealt to parts, which read the same graph.  So the rows that move
grow with the table, unless vectors have no neighbourhoods at all and every shard must be visited.

Largest inner product becomes nearest distance by one more coordinate, sqrt(M**2 - |x|**2) with the
largest norm M of all vectors (0 for a query).

Equal vectors are one node.  A node carries its K + 1 smallest ids, which is all that K results
without the query's own row can use, so that a vector with very many rows costs as much as any other.

Defined cases: vectors that are null, zero, or hold a null or non-finite component take no part, nor
do rows with a null id; vectors of another length than the query's are no candidates; ties go to the
smaller id; a row with an id that occurs again is no candidate for that id; fewer candidates than K
give fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from rillway.llm.common import materialize

DEGREE, BEAM, ALPHA = 32, 64, 1.2
SEARCH_BEAM = 128
#: Nodes that are expanded at once in a step of the beam search, for every query.
EXPAND = 4
#: Distinct vectors of a shard, about; queries that one task searches for, about.
SHARD_VECTORS, PART_QUERIES = 8192, 16_384
#: Bounds of what the driver holds to route: centres, and numbers of the vectors they are fitted on.
MAX_CENTRES, SAMPLE_NUMBERS, FIT_ROUNDS = 1024, 4_000_000, 8
#: Queries for which the nearest are found exactly, and the share of those that the visited shards must hold.
SAMPLE_QUERIES, COVERAGE = 64, 0.98
SALTS = 64


def _distances(points: np.ndarray, norms: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances of queries to the points ids (one row of ids each), without the query's own norm."""
    return norms[ids] - 2 * np.matmul(points[ids], queries[:, :, None])[:, :, 0]


def beam_search(points: np.ndarray, norms: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the beam at the end, for all queries in step; -1 where it is not full.

    graph: rows of neighbours, padded with -1."""
    n, m = len(points), len(queries)
    ids = np.full((m, beam), -1)
    dist = np.full((m, beam), np.inf, np.float32)
    open_ = np.zeros((m, beam), bool)
    seen = np.zeros((m, n + 1), bool)  # the last column takes the padding
    seen[:, n] = True
    ids[:, 0], open_[:, 0], seen[:, entry] = entry, True, True
    dist[:, 0] = _distances(points, norms, ids[:, :1], queries)[:, 0]
    going = np.arange(m)
    while len(going):
        waiting = np.where(open_[going], dist[going], np.inf)
        pick = np.argpartition(waiting, EXPAND, axis=1)[:, :EXPAND]
        live = np.isfinite(np.take_along_axis(waiting, pick, 1))
        open_[going[:, None], pick] = False
        near = np.where(live[:, :, None], graph[np.where(live, ids[going[:, None], pick], 0)], -1).reshape(len(going), -1)
        near = np.sort(near, axis=1)
        fresh = (near >= 0) & ~seen[going[:, None], near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        width = int(fresh.sum(1).max(initial=0))
        if width:
            front = np.argsort(~fresh, axis=1, kind="stable")[:, :width]
            near = np.where(np.take_along_axis(fresh, front, 1), np.take_along_axis(near, front, 1), -1)
            seen[going[:, None], near] = True
            far = np.where(near >= 0, _distances(points, norms, near, queries[going]), np.inf).astype(np.float32)
            all_d = np.concatenate([dist[going], far], 1)
            best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
            dist[going] = np.take_along_axis(all_d, best, 1)
            ids[going] = np.take_along_axis(np.concatenate([ids[going], near], 1), best, 1)
            open_[going] = np.take_along_axis(np.concatenate([open_[going], near >= 0], 1), best, 1)
        going = going[(open_[going] & np.isfinite(dist[going])).any(1)]
    ids[~np.isfinite(dist)] = -1
    return ids, dist


def robust_prune(points: np.ndarray, own: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """DEGREE neighbours at most for each point of own, out of its row of candidates (-1: none)."""
    candidates = np.sort(candidates, axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    candidates[candidates == own[:, None]] = -1
    there = candidates >= 0
    vectors = points[candidates]
    diff = vectors - points[own][:, None, :]
    to_own = np.where(there, np.einsum("bcd,bcd->bc", diff, diff), np.inf)
    order = np.argsort(to_own, axis=1)
    candidates, to_own = np.take_along_axis(candidates, order, 1), np.take_along_axis(to_own, order, 1)
    vectors = np.take_along_axis(vectors, order[:, :, None], 1)
    squares = np.einsum("bcd,bcd->bc", vectors, vectors)
    among = np.maximum(squares[:, :, None] + squares[:, None, :] - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1)), 0)
    alive, rows = np.isfinite(to_own), np.arange(len(own))
    out = np.full((len(own), DEGREE), -1)
    for k in range(DEGREE):
        first = alive.argmax(1)
        some = alive[rows, first]
        if not some.any():
            break
        out[some, k] = candidates[rows, first][some]
        # distances are squared, and so is the factor
        alive &= ~((ALPHA * ALPHA * among[rows, first] <= to_own) & some[:, None])
        alive[rows, first] = False
    return out


def build(points: np.ndarray, seed: int = 7) -> tuple[np.ndarray, int]:
    """Graph and entry point of a shard."""
    n = len(points)
    norms = np.einsum("nd,nd->n", points, points)
    entry = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    graph = np.full((n, DEGREE), -1)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    done = 1
    while done < n:
        batch = order[done : done + min(max(1, done), 256)]
        found, _ = beam_search(points, norms, graph, entry, points[batch], BEAM)
        # later points of a batch don't see each other, but are linked by the backward edges' targets
        graph[batch] = robust_prune(points, batch, np.concatenate([found, graph[batch]], 1))
        targets = graph[batch]
        source = np.repeat(batch, DEGREE)[targets.ravel() >= 0]
        target = targets.ravel()[targets.ravel() >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, start, count = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(start, count)
        lists = np.full((len(nodes), DEGREE + int(count.max(initial=0))), -1)
        lists[:, :DEGREE] = graph[nodes]
        lists[np.repeat(np.arange(len(nodes)), count), DEGREE + place] = source
        over = (lists >= 0).sum(1) > DEGREE
        fit = -np.sort(-lists[~over], axis=1)[:, :DEGREE]
        graph[nodes[~over]] = fit
        for lo in range(0, int(over.sum()), 512):
            at = nodes[over][lo : lo + 512]
            graph[at] = robust_prune(points, at, lists[over][lo : lo + 512])
        done += len(batch)
    return graph, entry


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def lift(base: np.ndarray, bound: float) -> np.ndarray:
    """Unit vectors whose distances order as inner products do; bound: the largest square of a norm."""
    extra = np.sqrt(np.maximum(bound - (base * base).sum(1), 0))
    # the scale keeps single precision in range
    return (np.concatenate([base, extra[:, None]], 1) / max(bound, 1e-300) ** 0.5).astype(np.float32)


def flat(queries: np.ndarray) -> np.ndarray:
    """Queries as unit vectors of the lifted space."""
    sized = queries / np.linalg.norm(queries, axis=1)[:, None]
    return np.concatenate([sized, np.zeros((len(queries), 1))], 1).astype(np.float32)


def fit_centres(lifted: np.ndarray, count: int, seed: int = 3) -> np.ndarray:
    """Unit centres by spherical k-means."""
    rng = np.random.default_rng(seed)
    centres = lifted[rng.permutation(len(lifted))[:count]]
    for _ in range(FIT_ROUNDS):
        own = np.concatenate([(lifted[lo : lo + 4096] @ centres.T).argmax(1) for lo in range(0, len(lifted), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, lifted)
        size = np.linalg.norm(sums, axis=1)
        centres = np.where((size > 0)[:, None], sums / np.maximum(size, 1e-30)[:, None], centres).astype(np.float32)
    return centres


class Router:
    """Centres by length of vectors; a length without centres has one shard."""

    def __init__(self, centres: dict[int, np.ndarray], bound: float):
        self.centres, self.bound = centres, bound

    def shard(self, dim: int, base: np.ndarray) -> np.ndarray:
        if dim not in self.centres:
            return np.zeros(len(base), np.int64)
        return (lift(base, self.bound) @ self.centres[dim].T).argmax(1)

    def visits(self, dim: int, queries: np.ndarray, many: int) -> np.ndarray:
        """The many nearest shards of each query, nearest first."""
        if dim not in self.centres:
            return np.zeros((len(queries), 1), np.int64)
        return np.argsort(-(flat(queries) @ self.centres[dim].T), axis=1, kind="stable")[:, :many]

    @classmethod
    def fit(cls, nodes: DataFrame, n: int, longest: int, bound: float) -> "Router":
        count = min(MAX_CENTRES, -(-n // SHARD_VECTORS))
        if count < 2:
            return cls({}, bound)
        wanted = max(count, min(32 * count, SAMPLE_NUMBERS // longest))
        sample: dict[int, list] = {}
        for dim, v in nodes.filter(F.pmod("key.a", F.lit(max(1, n // wanted))) == 0).select("dim", "v").collect():
            sample.setdefault(dim, []).append(v)
        total = sum(map(len, sample.values()))
        shares = {dim: min(len(vs), round(count * len(vs) / total)) for dim, vs in sample.items()}
        return cls({dim: fit_centres(lift(np.array(sample[dim]), bound), c) for dim, c in shares.items() if c > 1}, bound)


def _by_dim(b: pa.RecordBatch, dim: str = "dim", v: str = "v") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, rows and matrix of the vectors of each length in a batch."""
    dims = b.column(dim).to_numpy()
    for d in np.unique(dims).tolist():
        at = np.flatnonzero(dims == d)
        yield d, at, _matrix(b.column(v).take(pa.array(at)))


def _routed(nodes: DataFrame, router: Router) -> DataFrame:
    """nodes with shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard = np.zeros(b.num_rows, np.int64)
            for dim, at, base in _by_dim(b):
                for lo in range(0, len(at), 4096):
                    shard[at[lo : lo + 4096]] = router.shard(dim, base[lo : lo + 4096])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard)], names=[*b.schema.names, "shard"])

    return nodes.mapInArrow(run, StructType([*nodes.schema, StructField("shard", LongType())]))


def _visited(queries: DataFrame, router: Router, many: int) -> DataFrame:
    """A row for each query and shard that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists: list = [None] * b.num_rows
            for dim, at, asked in _by_dim(b):
                for lo in range(0, len(at), 4096):
                    for i, row in zip(at[lo : lo + 4096].tolist(), router.visits(dim, asked[lo : lo + 4096], many)):
                        lists[i] = row
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists, pa.list_(pa.int64()))], names=[*b.schema.names, "shards"])

    out = queries.mapInArrow(run, StructType([*queries.schema, StructField("shards", ArrayType(LongType()))]))
    return out.withColumn("shard", F.explode("shards")).drop("shards")


def _measured(nodes: DataFrame, queries: DataFrame, router: Router, k: int) -> int:
    """How many shards a query must visit for COVERAGE of the nearest, which are found among all nodes
    for SAMPLE_QUERIES of the queries."""
    sample = queries.orderBy("key").limit(SAMPLE_QUERIES).select("key.a", "key.b", "dim", "v").collect()
    most = max(len(c) for c in router.centres.values())
    asked: dict[int, list[int]] = {}
    for i, q in enumerate(sample):
        asked.setdefault(q["dim"], []).append(i)
    matrix = {dim: np.array([sample[i]["v"] for i in own]) for dim, own in asked.items()}
    order = {dim: router.visits(dim, m, most) for dim, m in matrix.items()}
    own_key = [(q["a"], q["b"]) for q in sample]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            key = b.column("key")
            a, c, shards = key.field(0).to_numpy(), key.field(1).to_numpy(), b.column("shard").to_numpy()
            for dim, at, base in _by_dim(b):
                for j, i in enumerate(asked.get(dim, [])):
                    score = base @ matrix[dim][j]
                    score[(a[at] == own_key[i][0]) & (c[at] == own_key[i][1])] = -np.inf
                    old = best.get(i, (np.zeros(0), np.zeros(0, np.int64)))
                    score, place = np.concatenate([old[0], score]), np.concatenate([old[1], shards[at]])
                    top = np.argsort(-score, kind="stable")[:k]
                    best[i] = score[top], place[top]
        found = [(i, s, p) for i, (ss, ps) in best.items() for s, p in zip(ss.tolist(), ps.tolist()) if s > -np.inf]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], t) for j, t in enumerate((pa.int32(), pa.float64(), pa.int64()))], names=["q", "score", "shard"])

    found = nodes.select("key", "dim", "v", "shard").mapInArrow(run, "q int, score double, shard bigint")
    nearest = Window.partitionBy("q").orderBy(F.desc("score"), "shard")
    rows = found.withColumn("r", F.row_number().over(nearest)).filter(F.col("r") <= k).select("q", "shard").collect()
    place = {i: {s: r for r, s in enumerate(order[dim][j].tolist())} for dim, own in asked.items() for j, i in enumerate(own)}
    ranks = sorted(place[r["q"]].get(r["shard"], 0) for r in rows)
    return 1 + ranks[max(0, int(np.ceil(COVERAGE * len(ranks))) - 1)] if ranks else 1


_GRAPH = "dim int, shard bigint, sub int, entry int, graph binary, base binary, sizes binary, ids binary"


def _graphs(bound: float):
    def run(points: pa.Table) -> pa.Table:
        """The vectors of a shard -> one row with its graph."""
        base = _matrix(points.column("v")).astype(np.float64)
        graph, entry = build(lift(base, bound))
        ids = points.column("ids").combine_chunks()
        sizes = np.diff(ids.offsets.to_numpy()).astype(np.int32)
        blobs = [graph.astype(np.int32), base, sizes, ids.flatten().to_numpy()]
        keys = [points.column(c)[:1].cast(t) for c, t in (("dim", pa.int32()), ("shard", pa.int64()), ("sub", pa.int32()))]
        names = [x.split()[0] for x in _GRAPH.split(", ")]
        return pa.table([*keys, pa.array([entry], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in blobs]], names=names)

    return run


def _nearest(bound: float, k: int):
    out_type = pa.schema([("key", pa.struct([("a", pa.int64()), ("b", pa.int64())])), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])

    def run(shard: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(shard) or not len(queries):
            return out_type.empty_table()
        blob = lambda name, t: np.frombuffer(shard.column(name)[0].as_py(), t)
        asked = _matrix(queries.column("v")).astype(np.float64)
        base = blob("base", np.float64).reshape(-1, asked.shape[1])
        graph = blob("graph", np.int32).reshape(-1, DEGREE)
        lists = np.split(blob("ids", np.int64), np.cumsum(blob("sizes", np.int32))[:-1])
        lifted = lift(base, bound)
        norms = np.einsum("nd,nd->n", lifted, lifted)
        out_ids, out_scores = [], []
        for lo in range(0, len(asked), 512):
            block = asked[lo : lo + 512]
            found, _ = beam_search(lifted, norms, graph, shard.column("entry")[0].as_py(), flat(block), max(SEARCH_BEAM, 4 * (k + 1)))
            for q, row in zip(block, found):
                row = row[row >= 0]
                scores = (base[row] * q).sum(1)
                hits = sorted((-s, i) for s, r in zip(scores.tolist(), row.tolist()) for i in lists[r].tolist())[: k + 1]
                out_ids.append([i for _, i in hits])
                out_scores.append([-s for s, _ in hits])
        return pa.table([queries.column("key"), pa.array(out_ids, pa.list_(pa.int64())), pa.array(out_scores, pa.list_(pa.float64()))], schema=out_type)

    return run


def search(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, id and score of the k nearest found for every row whose id is divisible by every."""
    v = F.col("v")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = df.select(df[id_col].cast("long").alias("id"), df[vector].cast("array<double>").alias("v")).filter("id is not null").filter(F.coalesce(sound, F.lit(False)))
    rows = materialize(rows.select("id", F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(5), "v").alias("b")).alias("key"), F.size("v").alias("dim"), "v"), "vectors")

    # the k + 1 smallest ids of each vector, in two steps: first within slices of its rows
    least = lambda *by: Window.partitionBy(*by).orderBy("id")
    ids = rows.select("key", "id").distinct().withColumn("salt", F.pmod(F.hash("id"), F.lit(SALTS)))
    ids = ids.withColumn("r", F.row_number().over(least("key", "salt"))).filter(F.col("r") <= k + 1)
    ids = ids.withColumn("r", F.row_number().over(least("key"))).filter(F.col("r") <= k + 1)
    ids = ids.groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    vectors = rows.groupBy("key").agg(F.min(F.struct("id", "dim", "v")).alias("x"))
    nodes = materialize(ids.join(vectors, "key").select("key", "ids", "x.dim", "x.v"), "nodes")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    n, top, longest = nodes.agg(F.count("*"), F.max(square), F.max("dim")).first()
    bound = float(top or 0)

    asked = rows.filter(F.col("id") % every == 0).select("key", "id").distinct()
    wanted = materialize(asked.select("key").distinct().join(nodes.select("key", "dim", "v"), "key"), "queries")
    router = Router.fit(nodes, n, longest or 1, bound)
    nodes = materialize(_routed(nodes, router), "routed")
    many = _measured(nodes, wanted, router, k) if router.centres else 1
    visits = materialize(_visited(wanted, router, many), "visits")

    # a shard of more than twice its share is dealt to several, and queries that meet in one to parts;
    # one row for every centre at most
    share = max(SHARD_VECTORS, -(-n // MAX_CENTRES))
    sizes = nodes.groupBy("dim", "shard").agg(F.count("*").alias("n"))
    sizes = sizes.join(visits.groupBy("dim", "shard").agg(F.count("*").alias("q")), ["dim", "shard"])
    pieces = lambda c, by: F.greatest(F.ceil(F.col(c) / by), F.lit(1)).cast("int")
    sizes = F.broadcast(materialize(sizes.select("dim", "shard", F.when(F.col("n") <= 2 * share, 1).otherwise(pieces("n", share)).alias("subs"), pieces("q", PART_QUERIES).alias("parts")), "sizes"))
    span = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    points = nodes.join(sizes, ["dim", "shard"]).select("dim", "shard", F.pmod("key.a", "subs").cast("int").alias("sub"), "ids", "v")
    graphs = materialize(points.groupBy("dim", "shard", "sub").applyInArrow(_graphs(bound), _GRAPH), "graphs")
    left = graphs.join(sizes, ["dim", "shard"]).withColumn("part", span("parts"))
    right = visits.join(sizes, ["dim", "shard"]).withColumn("part", F.pmod("key.b", "parts").cast("int")).withColumn("sub", span("subs"))

    by = ["dim", "shard", "sub", "part"]
    left, right = left.drop("subs", "parts"), right.select(*by, "key", "v")
    hits = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_nearest(bound, k), "key struct<a:bigint,b:bigint>, ids array<bigint>, scores array<double>")
    hits = hits.select("key", F.explode(F.arrays_zip("ids", "scores")).alias("h")).select("key", F.col("h.ids").alias("hit"), F.col("h.scores").alias("score"))
    best = Window.partitionBy("key").orderBy(F.desc("score"), "hit")
    hits = hits.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).select("key", "hit", "score")
    per_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "hit")
    out = asked.withColumnRenamed("id", "query_id").join(materialize(hits, "hits"), "key").filter("hit != query_id")
    return out.withColumn("rank", F.row_number().over(per_query)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("hit").alias(id_col), "score")
