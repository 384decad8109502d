"""Removal of every byte that a repeated string of WINDOW bytes covers, over all texts.

Sorting every suffix of the corpus would move each byte hundreds of times.  Two observations keep the
sort small and the answer exact:

- A window of WINDOW bytes has an anchor: the leftmost least hash among its k-grams.  Equal windows
  have equal anchors at equal places, so only windows with equal anchor k-grams need comparing.  The
  windows of one anchor are neighbours and form a cell; windows in one cell always differ.
- Anchors whose k-gram occurs once in the corpus cannot hold a repeated window.  Their hashes are
  counted first, and only cells of repeated k-grams take part in the sort.

The sort is a distributed merge sort of the cells' suffixes.  Every task sorts its suffixes (text from
the anchor on, then what precedes it in the cell, reversed), drops equal ones, front-codes the run and
deals it to buckets by k-gram.  A bucket merges its runs with a loser tree that knows, for every
waiting suffix, how long its common prefix with the last winner is: suffixes are compared by these
lengths, and bytes are only looked at beyond a known common prefix.  Suffixes that meet an equal one
are repeated whole.  Different suffixes with the same anchor k-gram come out next to each other; for
them the single windows are found by hashes within the group, and compared byte by byte.

Equal suffixes of one task travel as one, so that a group of very many copies reaches a bucket once
per task.  Buckets hold about BUCKET_CELLS cells, whatever the input.

Defined cases: a null text counts as empty; texts shorter than WINDOW bytes keep everything; rows that
repeat id and text are repeated text like any other; null ids are a value of their own; very long
texts are cut into pieces of PIECE windows that overlap, which changes cells but no result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillway.llm.common import materialize

WINDOW, GRAM = 200, 32
SPAN = WINDOW - GRAM + 1
PIECE = 4_000_000
#: Bytes of texts that are hashed together, and bytes of suffixes that make a run; they bound memory.
CHUNK_BYTES, RUN_BYTES = 4_000_000, 40_000_000
BUCKET_CELLS, LEAST_BUCKETS = 50_000, 48
NO_ID = -(2**63)

_U = np.uint64
_TABLE = np.random.Generator(np.random.Philox(11)).integers(0, 2**64, 256, dtype=np.uint64)
_FACTORS = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
_LOW = _U(0xFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _grams(buffer: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all strings of that many bytes (a power of two)."""
    h, step = _TABLE[buffer], 1
    for factor in _FACTORS:
        if step == length:
            break
        h = h[:-step] * factor + h[step:]
        step *= 2
    return _mix(h)


def _cells_of(buffer: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window, anchor and k-gram hash of every cell; ends: where texts end."""
    grams = _grams(buffer, GRAM)
    least = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    step = 1
    while 2 * step <= SPAN:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if SPAN > step:
        least = np.minimum(least[: step - SPAN], least[SPAN - step :])
    anchor = (least & _LOW).astype(np.int64)
    inside = np.ones(len(anchor), bool)
    for e in ends[:-1]:
        inside[max(0, e - WINDOW + 1) : e] = False
    starts = inside.copy()
    starts[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    first = np.flatnonzero(starts)
    stops = np.flatnonzero(np.append(starts | ~inside, True))
    last = stops[np.searchsorted(stops, first, side="right")] - 1
    return first, last, anchor[first], grams[anchor[first]]


def cells(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Cells of each text: first and last window, anchor (byte offsets) and k-gram hash, in order.

    A text's cells do not depend on the other texts."""
    out: list[list[tuple]] = [[] for _ in texts]
    waiting: list[tuple[int, int, bytes]] = []
    size = 0

    def settle() -> None:
        data = np.frombuffer(b"".join(p for _, _, p in waiting), np.uint8)
        ends = np.cumsum([len(p) for _, _, p in waiting])
        first, last, anchor, gram = _cells_of(data, ends)
        cut = np.searchsorted(first, np.concatenate([[0], ends]))
        for k, (i, at, piece) in enumerate(waiting):
            own, shift = slice(cut[k], cut[k + 1]), at - (int(ends[k]) - len(piece))
            out[i].append((first[own] + shift, last[own] + shift, anchor[own] + shift, gram[own]))
        waiting.clear()

    for i, t in enumerate(texts):
        for at in range(0, len(t) - WINDOW + 1, PIECE):
            piece = t[at : at + PIECE + WINDOW - 1]
            if waiting and size + len(piece) > CHUNK_BYTES:
                settle()
                size = 0
            waiting.append((i, at, piece))
            size += len(piece)
    if waiting:
        settle()
    empty = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    return [tuple(map(np.concatenate, zip(*parts))) if parts else empty for parts in out]


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which that much is known."""
    m = min(len(a), len(b))
    x, y = a[known:m], b[known:m]
    if x == y:
        return m
    return m - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8


def merge(runs: list[Iterator[tuple[int, bytes, object]]]) -> Iterator[tuple[int, bytes, object]]:
    """Merge runs of (common prefix with the run's previous string, string, payload) in order; yields
    (common prefix with the previous string, string, payload).

    A loser tree: every waiting string carries its common prefix with the last winner, longer ones go
    first, and only equal lengths make two strings be compared, from there on."""
    count = max(1, len(runs))
    size = 1 << (count - 1).bit_length()
    heads: list = [next(r, None) for r in runs] + [None] * (size - len(runs))
    known = [0] * size
    losers = [0] * size

    def play(i: int, j: int) -> tuple[int, int]:
        """Winner and loser; the loser learns its common prefix with the winner."""
        a, b = heads[i], heads[j]
        if b is None:
            return i, j
        if a is None:
            return j, i
        x, y = known[i], known[j]
        if x != y:
            return (i, j) if x > y else (j, i)
        s, t = a[1], b[1]
        n = common(s, t, x)
        if n == len(s) or n < len(t) and s[n] < t[n]:
            known[j] = n
            return i, j
        known[i] = n
        return j, i

    winners = [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    winner = winners[1]
    last = 0
    while (head := heads[winner]) is not None:
        yield last, head[1], head[2]
        heads[winner] = following = next(runs[winner], None)
        known[winner] = following[0] if following is not None else 0
        node = (winner + size) // 2
        while node:
            other = losers[node]
            winner, losers[node] = play(winner, other)
            node //= 2
        last = known[winner]


def _keyed(df: DataFrame, id_col: str, text: str) -> DataFrame:
    t = F.coalesce(df[text], F.lit(""))
    return df.select(F.coalesce(df[id_col].cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(t).alias("h"), t.alias("text"))


def _hash_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, h, text) -> (id, h, grams)."""
    for b in batches:
        for lo in range(0, b.num_rows, 1000):
            part = b.slice(lo, 1000)
            found = cells([t.encode() for t in part.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([c[3].view(np.int64) for c in found], pa.list_(pa.int64()))], names=["id", "h", "grams"])


_RUN_SCHEMA = "bucket int, run binary, id bigint, h bigint, first int, stop int"
_RUN_NAMES = ["bucket", "run", "id", "h", "first", "stop"]
_RUN_TYPES = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, _RUN_TYPES)], names=_RUN_NAMES)


def _joined(spans: list[tuple]) -> list[tuple]:
    """Spans (id, h, first, stop), with those of a text that touch made one."""
    out: list[tuple] = []
    for id_, h, first, stop in sorted(spans):
        if out and out[-1][:2] == (id_, h) and first <= out[-1][3]:
            out[-1] = (id_, h, out[-1][2], max(stop, out[-1][3]))
        else:
            out.append((id_, h, first, stop))
    return out


def _encode(entries: list[tuple]) -> bytes:
    """A front-coded run: numbers of every entry, then what each string adds to the one before."""
    numbers = np.zeros((len(entries), 6), np.int64)
    rest, before = [], b""
    for k, (s, one, id_, h, first, windows) in enumerate(entries):
        n = common(before, s)
        numbers[k] = n, len(s) - n, one, id_, h, first << 16 | windows
        rest.append(s[n:])
        before = s
    return len(entries).to_bytes(4, "big") + zlib.compress(numbers.T.tobytes() + b"".join(rest), 1)


def _decode(run: bytes) -> Iterator[tuple[int, bytes, tuple]]:
    n = int.from_bytes(run[:4], "big")
    data = zlib.decompress(run[4:])
    numbers = np.frombuffer(data, np.int64, 6 * n).reshape(6, n).T.tolist()
    at, before = 48 * n, b""
    for shared, added, one, id_, h, place in numbers:
        before = before[:shared] + data[at : at + added]
        at += added
        yield shared, before, (one, id_, h, place >> 16, place & 0xFFFF)


def _runs(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, h, text, picked cells) -> front-coded runs by bucket, and windows known to repeat."""
        held: list[tuple] = []
        size = 0

        def settle() -> Iterator[pa.RecordBatch]:
            held.sort()
            known: list[tuple] = []
            dealt: dict[int, list[tuple]] = {}
            k = 0
            while k < len(held):
                s, bucket, id_, h, first, windows = held[k]
                j = k + 1
                while j < len(held) and held[j][0] == s:
                    j += 1
                if j > k + 1:
                    known += [(x[2], x[3], x[4], x[4] + x[5] - 1 + WINDOW) for x in held[k:j]]
                dealt.setdefault(bucket, []).append((s, j == k + 1, id_, h, first, windows))
                k = j
            held.clear()
            # these are done; any bucket may pass them on
            rows = [((x[0] ^ x[1]) % buckets, None, *x) for x in _joined(known)]
            for lo in range(0, len(rows), 20_000):
                yield _batch(rows[lo : lo + 20_000])
            for bucket, entries in dealt.items():
                yield _batch([(bucket, _encode(entries), None, None, None, None)])

        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                texts = [t.encode() for t in part.column(2).to_pylist()]
                for id_, h, t, c, picked in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, cells(texts), part.column(3).to_pylist(), strict=True):
                    pick = np.sort(np.array(picked, np.int64))
                    for first, last, anchor, gram in zip(*(x[pick].tolist() for x in c)):
                        s = t[anchor : last + WINDOW] + t[first:anchor][::-1] + (last + WINDOW - anchor).to_bytes(2, "big")
                        held.append((s, gram % buckets, id_, h, first, last - first + 1))
                        size += len(s)
                if size > RUN_BYTES:
                    yield from settle()
                    size = 0
        yield from settle()

    return run


def _windows(groups: list[list[tuple]]) -> Iterator[tuple]:
    """For groups of different suffixes with one anchor k-gram: (id, h, first, stop) of the repeated
    windows of those that are not known to repeat; entries: (string, known, id, h, first, windows)."""
    flat = [e for g in groups for e in g]
    if not flat:
        return
    pieces = []
    for s, *_ in flat:
        right = int.from_bytes(s[-2:], "big")
        pieces.append(s[right:-2][::-1] + s[:right])
    lengths = np.array([len(p) for p in pieces])
    data = b"".join(pieces)
    buffer = np.frombuffer(data, np.uint8)
    starts = np.cumsum(lengths) - lengths
    long, mid, short = _grams(buffer, 128), _grams(buffer, 64), _grams(buffer, 8)
    n = len(buffer) - WINDOW + 1
    prints = _mix(_mix(long[:n] * _FACTORS[0] + mid[128 : 128 + n]) * _FACTORS[1] + short[192 : 192 + n])
    counts = lengths - WINDOW + 1
    entry = np.repeat(np.arange(len(flat)), counts)
    offset = np.arange(len(entry)) - np.repeat(np.cumsum(counts) - counts, counts)
    group = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    place = starts[entry] + offset
    keys = _mix(prints[place] + group[entry].astype(np.uint64) * _FACTORS[2])
    _, inverse, times = np.unique(keys, return_inverse=True, return_counts=True)
    open_ = np.array([not e[1] for e in flat])
    hit = np.flatnonzero((times[inverse] > 1) & open_[entry])
    if not len(hit):
        return
    # every hit is held against the first window of its hash, and that one against the second
    order = np.argsort(inverse, kind="stable")
    begin = np.cumsum(times) - times
    other = order[begin[inverse[hit]]]
    other = np.where(other == hit, order[begin[inverse[hit]] + 1], other)
    new = np.ones(len(hit), bool)
    new[1:] = (hit[1:] != hit[:-1] + 1) | (entry[hit[1:]] != entry[hit[:-1]]) | (other[1:] != other[:-1] + 1) | (entry[other[1:]] != entry[other[:-1]])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(hit)) - 1
    for head, tail in zip(heads.tolist(), tails.tolist()):
        w, e = int(hit[head]), int(entry[hit[head]])
        _, _, id_, h, first, _ = flat[e]
        first += int(offset[w])
        p, q, n = int(place[w]), int(place[other[head]]), tail - head
        if data[p : p + n + WINDOW] == data[q : q + n + WINDOW]:
            yield id_, h, first, first + n + WINDOW
            continue
        for k in range(n + 1):  # different strings with one hash: all windows of the hash are compared
            own = data[p + k : p + k + WINDOW]
            same = order[begin[inverse[w + k]] :][: times[inverse[w + k]]]
            if any(data[place[x] : place[x] + WINDOW] == own for x in same.tolist() if x != w + k and group[entry[x]] == group[e]):
                yield id_, h, first + k, first + k + WINDOW


#: Bytes of different suffixes whose windows are compared together.
GROUP_BYTES = 8_000_000


def _merged(table: pa.Table) -> pa.Table:
    """A bucket's runs -> repeated windows; rows that are known to repeat pass through."""
    runs = [r for r in table.column("run").to_pylist() if r is not None]
    plain = table.filter(pa.compute.is_null(table.column("run"))).select(_RUN_NAMES[2:])
    rows: list[tuple] = []
    groups: list[list[tuple]] = []
    size = 0

    def close(group: list[list]) -> None:
        nonlocal size
        for s, known, id_, h, first, windows in group:
            if known == 2:  # met an equal one here
                rows.append((id_, h, first, first + windows - 1 + WINDOW))
        if len(group) > 1:
            groups.append([(s, bool(known), id_, h, first, windows) for s, known, id_, h, first, windows in group])
            size += sum(len(e[0]) for e in group)
        if size > GROUP_BYTES:
            rows.extend(_windows(groups))
            groups.clear()
            size = 0

    group: list[list] = []
    for shared, s, (one, id_, h, first, windows) in merge([_decode(r) for r in runs]):
        if group and shared == len(s) == len(group[-1][0]):
            top = group[-1]
            if one:
                rows.append((id_, h, first, first + windows - 1 + WINDOW))
            if top[1] == 0:
                top[1] = 2
            continue
        if group and shared < GRAM:
            close(group)
            group = []
        group.append([s, 0 if one else 1, id_, h, first, windows])
    close(group)
    rows.extend(_windows(groups))
    rows = _joined(rows)
    made = pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, _RUN_TYPES[2:])], names=_RUN_NAMES[2:])
    return pa.concat_tables([made, plain.cast(made.schema)])


def repeated(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, h (hash of the text) and spans array<struct<first,stop>> of the rows that hold repeats."""
    docs = _keyed(df, id_col, text)
    hashed = materialize(docs.filter(F.octet_length("text") >= WINDOW).mapInArrow(_hash_cells, "id bigint, h bigint, grams array<bigint>"), "grams")
    grams = hashed.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram")
    # written, so that the join below is one of two plain exchanges, of which Spark splits a very common k-gram
    grams = materialize(grams, "repeated_grams")
    placed = hashed.select("id", "h", F.posexplode("grams").alias("cell", "gram"))
    picked = placed.join(grams, "gram", "left_semi").groupBy("id", "h").agg(F.collect_set("cell").alias("cells"))
    picked = materialize(picked, "picked")
    total = picked.agg(F.sum(F.size("cells"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-int(total) // BUCKET_CELLS))
    runs = docs.filter(F.octet_length("text") >= WINDOW).join(picked, ["id", "h"]).select("id", "h", "text", "cells").mapInArrow(_runs(buckets), _RUN_SCHEMA)
    found = runs.groupBy("bucket").applyInArrow(_merged, "id bigint, h bigint, first int, stop int")
    found = materialize(found, "repeats")
    return found.groupBy("id", "h").agg(F.array_sort(F.collect_set(F.struct("first", "stop"))).alias("spans"))


def _cut(text: bytes, spans: list[dict] | None) -> tuple[bytes, int, int]:
    """What is left, bytes removed and maximal removed runs."""
    parts, at, removed, count, end = [], 0, 0, 0, -1
    for s in spans or []:
        first, stop = s["first"], s["stop"]
        if first > end:
            count += 1
            parts.append(text[max(at, 0) : first])
            removed += stop - first
            at = end = stop
        elif stop > end:
            removed += stop - end
            at = end = stop
    parts.append(text[at:])
    return b"".join(parts), removed, count


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and kept (the bytes left)."""
    from hashlib import sha256

    spans = repeated(df, id_col, text)
    docs = _keyed(df, id_col, text).join(spans, ["id", "h"], "left").select("id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                ids = [None if i == NO_ID else i for i in part.column(0).to_pylist()]
                texts = [t.encode() for t in part.column(1).to_pylist()]
                cut = [_cut(t, s) for t, s in zip(texts, part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.array([c[1] for c in cut], pa.int64()),
                        pa.array([c[2] for c in cut], pa.int64()),
                        pa.array([sha256(c[0]).hexdigest() for c in cut], pa.string()),
                        pa.array([c[0] for c in cut], pa.binary()),
                    ],
                    names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    out = docs.mapInArrow(run, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    return out.withColumnRenamed("id", id_col)
