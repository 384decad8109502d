"""Minimax contiguous partition of ordered atomic groups into shards.

Rows with equal text are an atomic group; groups are ordered by a 63-bit hash of the text.  The
shards are contiguous runs of that order, and the largest shard is as small as possible: a binary
search finds the least capacity for which a greedy fill needs no more than the wanted number of
shards, and the greedy fill at that capacity gives the cuts.

The greedy check needs prefix sums of group sizes.  They are never gathered: the driver holds sums
over buckets of the hash (2**FIRST_BITS of them at most) and treats a bucket of several groups as
an interval in which a cut may fall anywhere.  That brackets the least capacity from below and
above, and every cut from both sides; only the buckets between a cut's two sides, one range of keys
for each shard at most, are split by further bits of the hash, until all sides agree.  Sides only
move towards each other, so what lies between two ranges counts as one bucket from then on.  The
result is exact, and the driver holds MAX_SUMS sums and two for each shard, whatever the rows.

Slots: rows are dealt to cells of a shard by a hash of their id, text and place in the table (stored
in the first pass), so that a row that repeats very often is spread like any other.

Defined cases: a null text has no bytes and forms one group with the empty text; every row counts
one more byte than its text; repeated rows each get a slot; an empty table gives an empty result.
Two texts with the same hash are one group, which keeps equal texts together all the same.  If one
group is larger than an equal share, the largest shard is that group's and some shards may stay
empty.  Further columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate, zip_longest

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillway.llm.common import materialize

KEY_BITS = 63
FIRST_BITS = 14
STEP_BITS = 8
#: Sums that a refinement may bring to the driver; it takes fewer bits at once where it would be more.
MAX_SUMS = 2**16
#: Rows that one task numbers, unless that would make more than MAX_CELLS cells.
CELL_ROWS = 4096
MAX_CELLS = 20_000


@dataclass
class Segment:
    """A bucket of the key order: keys from lo up to hi, and what their groups weigh."""

    lo: int
    hi: int
    size: int
    groups: int


class Prefix:
    """Prefix sums over segments, with greedy fills that are exact at segments of one group."""

    def __init__(self, segments: list[Segment], shards: int, largest: int):
        self.segments, self.shards, self.largest = segments, shards, largest
        self.starts = [0]
        for s in segments:
            self.starts.append(self.starts[-1] + s.size)
        self.total = self.starts[-1]

    def fill(self, capacity: int, hopeful: bool) -> list[int]:
        """Ends of the shards; where a cut falls inside a segment of several groups, a hopeful fill
        takes the capacity in full and the other one stops before the segment."""
        at, ends = 0, []
        while at < self.total and len(ends) < self.shards:
            to = at + capacity
            if to >= self.total:
                to = self.total
            else:
                j = bisect_right(self.starts, to) - 1
                if not hopeful or self.segments[j].groups == 1:
                    to = self.starts[j]
            at = to
            ends.append(at)
        return ends

    def least(self, hopeful: bool, bounds: tuple[int, int] | None = None) -> int:
        """Least capacity that suffices, searched between the bounds where there are some."""
        lo, hi = bounds or (max(-(-self.total // self.shards), self.largest), self.total)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.fill(mid, hopeful)[-1] >= self.total:
                hi = mid
            else:
                lo = mid + 1
        return lo


def _inside(ranges: list[tuple[int, int]]) -> Column:
    """Whether the key lies in one of the ranges; a balanced tree of conditions."""
    if len(ranges) > 1:
        half = len(ranges) // 2
        return _inside(ranges[:half]) | _inside(ranges[half:])
    lo, hi = ranges[0]
    return (F.col("key") >= F.lit(lo)) & (F.col("key") <= F.lit(hi - 1))


def _joined(segments: list[Segment]) -> list[Segment]:
    """One segment for all, in which no cut can fall."""
    return [Segment(segments[0].lo, segments[-1].hi, sum(s.size for s in segments), sum(s.groups for s in segments))] if segments else []


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """Least capacity, and the first key of every shard but the first; groups: key, size."""
    largest = 0

    def summed(bits: int, ranges: list[tuple[int, int]]) -> list[Segment]:
        nonlocal largest
        shift = KEY_BITS - bits
        rows = groups.filter(_inside(ranges)) if ranges else groups
        found = rows.groupBy(F.shiftright("key", shift).alias("b")).agg(F.sum("size"), F.count("*"), F.max("size")).collect()
        largest = max([largest, *(r[3] for r in found)])
        return sorted((Segment(b << shift, (b + 1) << shift, int(size), n) for b, size, n, _ in found), key=lambda s: s.lo)

    bits = FIRST_BITS
    segments = summed(bits, [])
    bounds = None
    while True:
        at = Prefix(segments, shards, largest)
        if not at.total:
            return 0, []
        low, high = bounds = at.least(True, bounds), at.least(False, bounds)
        early, late = at.fill(low, False), at.fill(high, True)
        if low == high and early == late and set(early) <= set(at.starts):
            return low, [segments[bisect_right(at.starts, e) - 1].lo for e in early[:-1] if e < at.total]
        # the segments in which each cut lies, as runs of neighbours; gaps between them hold no key
        several = [0, *accumulate(s.groups > 1 for s in segments)]
        hits: list[list[int]] = []
        for a, b in zip_longest(early, late, fillvalue=at.total):
            first = max(0, bisect_right(at.starts, a) - 1)
            last = min(len(segments) - 1, bisect_right(at.starts, b) - 1)
            if hits and first <= hits[-1][1] + 1:
                hits[-1][1] = max(hits[-1][1], last)
            else:
                hits.append([first, last])
        open_ = [several[b + 1] > several[a] for a, b in hits]
        ranges = [(segments[a].lo, segments[b].hi) for (a, b), o in zip(hits, open_) if o]
        # as much finer as the driver may hold
        step = STEP_BITS
        while step > 1 and sum(hi - lo for lo, hi in ranges) >> KEY_BITS - min(KEY_BITS, bits + step) > MAX_SUMS:
            step -= 1
        bits = min(bits + step, KEY_BITS)
        finer = summed(bits, ranges)
        # what lies between two ranges can hold no cut any more and counts as one
        rest, done = [], 0
        for (a, b), o in zip([*hits, [len(segments), len(segments)]], [*open_, True]):
            rest += _joined(segments[done:a]) + ([] if o else segments[a : b + 1])
            done = b + 1
        segments = sorted(rest + finer, key=lambda s: s.lo)


def shard(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard and slot (gapless from 0 in each shard) of every row."""
    text = F.coalesce(df[text_col], F.lit(""))
    slim = materialize(
        df.select(
            df[id_col].alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("crc"),
            F.shiftrightunsigned(F.xxhash64(text), 1).alias("key"),
            F.monotonically_increasing_id().alias("place"),
        ),
        "sizes",
    )
    groups = slim.groupBy("key").agg(F.sum("size").alias("size"))
    _, starts = minimax_cuts(groups, shards)
    number = F.lit(0)
    for start in starts:
        number = number + (F.col("key") >= F.lit(start)).cast("int")
    placed = slim.withColumn("shard", number)

    # slots: rows are dealt to cells within a shard, numbered there, and shifted by the cells before
    rows = {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}
    cell_rows = max(CELL_ROWS, sum(rows.values()) // MAX_CELLS)
    cells = F.lit(1)
    for s, n in rows.items():
        cells = F.when(F.col("shard") == s, F.lit(-(-n // cell_rows))).otherwise(cells)
    placed = placed.withColumn("cell", F.pmod(F.hash("id", "key", "place"), cells))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    shifts = placed.groupBy("shard", "cell").count().select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    within = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("id", "key", "place"))
    # MAX_CELLS plus the number of shards bounds the broadcast side
    return placed.withColumn("within", within).join(F.broadcast(shifts), ["shard", "cell"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("shift") + F.col("within") - 1).cast("long").alias("slot")
    )
