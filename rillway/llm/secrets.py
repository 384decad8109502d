"""Secret scan: fixed patterns, and a randomness test battery for tokens that no pattern knows.

Base kinds (leftmost non-overlapping matches of each; matches that are too short are dropped after
matching): assign, access, hex.  Spans are code points of the whole text, end exclusive.

The battery looks at every maximal run of 20 or more letters, digits and `+/_=-` that overlaps no
base span.  Its longest piece between separators is tested where that is most of it, else all of it
without the separators.  The encoding is inferred from the characters (16, 26, 32, 36, 52, 58 or 62
symbols; plain numbers have none and are not tested).  Three tests are made:

- chi-squared of symbol counts against a uniform alphabet,
- runs: changes between classes of characters, or between halves of the alphabet in a single class,
- serial correlation of neighbouring symbols.

A token that one of the three rejects as random (p < VETO) counts as p = 1.  For the others each
statistic gets a p-value under ordinary text, and Fisher's method combines the three: how likely text
would be as even, change class as often, and have neighbours as independent as this token.  What text is
like is measured on all texts, without the tokens themselves: frequencies of letters (which give mean and
spread of the chi-squared statistic for every alphabet and length), the rate at which neighbours change
class (LEAST_CHANGES at least, since identifiers do so more often than prose), and how often each pair of
letters stands side by side.  Serial dependence under text is the sum of the pairs' logarithmic odds against
independence; its mean and spread grow with the length.

Because short tokens carry little evidence, false discoveries are controlled within strata of length:
the Benjamini-Hochberg threshold of each stratum comes from all candidates of all documents.
p-values are rounded up to BINS steps, so that a histogram of fixed size is enough to find it.

Defined cases: a null text counts as empty; repeated rows and documents are scanned alike; no
candidates means no threshold.  scan() passes input columns through; its columns carry the names in OUT
and replace input columns of the same name.  redact() keeps all columns, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run of under 32 characters fails the length rule whole, so the minimum may stand in the pattern.
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
SEPARATORS = re.compile(r"[+/_=-]+")
#: A piece that is tested alone: least length, and share of the token's characters.
PIECE, PIECE_SHARE = 16, 0.6
#: Lengths at which strata begin; bins of -log10(p), BINS_PER_DECADE each, BINS at most.
STRATA = [20, 32, 48, 96]
BINS_PER_DECADE, BINS = 20, 400
FALSE_DISCOVERIES = 0.01
VETO = 1e-4
LEAST_CHANGES = 0.4
#: Letters of neighbouring pairs depend on those before; the variance of their sum is so many times that of independent ones.
SERIAL_SPREAD = 3.0
OUT = ["base", "candidates", "n_assign", "n_access", "n_hex", "pairs"]

_LOWER, _UPPER, _DIGIT = map(frozenset, ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"))
_HEX_LOWER, _HEX_UPPER = map(frozenset, ("0123456789abcdef", "0123456789ABCDEF"))
_B32_UPPER, _B32_LOWER = map(frozenset, ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz234567"))
#: Symbols of pairs: 0 for what is no letter or digit, 1 to 26 letters of either case, 27 digits, 28 other letters.
SYMBOLS = 29
_SYMBOL = np.array([ord(c) - 96 if c in _LOWER else ord(c) - 64 if c in _UPPER else 27 if c in _DIGIT else 0 for c in map(chr, range(128))], np.int64)
_KIND = np.array([1 if c in _LOWER else 2 if c in _UPPER else 3 if c in _DIGIT else 0 for c in map(chr, range(128))], np.int64)


def tested(token: str) -> str:
    """What of a token is tested."""
    pieces = SEPARATORS.split(token)
    longest = max(pieces, key=len)
    whole = "".join(pieces)
    return longest if len(longest) >= PIECE and len(longest) >= PIECE_SHARE * len(whole) else whole


def encoding(run: str) -> int:
    """Size of the inferred alphabet; 0 for plain numbers and nothing."""
    chars = set(run)
    lower, upper, digit = (bool(chars & c) for c in (_LOWER, _UPPER, _DIGIT))
    if not (lower or upper):
        return 0
    if lower and upper:
        return 52 if not digit else 58 if len(run) >= 100 and not chars & set("0OIl") else 62
    if not digit:
        return 26
    if chars <= _HEX_LOWER or chars <= _HEX_UPPER:
        return 16
    return 32 if chars <= _B32_UPPER or chars <= _B32_LOWER else 36


def _upper_normal(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


@dataclass
class TextModel:
    """What neighbouring characters of ordinary text are like."""

    second: float  # sums of squares and cubes of the letters' shares
    third: float
    changes: float  # share of neighbours of different classes
    odds: list[list[float]]  # of each pair of symbols, logarithm of its frequency against independence
    mean: float  # of the odds over the pairs of text, and their variance
    variance: float

    @classmethod
    def of(cls, counts: list[int]) -> "TextModel":
        """From the numbers of count_pairs, summed over all texts."""
        pairs = np.array(counts[: SYMBOLS * SYMBOLS], float).reshape(SYMBOLS, SYMBOLS) + 0.3
        pairs[0, 0] = 0.0  # nothing between two that are neither letter nor digit
        share = pairs / pairs.sum()
        left, right = share.sum(1), share.sum(0)
        odds = np.log(np.maximum(share, 1e-300) / np.outer(left, right))
        odds[0, 0] = 0.0
        letters = pairs[1:27].sum(1) / pairs[1:27].sum()
        mean = float((share * odds).sum())
        variance = float((share * odds**2).sum()) - mean**2
        near, changed = counts[SYMBOLS * SYMBOLS :]
        rate = max(LEAST_CHANGES, changed / near if near else 0.0)
        odds[27, 27] = min(odds[27, 27], mean)  # digits among digits are no sign of text
        return cls(float((letters**2).sum()), float((letters**3).sum()), rate, odds.tolist(), mean, max(variance, 0.25))


def count_pairs(texts: list[str]) -> np.ndarray:
    """Counts of pairs of symbols in the texts without their candidates, of neighbours that have a class,
    and of those whose classes differ."""
    points = np.frombuffer("\n".join(CANDIDATE.sub(" ", t) for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(SYMBOLS * SYMBOLS + 2, np.int64)
    for lo in range(0, len(points) - 1, 1_000_000):
        p = points[lo : lo + 1_000_001]
        ascii_ = p < 128
        at = np.where(ascii_, p, 0)
        other = (p >= 0xC0) & ~((p >= 0x2000) & (p < 0x2C00))  # letters, all but exactly
        symbol = np.where(ascii_, _SYMBOL[at], np.where(other, 28, 0))
        kind = np.where(ascii_, _KIND[at], 0)
        out[:-2] += np.bincount(symbol[:-1] * SYMBOLS + symbol[1:], minlength=SYMBOLS * SYMBOLS)
        near = (kind[:-1] > 0) & (kind[1:] > 0)
        out[-2] += near.sum()
        out[-1] += (near & (kind[:-1] != kind[1:])).sum()
    return out


def p_value(token: str, model: TextModel) -> float:
    """How likely text would look as random as this token; 1 where it doesn't look random itself."""
    run = tested(token)
    size, n = encoding(run), len(run)
    if not size or n < 8:
        return 1.0
    count = Counter(run)
    chi = size / n * sum(c * c for c in count.values()) - n
    codes = np.frombuffer(run.encode("ascii"), np.uint8)
    kinds = _KIND[codes]
    single = bool((kinds == kinds[0]).all())
    # a single class is parted into the halves of its alphabet
    classes = _SYMBOL[codes] > 13 if single else kinds
    changes = int((classes[1:] != classes[:-1]).sum())
    # a token's own symbols in order of their codes serve as numbers
    x = np.unique(codes, return_inverse=True)[1].astype(float)
    x -= x.mean()
    spread = float((x * x).sum())
    serial = float((x[1:] * x[:-1]).sum()) / spread if spread else 1.0

    # as random: Wilson and Hilferty's approximation of chi-squared, both sides of the others
    free = size - 1
    cube = ((chi / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
    rate = 1 - float(((np.unique(classes, return_counts=True)[1] / n) ** 2).sum())
    runs = (changes - (n - 1) * rate) / math.sqrt(max((n - 1) * rate * (1 - rate), 0.25))
    if min(_upper_normal(cube), 2 * _upper_normal(abs(runs)), 2 * _upper_normal(abs(serial) * math.sqrt(n))) < VETO:
        return 1.0

    # as text
    second, third = model.second, model.third
    expected = size * (1 - second) + n * (size * second - 1)
    variance = 4 * n * size**2 * (third - second**2) + 2 * size**2 * second**2
    values = [_upper_normal((expected - chi) / math.sqrt(max(variance, 1e-9)))]
    if not single:  # halves of the alphabet change in text as they do at random
        values.append(_upper_normal((changes - 0.5 - (n - 1) * model.changes) / math.sqrt((n - 1) * model.changes * (1 - model.changes))))
    symbols = _SYMBOL[codes].tolist()
    dependence = sum(model.odds[a][b] for a, b in zip(symbols, symbols[1:]))
    values.append(_upper_normal(((n - 1) * model.mean - dependence) / math.sqrt((n - 1) * SERIAL_SPREAD * model.variance)))
    half = -sum(math.log(max(v, 1e-300)) for v in values)
    tail = term = 1.0
    for k in range(1, len(values)):  # chi-squared with twice as many degrees of freedom as values
        term *= half / k
        tail += term
    return min(1.0, math.exp(-half) * tail)


def spans_of(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, str]]]:
    """Base spans (start, kind, end) in order, and candidates (start, end, token)."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    found, k, until = [], 0, 0
    for m in CANDIDATE.finditer(text):
        while k < len(base) and base[k][0] < m.end():
            until = max(until, base[k][2])
            k += 1
        if m.start() >= until and encoding(m[0]):
            found.append((m.start(), m.end(), m[0]))
    return base, found


_BASE = "array<struct<start:int,kind:int,end:int>>"


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the columns of OUT: base array<struct<start,kind,end>>, candidates
    array<struct<start,end,token>>, the counts of the base kinds, and pairs (on some rows: counts of
    neighbouring characters of these and the rows before)."""
    kept = df.select([df[c] for c in df.columns if c not in OUT])
    names, at = kept.columns, kept.columns.index(text)
    base_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    found_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("token", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                texts = [t or "" for t in part.column(at).to_pylist()]
                made = [spans_of(t) for t in texts]
                base = [[dict(zip(("start", "kind", "end"), s)) for s in m[0]] for m in made]
                found = [[dict(zip(("start", "end", "token"), s)) for s in m[1]] for m in made]
                counts = [pa.array([sum(s[1] == k for s in m[0]) for m in made], pa.int64()) for k in range(3)]
                pairs = pa.array([count_pairs(texts), *[None] * (len(texts) - 1)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(base, base_type), pa.array(found, found_type), *counts, pairs], names=[*names, *OUT])

    made = StructType.fromDDL(f"base {_BASE}, candidates array<struct<start:int,end:int,token:string>>, {', '.join(f'{c} bigint' for c in OUT[2:5])}, pairs array<bigint>")
    return kept.mapInArrow(run, StructType([*kept.schema, *made]))


def text_model(scanned: DataFrame) -> TextModel:
    """What ordinary text is like, from all texts; the driver gets a fixed number of sums."""
    sums = scanned.filter("pairs is not null").select(F.posexplode("pairs").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect()
    counts = [0] * (SYMBOLS * SYMBOLS + 2)
    for r in sums:
        counts[r["i"]] = r["n"]
    return TextModel.of(counts)


def score(scanned: DataFrame, model: TextModel) -> DataFrame:
    """scanned with candidates array<struct<start,end,stratum,bin>> in place of the tokens, without pairs."""

    @F.udf("array<struct<start:int,end:int,stratum:int,bin:int>>", useArrow=True)
    def scored(found):
        out = []
        for c in found or []:
            n = c["end"] - c["start"]
            bin_ = min(BINS, int(-math.log10(max(p_value(c["token"], model), 1e-300)) * BINS_PER_DECADE))
            out.append((c["start"], c["end"], sum(n >= s for s in STRATA[1:]), bin_))
        return out

    return scanned.withColumn("candidates", scored("candidates")).drop("pairs")


def thresholds(scored: DataFrame, rate: float = FALSE_DISCOVERIES) -> dict[int, int]:
    """Least bin that is a discovery in each stratum, by Benjamini and Hochberg over all documents."""
    rows = scored.select(F.explode("candidates").alias("c")).groupBy("c.stratum", "c.bin").count().collect()
    out: dict[int, int] = {}
    for s in {r["stratum"] for r in rows}:
        bins = sorted(((r["bin"], r["count"]) for r in rows if r["stratum"] == s), reverse=True)
        total, above = sum(n for _, n in bins), 0
        for b, n in bins:
            above += n
            if 10 ** (-b / BINS_PER_DECADE) <= rate * above / total:
                out[s] = b
    return out


def spans(limits: dict[int, int]) -> Column:
    """All spans of a scored row: base and discovered ones, array<struct<start,kind,end>>."""
    hit = lambda c: F.coalesce(*[F.when(c["stratum"] == s, c["bin"] >= b) for s, b in limits.items()], F.lit(False))
    added = F.transform(F.filter("candidates", hit), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return F.array_sort(F.concat("base", added))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined in order."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def redact(df: DataFrame, mark: str = "[secret]", text: str = "text") -> DataFrame:
    """df with every span of its text replaced by mark; overlapping spans are replaced as one.

    The base patterns' keyword goes with the value.  The columns are those of df.
    """
    from rillway.llm.common import materialize

    # all columns as one, so that none of them can share a name with the scan's
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), df[text].alias("text"))
    scanned = materialize(scan(rows), "scanned")
    scored = materialize(score(scanned.select("row", "base", "candidates"), text_model(scanned)), "scored")
    found = scored.select("row", spans(thresholds(scored)).alias("spans"))

    @F.udf("string", useArrow=True)
    def cut(value, found):
        if value is None:
            return None
        parts, at = [], 0
        for s in found:
            if s["start"] >= at:
                parts += [value[at : s["start"]], mark]
            at = max(at, s["end"])
        return "".join([*parts, value[at:]])

    some = F.size("spans") > 0
    value = F.col("row").getField(text)
    clean = F.when(some, cut(F.when(some, value), F.when(some, F.col("spans")))).otherwise(value)
    return found.select(*[(clean if c == text else F.col("row").getField(c)).alias(c) for c in df.columns])
