"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1.  A trigram's vector binds (multiplies) the
vectors of its letters, each permuted by its place; a document's vector bundles (adds) those of
its trigrams, a language's prototype those of its documents.  The language whose prototype has the
largest cosine with the document is predicted.

Letters are what str.isalpha accepts, in lower case; runs of anything else count as one blank, and
a text starts and ends with one.  Letter vectors come from a generator seeded by the code point, so
all processes agree without exchanging them.  Whole texts are read.

Training adds trigram counts per language in each task and bundles them there, so a task sends one
vector per language and not one per document; prototypes are sums of those.

Defined cases: a null text, or one without a letter, is `und` with score 0; rows with a null text
or language teach nothing; a cosine under 0 scores 0; ties go to the language that sorts first; if
nothing was learned all documents are `und`; repeated rows teach as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1024
SEED = 20_011
#: Documents that are bundled together, and their letters about; trigrams whose vectors are made
#: together, and letters of a text that are counted together.  They bound memory, not what is read.
GROUP, GROUP_LETTERS, KEYS, PIECE = 96, 400_000, 4096, 1_000_000


class Space:
    """Letter vectors, grown as letters are met; one per process."""

    _one: "Space | None" = None

    def __init__(self):
        self.index = np.full(0x110000, -1, np.int32)  # code point -> row of letters; 0 is the blank
        self.letters = np.zeros((256, DIMENSIONS), np.int8)  # doubled when full
        self.rolled = [np.zeros_like(self.letters) for _ in range(2)]  # letters rolled by 2 and 1
        self.count = 0
        self._add(32)

    @classmethod
    def get(cls) -> "Space":
        cls._one = cls._one or cls()
        return cls._one

    def _add(self, point: int) -> None:
        if self.count == len(self.letters):
            self.letters, *self.rolled = (np.concatenate([x, np.zeros_like(x)]) for x in (self.letters, *self.rolled))
        bits = np.random.Generator(np.random.Philox(key=[SEED, point])).integers(0, 2, DIMENSIONS, np.int8)
        self.letters[self.count] = 2 * bits - 1
        for by, out in zip((2, 1), self.rolled):
            out[self.count] = np.roll(self.letters[self.count], by)
        self.index[point] = self.count
        self.count += 1

    def rows(self, text: str) -> np.ndarray:
        """Rows of a text's letters, with single blanks around and between its runs of letters."""
        points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        rows = self.index[points]
        if (rows < 0).any():
            for p in np.unique(points[rows < 0]).tolist():
                if chr(p).isalpha():
                    self._add(p)
                else:
                    self.index[p] = 0
            rows = self.index[points]
        blank = rows == 0
        return rows[np.concatenate([[True], ~(blank[1:] & blank[:-1])])]

    def trigrams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Keys of a text's trigrams and how often each occurs; empty if it has no letter."""
        r = self.rows(text)
        parts = []
        for at in range(0, len(r) - 2, PIECE):
            x = r[at : at + PIECE + 2].astype(np.int64)
            parts.append(np.unique((x[:-2] << 40) | (x[1:-1] << 20) | x[2:], return_counts=True))
        return added(parts)

    def vectors(self, keys: np.ndarray) -> np.ndarray:
        """Vectors of trigrams: letters permuted by place (rolled by 2, 1 and 0) and bound."""
        mask = (1 << 20) - 1
        out = self.rolled[0][keys >> 40] * self.rolled[1][(keys >> 20) & mask]
        out *= self.letters[keys & mask]
        return out


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of several lists of them as one."""
    if len(parts) < 2:
        return parts[0] if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def bundle(texts: list[tuple[np.ndarray, np.ndarray]], space: Space) -> np.ndarray:
    """A row for each list of trigram keys and counts: the sum of their vectors."""
    keys, at = np.unique(np.concatenate([k for k, _ in texts]), return_inverse=True)
    doc = np.repeat(np.arange(len(texts)), [len(k) for k, _ in texts])
    times = np.concatenate([n for _, n in texts])
    order = np.argsort(at, kind="stable")
    at, doc, times = at[order], doc[order], times[order]
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for lo in range(0, len(keys), KEYS):
        own = slice(*np.searchsorted(at, [lo, lo + KEYS]))
        part = keys[lo : lo + KEYS]
        table = np.zeros((len(texts), len(part)), np.float32)
        table[doc[own], at[own] - lo] = times[own]
        out += table @ space.vectors(part).astype(np.float32)
    return out


def train(df: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Unit prototypes by language; the driver gets DIMENSIONS numbers for each language."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space.get()
        sums: dict[str, np.ndarray] = {}
        waiting: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def settle():
            for k, parts in waiting.items():
                keys, n = added(parts)
                for lo in range(0, len(keys), KEYS):
                    sums[k] = sums.get(k, 0) + n[lo : lo + KEYS].astype(np.float64) @ space.vectors(keys[lo : lo + KEYS])
            waiting.clear()

        for b in batches:
            for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                waiting.setdefault(k, []).append(g := space.trigrams(t))
                size += len(g[0])
                if size > 1_000_000:
                    settle()
                    size = 0
        settle()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    learn = df.select(df[text].alias("t"), df[lang].alias("k")).filter("t is not null and k is not null")
    summed = (
        learn.mapInArrow(part, "lang string, v array<double>")
        .select("lang", F.posexplode("v").alias("i", "x"))
        .groupBy("lang", "i")
        .agg(F.sum("x").alias("x"))
        .groupBy("lang")
        .agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    )
    out = {r["lang"]: np.array([x["x"] for x in r["v"]]) for r in summed.collect()}
    return {k: v / np.linalg.norm(v) for k, v in sorted(out.items()) if np.linalg.norm(v) > 0}


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", keep: list[str | Column] | None = None) -> DataFrame:
    """keep columns, lang_pred string and score double."""
    kept = df.select(*(keep or ["doc_id"]), df[text].alias("__text"))
    names, fields = list(prototypes), kept.schema[:-1]
    matrix = np.array([prototypes[k] for k in names], np.float32).T if names else None

    def group(texts: list[str | None]) -> tuple[list[str], list[float]]:
        space = Space.get()
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if matrix is None:
            return langs, scores
        waiting: list[tuple[int, tuple[np.ndarray, np.ndarray]]] = []
        size = 0

        def settle():
            docs = bundle([g for _, g in waiting], space)
            norms = np.linalg.norm(docs, axis=1)
            cosines = (docs @ matrix) / np.where(norms > 0, norms, 1)[:, None]
            for (i, _), row in zip(waiting, cosines, strict=True):
                best = int(row.argmax())
                langs[i], scores[i] = names[best], float(min(1.0, max(0.0, row[best])))
            waiting.clear()

        for i, t in enumerate(texts):
            if t and len((g := space.trigrams(t))[0]):
                waiting.append((i, g))
                size += len(g[0])
            if waiting and (len(waiting) >= GROUP or size >= GROUP_LETTERS):
                settle()
                size = 0
        if waiting:
            settle()
        return langs, scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = group(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*[f.name for f in fields], "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return kept.mapInArrow(run, f"{schema}, lang_pred string, score double")
