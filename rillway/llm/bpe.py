"""Byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches.

A text is cut into the pre-tokens of a pattern, each pre-token's UTF-8 bytes are mapped to the
printable characters of the byte-level alphabet, and the BPE model of the tokenizers library merges
them.  Decoding reverses the byte table token by token and concatenates the bytes, so that a
character split over several tokens comes back whole; a sequence that ends inside a character is
replaced only when text is asked for.

Defined cases: a null text counts as empty and gets no ids; null ids decode to empty; unknown ids
raise.  Strings of special tokens are ordinary text.  Row order, repeated rows and further columns
(whatever their names) do not matter: only the named columns are read.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

#: Entries of the per-process cache; it is emptied when full, which costs time only.
CACHE_ENTRIES = 400_000


def byte_table() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, others follow 255."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return {b: chr(b if b in kept else next(spare)) for b in range(256)}


class ByteBPE:
    """Encoder and decoder for one vocabulary; use ByteBPE.load(), which keeps one per process."""

    def __init__(self, vocabulary: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        self._model = tokenizer.model
        self._tokenizer = tokenizer
        self._find = regex.compile(pattern).findall
        self._to_chars = byte_table()
        back = {ord(c): b for b, c in self._to_chars.items()}
        self.token_bytes: dict[int, bytes] = {}
        special = {t for t, x in tokenizer.get_added_tokens_decoder().items()}
        for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
            if i not in special:
                self.token_bytes[i] = bytes(back[ord(c)] for c in token)
        self.token_text = {i: str(i) for i in self.token_bytes}
        self._pieces: dict[str, tuple[int, ...] | None] = {}

    @staticmethod
    @lru_cache(maxsize=4)
    def load(vocabulary: str, pattern: str) -> "ByteBPE":
        return ByteBPE(vocabulary, pattern)

    def _merge(self, text: str) -> tuple[int, ...]:
        chars = self._to_chars
        out: list[int] = []
        for pre in self._find(text):
            # the mapping gives one character per byte
            out += [t.id for t in self._model.tokenize(pre.encode("utf-8").decode("latin-1").translate(chars))]
        return tuple(out)

    def _piece(self, piece: str) -> tuple[int, ...] | None:
        """Ids of a blank and a piece; None if the piece does not stand alone."""
        if len(self._pieces) >= CACHE_ENTRIES:
            self._pieces.clear()
        ids = None if not piece or piece[0].isspace() or piece[-1].isspace() else self._merge(" " + piece)
        self._pieces[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text.

        A single blank between two non-blanks always starts a pre-token, so the pieces between such
        blanks are encoded independently and kept in a cache; any other white space at the edge of
        a piece sends the whole text through the pattern at once.
        """
        if not text:
            return []
        first, *rest = text.split(" ")
        if not first or first[0].isspace() or first[-1].isspace():
            return list(self._merge(text))
        known = self._pieces
        parts = [known[p] if p in known else self._piece(p) for p in rest]
        if None in parts:
            return list(self._merge(text))
        return [*self._merge(first), *chain.from_iterable(parts)]

    def offsets(self, ids: list[int]) -> list[int]:
        """Byte offset at which each token starts, and the length at the end."""
        at, out = 0, [0]
        for i in ids:
            at += len(self.token_bytes[i])
            out.append(at)
        return out

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


def _mapped(df: DataFrame, column: str, fn: Callable, schema: str, keep: list[str], out: list[str]) -> DataFrame:
    """mapInArrow over the kept columns and one more, with fn(list of values) -> list of columns."""
    kept = df.select(*[df[c] for c in keep], df[column].alias("__value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                made = fn(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=[*keep, *out])

    kept_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1])
    return kept.mapInArrow(run, f"{kept_schema}, {schema}" if keep else schema)


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, ids array<int>, offsets array<int> (byte offsets, one more than ids)."""

    def fn(texts):
        codec = ByteBPE.load(vocabulary, pattern)
        ids = [codec.encode(t) for t in texts]
        return [pa.array(ids, pa.list_(pa.int32())), pa.array([codec.offsets(i) for i in ids], pa.list_(pa.int32()))]

    return _mapped(df, text, fn, "ids array<int>, offsets array<int>", list(keep), ["ids", "offsets"])


def decode(df: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns and text string; broken sequences of bytes become U+FFFD."""

    def fn(rows):
        codec = ByteBPE.load(vocabulary, pattern)
        return [pa.array([codec.decode(r or []) for r in rows], pa.string())]

    return _mapped(df, ids, fn, "text string", list(keep), ["text"])


def round_trip_digests(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = False) -> DataFrame:
    """keep columns, n_tokens, ids_sha256, decoded_sha256, and the ids where asked for: encode and
    decode in one pass, without sending ids through the JVM in between."""

    def fn(texts):
        from hashlib import sha256

        codec = ByteBPE.load(vocabulary, pattern)
        counts, a, b, all_ids = [], [], [], []
        for t in texts:
            found = codec.encode(t)
            counts.append(len(found))
            a.append(sha256(" ".join(map(codec.token_text.__getitem__, found)).encode("ascii")).hexdigest())
            b.append(sha256(codec.decode_bytes(found)).hexdigest())
            if ids:
                all_ids.append(pa.array(found, pa.int32()))
        made = [pa.array(counts, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
        return made + [pa.array([x.to_numpy() for x in all_ids], pa.list_(pa.int32()))] * ids

    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return _mapped(df, text, fn, schema, list(keep), ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids)
