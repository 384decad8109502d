"""Batches of bounded rows, Arrow IPC messages of bounded bytes, and back."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rillway.functions.schema import SEQUENCE, to_arrow
from rillway.operators.parse import _plain

MAX_ROWS = 1024
MAX_BYTES = 5_232_640
INSTANTS = ["parse", "resize", "serialize"]
MESSAGE_SCHEMA = "first_seq bigint, last_seq bigint, num_rows bigint, num_bytes bigint, message binary"


def batch_of(position: Column, max_rows: int = MAX_ROWS) -> Column:
    """Number of the batch that a position falls into."""
    return F.floor(position / max_rows).cast("long")


def serialize(df: DataFrame, schema: StructType, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, resplit: bool = False, seq: str = SEQUENCE, instants: bool = False) -> DataFrame:
    """Arrow IPC messages of at most max_rows rows; seq must be the first column.

    A message over max_bytes fails, or with resplit is halved until it fits.  Where the first column is
    the sequence, the rows of a message follow each other in number without a gap.  instants: with the
    nanoseconds since 1970 at which a message's rows had been parsed, cut to size, and serialized.
    """
    arrow = to_arrow(schema)
    numbered = schema.fields[0].name == seq

    def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ends = [batch.num_rows]
        if numbered and batch.num_rows:
            n = batch.column(0).to_numpy(zero_copy_only=False)
            ends = [*(np.flatnonzero(n[1:] != n[:-1] + 1) + 1).tolist(), batch.num_rows]
        at = 0
        for end in ends:
            for lo in range(at, end, max_rows):
                yield batch.slice(lo, min(max_rows, end - lo))
            at = end

    def messages(batch: pa.RecordBatch) -> Iterator[tuple]:
        data = batch.serialize()
        if data.size > max_bytes:
            if not resplit or batch.num_rows < 2:
                raise ValueError(f"a message of {batch.num_rows} rows has {data.size} bytes, more than {max_bytes}; reduce the rows")
            half = batch.num_rows // 2
            yield from messages(batch.slice(0, half))
            yield from messages(batch.slice(half))
            return
        numbers = batch.column(0)
        yield numbers[0].as_py(), numbers[-1].as_py(), batch.num_rows, data.size, data.to_pybytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parsed = time.time_ns()
            typed = pa.Table.from_batches([b]).cast(pa.schema([pa.field(f.name, _loose(f.type)) for f in arrow]))
            whole = pa.record_batch([_fixed(c.combine_chunks(), f.type) for c, f in zip(typed.columns, arrow)], schema=arrow)
            for part in slices(whole):
                resized = time.time_ns()
                for m in messages(part):
                    row = [*m, parsed, resized, time.time_ns()] if instants else m
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=names)

    names = ["first_seq", "last_seq", "num_rows", "num_bytes", "message", *(INSTANTS if instants else [])]
    return df.select([f.name for f in schema.fields]).mapInArrow(run, MESSAGE_SCHEMA + "".join(f", {i} bigint" for i in INSTANTS) * instants)


def _loose(t: pa.DataType) -> pa.DataType:
    return pa.list_(t.value_field) if pa.types.is_fixed_size_list(t) else t


def _fixed(column: pa.Array, t: pa.DataType) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(column.flatten(), type=t) if pa.types.is_fixed_size_list(t) else column.cast(t)


def deserialize(messages: DataFrame, schema: StructType) -> DataFrame:
    """The rows of the messages."""
    arrow = to_arrow(schema)
    plain = pa.schema([pa.field(f.name, _plain(_loose(f.type)), True) for f in arrow])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for m in b.column(0):
                batch = pa.ipc.read_record_batch(pa.py_buffer(m.as_py()), arrow)
                columns = [c.cast(pa.list_(c.type.value_field)) if pa.types.is_fixed_size_list(c.type) else c for c in batch.columns]
                yield from pa.table(columns, names=arrow.names).cast(plain).to_batches()

    return messages.select("message").mapInArrow(run, StructType.fromDDL(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)))


def check_sizes(batches: DataFrame, bytes_col: str = "num_bytes", max_bytes: int = MAX_BYTES) -> DataFrame:
    """batches with ok: whether each keeps within the bytes; use failing() to stop instead."""
    return batches.withColumn("ok", F.col(bytes_col) <= max_bytes)


def failing(batches: DataFrame, bytes_col: str = "num_bytes", max_bytes: int = MAX_BYTES) -> DataFrame:
    return batches.filter(F.assert_true(F.col(bytes_col) <= max_bytes, F.lit("a message is too large; reduce the rows")).isNull())


def record_counts(messages: DataFrame) -> DataFrame:
    return messages.withColumn("num_records", F.col("last_seq") - F.col("first_seq") + 1)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as bags of rows, in equal columns, and not empty."""
    return a.columns == b.columns and a.limit(1).count() > 0 and not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()


def different_by_sequence(a: DataFrame, b: DataFrame, seq: str = SEQUENCE) -> DataFrame:
    """Numbers at which a and b differ in any column, or that only one of them has."""
    names = [c for c in a.columns if c != seq]
    x, y = (d.select(seq, F.struct(*names).alias(n)) for d, n in ((a, "x"), (b, "y")))
    return x.join(y, seq, "full").filter(~F.col("x").eqNullSafe(F.col("y"))).select(seq)
