"""Sequence numbers and running totals without a single-partition window.

A range exchange makes a global order; each partition numbers its own rows as it writes them out, and the
partitions' totals (one row each) shift them.  There is no second exchange of the rows, and no window per key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rillway.functions.schema import SEQUENCE
from rillway.tables import written_out


#: monotonically_increasing_id has the partition above this bit and the row's place in it below.
PLACE_BITS = 33


def _ordered(df: DataFrame, order: list[str | Column]) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def _shifted(table: DataFrame, names: list[str], before: Column, name: str) -> DataFrame:
    """table (names, __part, __n, __upto) with before plus the totals of the partitions before."""
    totals = table.groupBy("__part").agg(F.sum("__n").alias("__sum"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    shifts = totals.select("__part", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__shift"))
    return table.join(F.broadcast(shifts), "__part").select(*names, (F.col("__shift") + before).cast("long").alias(name))


def running_total(df: DataFrame, amount: Column, order: list[str | Column] | None, name: str, inclusive: bool = False) -> DataFrame:
    """df with the sum of amount over the rows before (with inclusive: up to) each, in that order; without one, as the
    rows are read, and they aren't exchanged."""
    ordered = df.withColumn("__n", amount.cast("long"))
    ordered = _ordered(ordered, order) if order else ordered

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            n = pc.fill_null(b.column(b.num_columns - 2), 0)
            upto = pc.add(pc.cumulative_sum(n), total)
            total = upto[-1].as_py() if len(upto) else total
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], n, b.column(b.num_columns - 1), upto], names=[*b.schema.names, "__upto"])

    ordered = ordered.withColumn("__part", F.spark_partition_id())
    made = ordered.mapInArrow(run, StructType([*ordered.schema, StructField("__upto", LongType())]))
    table = written_out(made, "totals")
    return _shifted(table, df.columns, F.col("__upto") - (F.lit(0) if inclusive else F.col("__n")), name)


def add_sequence(df: DataFrame, order: list[str | Column], start: int = 0, name: str = SEQUENCE) -> DataFrame:
    """The sequence column first, then df's; numbers from start on, in that order, without gaps."""
    at = F.monotonically_increasing_id()
    table = _ordered(df, order).select(*df.columns, F.lit(1).cast("long").alias("__n"), F.shiftright(at, PLACE_BITS).alias("__part"), at.bitwiseAND((1 << PLACE_BITS) - 1).alias("__upto"))
    numbered = _shifted(written_out(table, "sequence"), df.columns, F.col("__upto") + start, "__seq")
    return numbered.select(F.col("__seq").alias(name), *df.columns)


def place_within(df: DataFrame, keys: list[str], order: list[str | Column], name: str) -> DataFrame:
    """df with each row's place (from 0) among the rows of its keys: its number in the order of keys and
    order, less that of the first row of its keys.  A key may hold any share of the rows."""
    numbered = add_sequence(df, [*keys, *order], name="__number")
    first = numbered.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min("__number").alias("__first"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return numbered.join(first, same).select(*df.columns, (F.col("__number") - F.col("__first")).alias(name))


def tag_to_sequence(df: DataFrame, tag: str, order: str, first: DataFrame, name: str = SEQUENCE) -> DataFrame:
    """Rows tagged by their source get that source's first number plus their place in it; first: (tag,
    first_seq), one row per source."""
    return place_within(df, [tag], [order], "__place").join(first, tag).select(*df.columns, (F.col("first_seq") + F.col("__place")).cast("long").alias(name))


def buffer_of(seq: Column, total: int, buffers: int) -> Column:
    """Buffer of a record: an equal number for each, and the remainder to the first."""
    each, rest = divmod(total, buffers)
    if not each:
        return F.lit(0)
    first = each + rest
    return F.when(seq < first, F.lit(0)).otherwise(1 + F.floor((seq - first) / each)).cast("int")


def sequence_ranges(df: DataFrame, by: list[str], seq: str = SEQUENCE) -> DataFrame:
    """first_seq, last_seq and num_rows of every group."""
    return df.groupBy(*by).agg(F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"), F.count("*").alias("num_rows"))
