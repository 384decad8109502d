"""Several sources as one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillway.operators.sequence import add_sequence, place_within


def merge_sources(sources: list[DataFrame], tag: str = "source") -> DataFrame:
    """All rows, tagged with the place of their source in the list."""
    return reduce(DataFrame.unionByName, [d.withColumn(tag, F.lit(i)) for i, d in enumerate(sources)])


def round_robin(df: DataFrame, source: str, order: str, name: str = "out_pos") -> DataFrame:
    """Rows of the sources in turn, as if each were always ready; numbered from 0."""
    return add_sequence(place_within(df, [source], [order], "__turn"), ["__turn", source], name=name).drop("__turn")


def worst_case_receive(df: DataFrame, received: str, by: list[str] | None = None, name: str = "received") -> DataFrame:
    """The earliest receive time among merged buffers."""
    return df.groupBy(*(by or [])).agg(F.min(received).alias(name))
