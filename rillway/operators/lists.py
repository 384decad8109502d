"""Lists as lengths, offsets and values, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillway.operators.sequence import running_total


def lengths(df: DataFrame, column: str, name: str = "len") -> DataFrame:
    return df.withColumn(name, F.size(column).cast("long"))


def values(df: DataFrame, keys: list[str], column: str, pos: str = "pos", value: str = "v") -> DataFrame:
    return df.select(*keys, F.posexplode(column).alias(pos, value))


#: Runs and lists are cut at multiples of GRID places, so that few meet in a join; most lists of words are within a cell.
GRID_BITS = 11
GRID = 1 << GRID_BITS


def offsets(df: DataFrame, length: str, order: list[str] | None = None, name: str = "off") -> DataFrame:
    """Where every list begins among the values of all, in that order, or without one as the rows are read."""
    return running_total(df, F.col(length), order, name)


def from_values(df: DataFrame, keys: list[str], pos: str, value: str, name: str, rows: DataFrame | None = None) -> DataFrame:
    """Lists from their values, ordered by position; rows: all keys, so that those without values get empty lists."""
    lists = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(pos, value))).alias("__l"))
    lists = lists.select(*keys, F.transform("__l", lambda x: x[value]).alias(name))
    if rows is None:
        return lists
    return rows.select(*keys).join(lists, keys, "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def from_offsets(lists: DataFrame, keys: list[str], off: str, length: str, items: DataFrame, at: str, value: str, name: str) -> DataFrame:
    """Lists from where each begins among the items of all (at: an item's place, from 0) and how long it is."""
    return from_runs(lists, keys, off, length, items.select(at, F.array(value).alias(value)), at, value, name)


def from_runs(lists: DataFrame, keys: list[str], off: str, length: str, runs: DataFrame, at: str, values: str, name: str) -> DataFrame:
    """The same from runs of items (at: the place of the first; values: an array), which need not begin or end where lists
    do.  A row of lists gives one row; a list without length is null."""
    start, size = F.col(at).cast("long"), F.size(values)
    cut = runs.filter(size > 0).select(start.alias("__start"), F.col(values).alias("__run"), _cells(start, size).alias("__cell"))
    first = F.greatest("__start", F.col("__cell") * GRID)
    pieces = cut.select("__cell", first.alias("__first"), F.slice("__run", (first - F.col("__start") + 1).cast("int"), GRID - (first - F.col("__cell") * GRID).cast("int")).alias("__piece"))
    begin, n = F.col(off).cast("long"), F.col(length).cast("long")
    told = lists.select(*keys, begin.alias("__off"), n.alias("__len"), F.monotonically_increasing_id().alias("__row"))
    cells = _ends(F.col("__off"), F.col("__len"))
    across = F.coalesce((F.col("__len") > 0) & (cells[0] < cells[1]), F.lit(False))

    def made(wanted: DataFrame, by: list[str]) -> DataFrame:
        low, end = F.greatest("__off", "__first"), F.least(F.col("__off") + F.col("__len"), F.col("__first") + F.size("__piece"))
        met = wanted.join(pieces, (wanted["__cell"] == pieces["__cell"]) & (low < end), "left")
        part = F.when(F.col("__piece").isNotNull(), F.struct(low.alias("at"), F.slice("__piece", (low - F.col("__first") + 1).cast("int"), (end - low).cast("int")).alias("part")))
        rows = met.select(*keys, wanted["__cell"], "__row", "__len", part.alias("__part")).groupBy(*by, "__row", *keys, "__len")
        parts = F.transform(F.array_sort(F.collect_list("__part")), lambda x: x["part"])
        return rows.agg(parts.alias("__parts")).select(*keys, F.when(F.col("__len").isNotNull(), F.flatten("__parts")).alias(name))

    # lists without values have a cell of their own, where no run is; those within a cell are made where it is
    own = F.when(F.col("__len") > 0, cells[0])
    inside = told.filter(~across).withColumn("__cell", F.coalesce(own, -1 - F.col("__row")))
    beyond = told.filter(across).select("*", F.explode(F.sequence(*cells)).alias("__cell"))
    return made(inside, ["__cell"]).unionByName(made(beyond, []))


def _ends(start: Column, size: Column) -> tuple[Column, Column]:
    """The first and the last cell of the grid that so many places from start on touch."""
    return F.shiftright(start, GRID_BITS), F.shiftright(start + size - 1, GRID_BITS)


def _cells(start: Column, size: Column) -> Column:
    return F.explode(F.sequence(*_ends(start, size)))


def fixed_size_view(column: str, row: Column, size: int) -> Column:
    """The row-th list of a run of values of lists of equal size."""
    return F.slice(column, row * size + 1, F.lit(size))


def characters(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, pos (from 1) and ch for every character."""
    return df.select(*keys, F.posexplode(F.split(column, "")).alias("pos", "ch")).filter(F.col("ch") != "").withColumn("pos", (F.col("pos") + 1).cast("long"))
