"""Random records of a schema as JSON text, within the bounds in the fields' metadata."""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, NumericType, StringType, StructField, StructType

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _uniform(name: str, seed: int, *parts: Column) -> Column:
    """A number in [0, 1) that depends on the record, the field and the seed only."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(crc32(name.encode())), F.col("seq"), *parts), F.lit(1 << 30)) / float(1 << 30)


def _number(name: str, f: StructField, seed: int, *parts: Column) -> Column:
    low, high = f.metadata.get("min", 0), f.metadata.get("max", 2**31 - 1)
    return (F.floor(_uniform(name, seed, *parts) * (high - low + 1)) + low).cast("decimal(20,0)")


def _value(f: StructField, seed: int) -> Column:
    t, meta = f.dataType, f.metadata
    if isinstance(t, ArrayType):
        low, high = (meta["size"],) * 2 if "size" in meta else (meta.get("min_length", 0), meta.get("max_length", 16))
        n = (F.floor(_uniform(f.name + "#", seed) * (high - low + 1)) + low).cast("int")
        return F.transform(F.filter(F.sequence(F.lit(1), F.lit(max(high, 1))), lambda i: i <= n), lambda i: _number(f.name, f, seed, i))
    if isinstance(t, BooleanType):
        return _uniform(f.name, seed) < 0.5
    if isinstance(t, StringType):
        if f.name == "timestamp":
            return F.date_format(F.timestamp_seconds(F.lit(1_600_000_000) + F.floor(_uniform(f.name, seed) * 10**8)), "yyyy-MM-dd'T'HH:mm:ssXXX")
        low, high = meta.get("min_length", 1), meta.get("max_length", 16)
        n = (F.floor(_uniform(f.name + "#", seed) * (high - low + 1)) + low).cast("int")
        return F.substring(F.translate(F.sha2(F.concat_ws(":", F.lit(f.name), F.lit(str(seed)), F.col("seq")), 512), "0123456789", LETTERS[10:20]), F.lit(1), n)
    if isinstance(t, StructType):
        return F.struct(*[_value(StructField(x.name, x.dataType, x.nullable, x.metadata), seed).alias(x.name) for x in t.fields])
    if isinstance(t, NumericType):
        return _number(f.name, f, seed).cast(t)
    raise TypeError(f"{f.name}: no values of {t.simpleString()} can be made")


def json_records(spark: SparkSession, count: int, schema: StructType, seed: int = 0) -> DataFrame:
    """seq from 0 on, and value: the record as JSON text.  The same for any partitioning."""
    rows = spark.range(count).withColumnRenamed("id", "seq")
    return rows.select("seq", F.to_json(F.struct(*[_value(f, seed).alias(f.name) for f in schema.fields])).alias("value"))
