"""Record schemas: unsigned integers, fixed-size lists, generator bounds, and Arrow conversion.

Spark has no unsigned and no fixed-size list type.  An unsigned 64-bit field is DECIMAL(20,0) with
{"unsigned": true} in its metadata, a fixed-size list an array with {"size": n}; both are enforced by
the strict parser and restored when records are encoded as Arrow messages.
"""

from __future__ import annotations

import json
from pathlib import Path

import pyarrow as pa
from pyspark.sql.types import ArrayType, BooleanType, DataType, DecimalType, LongType, StringType, StructField, StructType

U64 = DecimalType(20, 0)
U64_MAX = 2**64 - 1
SEQUENCE = "seq"


def u64(name: str, low: int | None = None, high: int | None = None) -> StructField:
    return StructField(name, U64, False, {"unsigned": True} | _bounds(low, high))


def u64_list(name: str, size: int | None = None, low: int | None = None, high: int | None = None) -> StructField:
    return StructField(name, ArrayType(U64, False), False, {"unsigned": True} | ({"size": size} if size else {}) | _bounds(low, high))


def _bounds(low: int | None, high: int | None) -> dict:
    return ({} if low is None else {"min": low}) | ({} if high is None else {"max": high})


def list_record() -> StructType:
    """A record with one list of 1 to 16 unsigned numbers (fixed values of the fixture)."""
    field = u64_list("voltage", None, 0, 2047)
    field.metadata |= {"min_length": 1, "max_length": 16}
    return StructType([field])


def wide_record() -> StructType:
    """A record of 19 fields: text, flags, numbers and fixed-size lists (fixed values of the fixture)."""
    text, flag = (lambda n: StructField(n, StringType(), False)), (lambda n: StructField(n, BooleanType(), False))
    number, numbers = (lambda n: u64(n, 1, 99)), (lambda n, size: u64_list(n, size, 1, 99))
    return StructType(
        [
            text("timestamp"), number("timezone"), number("vin"), number("odometer"), flag("hypermiling"), number("avgspeed"),
            numbers("sec_in_band", 12), numbers("miles_in_time_range", 24), numbers("const_speed_miles_in_band", 12), numbers("vary_speed_miles_in_band", 12),
            numbers("sec_decel", 10), numbers("sec_accel", 10), numbers("braking", 6), numbers("accel", 6), flag("orientation"),
            numbers("small_speed_var", 13), numbers("large_speed_var", 13), number("accel_decel"), number("speed_changes"),
        ]
    )


def with_sequence(schema: StructType) -> StructType:
    """The schema with the sequence column, which always comes first."""
    return StructType([StructField(SEQUENCE, LongType(), False), *schema.fields])


def arrow_type(field: StructField) -> pa.DataType:
    def of(t: DataType, unsigned: bool) -> pa.DataType:
        if isinstance(t, DecimalType) and unsigned:
            return pa.uint64()
        if isinstance(t, ArrayType):
            inner = pa.field("item", of(t.elementType, unsigned), t.containsNull)
            return pa.list_(inner, field.metadata["size"]) if "size" in field.metadata else pa.list_(inner)
        if isinstance(t, StructType):
            return pa.struct([pa.field(f.name, arrow_type(f), f.nullable) for f in t.fields])
        from pyspark.sql.pandas.types import to_arrow_type

        return to_arrow_type(t)

    return of(field.dataType, bool(field.metadata.get("unsigned")))


def to_arrow(schema: StructType) -> pa.Schema:
    return pa.schema([pa.field(f.name, arrow_type(f), f.nullable) for f in schema.fields])


def from_arrow(schema: pa.Schema) -> StructType:
    def field(f: pa.Field) -> StructField:
        t, meta = f.type, {}
        inner = t
        if pa.types.is_dictionary(t):
            raise TypeError(f"{f.name}: dictionary types are not supported")
        if pa.types.is_fixed_size_list(t):
            meta["size"], inner = t.list_size, t.value_type
        elif pa.types.is_list(t) or pa.types.is_large_list(t):
            inner = t.value_type
        for k, v in (f.metadata or {}).items():
            key = k.decode()
            if key.lower().rpartition("_")[2] in ("min", "max", "length"):
                name = "_".join(key.lower().split("_")[-2:]) if key.lower().endswith("length") else key.lower().rpartition("_")[2]
                meta[name] = int(v)
        if pa.types.is_uint64(inner):
            spark, meta["unsigned"] = U64, True
        elif pa.types.is_unsigned_integer(inner):
            spark = LongType()
        elif pa.types.is_struct(inner):
            spark = StructType([field(x) for x in inner])
        else:
            from pyspark.sql.pandas.types import from_arrow_type

            spark = from_arrow_type(inner, prefer_timestamp_ntz=True)
        if inner is not t:
            spark = ArrayType(spark, t.value_field.nullable)
        return StructField(f.name, spark, f.nullable, meta)

    return StructType([field(f) for f in schema])


def read_schema(path: str) -> StructType:
    """A schema from an Arrow-serialized file, or from Spark's JSON form.  OSError if there is none."""
    if not path:
        raise OSError("no schema file was given")
    data = Path(path).read_bytes()
    if data[:1] == b"{":
        return StructType.fromJson(json.loads(data))
    try:
        return from_arrow(pa.ipc.read_schema(pa.BufferReader(data)))
    except pa.ArrowInvalid as e:
        raise OSError(f"{path} holds no schema: {e}") from e


def write_schema(schema: StructType, path: str) -> None:
    Path(path).write_bytes(to_arrow(schema).serialize().to_pybytes() if path.endswith(".as") else schema.json().encode())
