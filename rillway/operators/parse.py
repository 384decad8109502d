"""JSON text to typed columns.

strict (default): exactly one object per line, every field there and of its type, none besides.  A
record that isn't so fails the query.  lenient: further keys are ignored.  quarantine: invalid
records stay, with `valid` false and null fields.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from decimal import Decimal
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DecimalType, StringType, StructField, StructType

from rillway.functions.schema import U64_MAX, to_arrow

MODES = ("strict", "lenient", "quarantine")


def _field_ok(f: StructField, value: Column, item: Column) -> Column:
    """The field is there, and the text had its type; item: the field as VARIANT."""
    seen = F.schema_of_variant(item)
    ok = F.lit(True) if f.nullable else value.isNotNull()
    kind = f.dataType
    if isinstance(kind, StringType):
        ok &= value.isNull() | (seen == "STRING")
    elif isinstance(kind, BooleanType):
        ok &= value.isNull() | (seen == "BOOLEAN")
    elif isinstance(kind, DecimalType) and f.metadata.get("unsigned"):
        ok &= value.isNull() | ((value >= 0) & (value <= F.lit(Decimal(U64_MAX))) & ((seen == "BIGINT") | (seen.rlike(r"^DECIMAL\((19|20),0\)$") & (value >= F.lit(Decimal(2**63))))))
    elif isinstance(kind, ArrayType):
        items = ~F.exists(value, lambda x: x.isNull()) if not kind.containsNull else F.lit(True)
        if f.metadata.get("unsigned"):
            items &= F.forall(value, lambda x: (x >= 0) & (x <= F.lit(Decimal(U64_MAX)))) & seen.rlike(r"^ARRAY<(VOID|BIGINT|DECIMAL\(\d+,0\))>$")
        if "size" in f.metadata:
            items &= F.size(value) == f.metadata["size"]
        ok &= value.isNull() | items
    return ok


def _nullable(t):
    """The type with nulls allowed everywhere, as a VARIANT is read."""
    if isinstance(t, StructType):
        return StructType([StructField(f.name, _nullable(f.dataType)) for f in t.fields])
    return ArrayType(_nullable(t.elementType)) if isinstance(t, ArrayType) else t


def _shape(schema: StructType) -> str | None:
    """Pattern of a VARIANT's schema that holds exactly these fields with small numbers; None where there is none."""
    parts = []
    for f in schema.fields:
        unsigned = f.metadata.get("unsigned")
        if f.nullable or not re.fullmatch(r"\w+", f.name, re.ASCII):
            return None
        if isinstance(f.dataType, StringType):
            parts.append((f.name, "STRING"))
        elif isinstance(f.dataType, BooleanType):
            parts.append((f.name, "BOOLEAN"))
        elif isinstance(f.dataType, DecimalType) and unsigned:
            parts.append((f.name, "BIGINT"))
        elif isinstance(f.dataType, ArrayType) and unsigned:
            parts.append((f.name, "ARRAY<(VOID|BIGINT)>"))
        else:
            return None
    return "^ARRAY<OBJECT<" + ", ".join(f"{n}: {t}" for n, t in sorted(parts)) + ">>$"


def _in_shape(schema: StructType, fields: dict[str, Column], variant: Column) -> Column:
    """What the shape of a record leaves open: signs, lengths, nulls in lists, a second object."""
    ok = F.try_variant_get(variant, "$[1]", "variant").isNull()
    for f in schema.fields:
        if isinstance(f.dataType, DecimalType):
            ok &= fields[f.name] >= 0
        elif isinstance(f.dataType, ArrayType):
            ok &= F.forall(fields[f.name], lambda x: F.coalesce(x >= 0, F.lit(False)))
            if "size" in f.metadata:
                ok &= F.size(fields[f.name]) == f.metadata["size"]
    return ok


def _get(variant: Column, f: StructField, kind: str) -> Column:
    return F.try_variant_get(variant, f"$[0]['{f.name}']", kind)


def validity(schema: StructType, mode: str, variant: Column, fields: dict[str, Column]) -> Column:
    """Whether the line is a valid record; variant: the line, parsed, in an array; fields: what it holds."""
    # one object, and nothing after it; null for broken text, repeated keys and what follows an object
    valid = F.schema_of_variant(variant).startswith("ARRAY<OBJECT<") & F.try_variant_get(variant, "$[1]", "variant").isNull()
    items = {f.name: _get(variant, f, "variant") for f in schema.fields}
    if mode != "lenient":
        there = reduce(Column.__add__, [i.isNotNull().cast("int") for i in items.values()], F.lit(0))
        valid &= F.size(F.map_keys(F.try_variant_get(variant, "$[0]", "map<string,variant>"))) == there
    for f in schema.fields:
        valid &= _field_ok(f, fields[f.name], items[f.name])
    if mode != "lenient" and (shape := _shape(schema)):
        # one look at the schema settles most records; field by field go those with large numbers, or faults
        valid = F.when(F.schema_of_variant(variant).rlike(shape), _in_shape(schema, fields, variant)).otherwise(valid)
    return F.coalesce(valid, F.lit(False))


def parse_records(df: DataFrame, schema: StructType, mode: str = "strict", value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep columns and the schema's fields of every record; blank lines are skipped."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    lines = df.filter(F.length(F.trim(F.col(value))) > 0)
    # the text is parsed once: what is generated is a column, which the optimizer can't replace by its expression
    # wherever it is used.  Names that start with __ are taken.
    line = F.try_parse_json(F.concat(F.lit("["), F.col(value), F.lit("]")))
    made = lines.select(*keep, F.col(value).alias("__value"), F.explode(F.array(line)).alias("__line"))
    got = F.struct(*[_get(F.col("__line"), f, _nullable(f.dataType).simpleString()).alias(f.name) for f in schema.fields])
    made = made.select("*", F.explode(F.array(got)).alias("__got"))
    fields = {f.name: F.col("__got").getField(f.name) for f in schema.fields}
    valid = validity(schema, mode, F.col("__line"), fields)
    if mode == "quarantine":
        out = made.select(*keep, F.col("__value").alias(value), valid.alias("valid"), *[c.alias(f"__{n}") for n, c in fields.items()])
        return out.select(*keep, value, "valid", *[F.when(F.col("valid"), F.col(f"`__{n}`")).alias(n) for n in fields])
    error = F.raise_error(F.concat(F.lit("not a valid record: "), F.substring(F.col("__value"), 1, 200)))
    # generated as well: as a filter, the condition would be carried through every join above
    sound = made.select(*keep, F.explode(F.array(F.when(valid, F.col("__got")).otherwise(error))).alias("__record"))
    return sound.select(*keep, *[F.col("__record").getField(f.name).alias(f.name) for f in schema.fields])


def parse_with_arrow(df: DataFrame, schema: StructType, mode: str = "strict", value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """The same as parse_records in strict and lenient mode, by pyarrow's JSON reader on Arrow batches; fixed-size lists are
    read as lists and checked."""
    import pyarrow.json as pj

    if mode not in ("strict", "lenient"):
        raise ValueError("the Arrow parser is strict or lenient")
    loose = pa.schema([pa.field(f.name, pa.list_(f.type.value_field) if pa.types.is_fixed_size_list(f.type) else f.type, f.nullable) for f in to_arrow(schema)])
    sizes = {f.name: f.metadata["size"] for f in schema.fields if "size" in f.metadata}
    spark_arrow = pa.schema([pa.field(f.name, _plain(f.type), f.nullable) for f in loose])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            there = pa.array([x is not None and bool(x.strip()) for x in texts], pa.bool_())
            kept = b.filter(there)
            lines = kept.column(0).to_pylist()
            if not lines:
                continue
            data = "\n".join(lines).encode()
            options = pj.ParseOptions(explicit_schema=loose, unexpected_field_behavior="error" if mode == "strict" else "ignore")
            table = pj.read_json(pa.BufferReader(data), pj.ReadOptions(use_threads=False, block_size=max(1 << 20, 2 * len(data))), options)
            for name, n in sizes.items():
                if any(x is not None and len(x) != n for x in table.column(name).to_pylist()):
                    raise ValueError(f"{name}: a list does not have {n} items")
            if len(table) != len(lines):
                raise ValueError(f"{len(lines)} lines gave {len(table)} records")
            columns = [*kept.columns[1:], *table.cast(spark_arrow).columns]
            yield from pa.table(columns, names=[*keep, *loose.names]).to_batches()

    rows = df.select(value, *keep)
    return rows.mapInArrow(run, StructType([*rows.schema.fields[1:], *[StructField(f.name, f.dataType, True, f.metadata) for f in schema.fields]]))


def _plain(t: pa.DataType) -> pa.DataType:
    """Arrow type that Spark takes in."""
    if pa.types.is_uint64(t):
        return pa.decimal128(20, 0)
    if pa.types.is_list(t):
        return pa.list_(_plain(t.value_type))
    return t


#: Parsers by name; register another with PARSERS[name] = function(df, schema, **options).
PARSERS: dict[str, Callable[..., DataFrame]] = {"catalyst": parse_records, "arrow": parse_with_arrow}


def parser(name: str) -> Callable[..., DataFrame]:
    try:
        return PARSERS[name.lower()]
    except KeyError:
        raise ValueError(f"unknown parser {name}; there are {sorted(PARSERS)}") from None


def flatten(df: DataFrame, separator: str = "_") -> DataFrame:
    """Nested structs as columns named by their path."""

    def of(fields, path: list[str]):
        for f in fields:
            if isinstance(f.dataType, StructType):
                yield from of(f.dataType.fields, [*path, f.name])
            else:
                yield F.col(".".join(f"`{p}`" for p in [*path, f.name])).alias(separator.join([*path, f.name]))

    return df.select(*of(df.schema.fields, []))


def byte_to_boolean(column: str) -> Column:
    return F.col(column) != 0


def drop_empty(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull())


def record_text(df: DataFrame) -> DataFrame:
    """`text`: a line `name : value` for every field, lists as [a,b]."""
    shown = [F.concat(F.lit("["), F.array_join(F.col(f.name).cast("array<string>"), ","), F.lit("]")) if isinstance(f.dataType, ArrayType) else F.col(f.name).cast("string") for f in df.schema.fields]
    return df.select(F.concat_ws("\n", *[F.concat(F.lit(f"{f.name} : "), F.coalesce(s, F.lit("null"))) for f, s in zip(df.schema.fields, shown)]).alias("text"))
