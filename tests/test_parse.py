"""The strictness of the parser, case by case, and the two parsers against each other."""

import pytest
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from rillway.functions.schema import list_record, u64, u64_list, wide_record
from rillway.operators.parse import parse_records, parse_with_arrow, parser
from rillway.sources.generator import json_records

V = StructType([u64("v")])
CASES = [
    ('{"v": 18446744073709551615}', True),
    ('{"v": 9223372036854775808}', True),
    ('{"v": 0}', True),
    ('{"v": -1}', False),
    ('{"v": 18446744073709551616}', False),
    ('{"v": 1.5}', False),
    ('{"v": 1.0}', False),
    ('{"v": 1, "x": 2}', False),
    ('{"V": 1}', False),
    ("{}", False),
    ('{"v": null}', False),
    ('{"v": "1"}', False),
    ('{"v": 1, "v": 2}', False),
    ('{"v": 1', False),
    ('{"v": 1}{"v": 2}', False),
    ('{"v": 1},{"v": 2}', False),
    ("[1]", False),
]


def test_strictness(spark):
    lines = spark.createDataFrame([(x,) for x, _ in CASES], "value string")
    got = {r["value"]: r["valid"] for r in parse_records(lines, V, "quarantine").collect()}
    assert got == dict(CASES)


def test_other_types(spark):
    schema = StructType([StructField("t", StringType(), False), StructField("b", BooleanType(), False), u64_list("l"), u64_list("f", 2)])
    cases = {
        '{"t": "x", "b": true, "l": [1], "f": [1, 2]}': True,
        '{"t": "x", "b": true, "l": [], "f": [1, 2]}': True,
        '{"t": 1, "b": true, "l": [1], "f": [1, 2]}': False,
        '{"t": "x", "b": "true", "l": [1], "f": [1, 2]}': False,
        '{"t": "x", "b": true, "l": [1, null], "f": [1, 2]}': False,
        '{"t": "x", "b": true, "l": [-1], "f": [1, 2]}': False,
        '{"t": "x", "b": true, "l": [1], "f": [1, 2, 3]}': False,
    }
    lines = spark.createDataFrame([(x,) for x in cases], "value string")
    assert {r["value"]: r["valid"] for r in parse_records(lines, schema, "quarantine").collect()} == cases


def test_strict_fails_and_lenient_passes(spark):
    lines = spark.createDataFrame([('{"v": 1, "x": 2}',), ("   ",)], "value string")
    with pytest.raises(Exception, match="not a valid record"):
        parse_records(lines, V).collect()
    assert [int(r["v"]) for r in parse_records(lines, V, "lenient").collect()] == [1]
    with pytest.raises(ValueError):
        parse_records(lines, V, "loose")


@pytest.mark.parametrize("schema", [list_record(), wide_record()])
def test_parsers_agree_on_generated_records(spark, schema):
    lines = json_records(spark, 300, schema, seed=0)
    a, b = parse_records(lines, schema), parser("ARROW")(lines, schema)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert a.count() == 300


def test_arrow_parser_rejects_extra_keys(spark):
    with pytest.raises(Exception):
        parse_with_arrow(spark.createDataFrame([('{"v": 1, "x": 2}',)], "value string"), V).collect()
