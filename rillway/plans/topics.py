"""Queries of schema files, topics, messages, streams and comparison."""

from __future__ import annotations

import tempfile
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from rillway import tables
from rillway.functions.schema import read_schema, to_arrow, u64, u64_list, wide_record, with_sequence, write_schema
from rillway.operators import batching, merge, metrics, parse, sequence
from rillway.plans.catalogue import PROPS, query
from rillway.plans.catalogue import table as _t
from rillway.sources.lines import record_batch_file, text_files, text_stream, without_blank_lines
from rillway.streaming import ingest
from rillway.streaming.topic import SchemaMismatch, Topic

_SEQ = "(SELECT *, CAST(props->>'k' AS BIGINT) AS k, row_number() OVER (ORDER BY event_id) - 1 AS seq FROM events)"


def _events(spark, sf_dir) -> DataFrame:
    """seq, event_id, k."""
    k = F.get_json_object("props", "$.k").cast("long").alias("k")
    return sequence.add_sequence(_t(spark, sf_dir, "events").select("event_id", k), ["event_id"])


_DESCRIBED = ["region", "nation", "orders", "lineitem", "events", "embeddings"]
_TYPES = "CASE column_type WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' ELSE lower(column_type) END"


@query(" UNION ALL ".join(f"SELECT '{t}' AS tab, '{form}' AS form, column_name AS field, {_TYPES} AS type FROM (DESCRIBE SELECT * FROM {t})" for t in _DESCRIBED for form in ("as", "json")))
def schema_files(spark, sf_dir):
    """Schemas written as files of both forms and read again; a table's schema is small and the driver's."""
    rows = []
    with tempfile.TemporaryDirectory() as d:
        for name in _DESCRIBED:
            for form in ("as", "json"):
                path = f"{d}/{name}.{form}"
                write_schema(_t(spark, sf_dir, name).schema, path)
                rows += [(name, form, f.name, f.dataType.simpleString()) for f in read_schema(path).fields]
    return spark.createDataFrame(rows, "tab string, form string, field string, type string")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def record_batch(spark, sf_dir):
    """An Arrow file of one batch; nation has 25 rows at every scale."""
    rows = _t(spark, sf_dir, "nation")
    with tempfile.TemporaryDirectory() as d:
        whole = rows.toArrow().combine_chunks()
        with pa.ipc.new_file(Path(d) / "nation.arrow", whole.schema) as f:
            f.write_batch(whole.to_batches()[0])
        return record_batch_file(spark, f"{d}/nation.arrow")


@query(f"SELECT seq, event_id, k FROM {_SEQ}")
def topic_records(spark, sf_dir):
    """Published messages, read again by the schema that the topic holds."""
    rows, path = _events(spark, sf_dir), tables.scratch(spark, "topic")
    Topic(spark, path, rows.schema).publish(batching.serialize(rows, rows.schema, max_rows=100), per_file=2)
    stored = Topic.stored_schema(spark, path)
    return batching.deserialize(Topic(spark, path, stored).messages(), stored)


_SHAPES = ", ".join(f"('{t}', (SELECT string_agg(column_name || column_type, ',') FROM (DESCRIBE SELECT * FROM {t})))" for t in ("region", "nation", "events"))


@query(f"WITH s(tab, shape) AS (VALUES {_SHAPES}) SELECT a.tab AS stored, b.tab AS sent, a.shape = b.shape AS accepted FROM s a, s b")
def schema_handshake(spark, sf_dir):
    schemas, rows = {t: _t(spark, sf_dir, t).schema for t in ("region", "nation", "events")}, []
    for stored, schema in schemas.items():
        path = tables.scratch(spark, "topic")
        Topic(spark, path, schema)
        for sent, other in schemas.items():
            try:
                Topic(spark, path, other)
                rows.append((stored, sent, True))
            except SchemaMismatch:
                rows.append((stored, sent, False))
    return spark.createDataFrame(rows, "stored string, sent string, accepted boolean")


@query(f"SELECT seq, TRUE AS counted FROM {_SEQ}")
def message_record_counts(spark, sf_dir):
    """The numbers that the messages claim: each once, and as many as rows."""
    rows = _events(spark, sf_dir)
    counted = batching.record_counts(batching.serialize(rows, rows.schema, max_rows=64))
    return counted.select(F.explode(F.sequence("first_seq", "last_seq")).alias("seq"), (F.col("num_records") == F.col("num_rows")).alias("counted"))


@query(f"SELECT seq, event_id, k FROM {_SEQ}")
def resplit_messages(spark, sf_dir):
    """Rows of the messages that keep within 2000 bytes; they are halved until all do."""
    rows = _events(spark, sf_dir)
    messages = batching.serialize(rows, rows.schema, max_bytes=2000, resplit=True)
    return batching.deserialize(messages.filter("num_bytes <= 2000"), rows.schema)


@query(f"SELECT seq, TRUE AS in_order FROM {_SEQ}")
def message_instants(spark, sf_dir):
    """Every row's message was parsed, cut to size and serialized in this order."""
    rows = _events(spark, sf_dir)
    messages = batching.serialize(rows, rows.schema, max_rows=100, instants=True)
    return messages.select(F.explode(F.sequence("first_seq", "last_seq")).alias("seq"), F.expr("0 < parse AND parse <= resize AND resize <= serialize").alias("in_order"))


def _changed(rows: DataFrame) -> DataFrame:
    return rows.filter("event_id % 17 != 0").withColumn("k", F.expr("CASE WHEN event_id % 13 = 0 THEN k + 1 ELSE k END"))


_CHANGED = "SELECT seq, event_id, CASE WHEN event_id % 13 = 0 THEN k + 1 ELSE k END AS k FROM s WHERE event_id % 17 <> 0"


@query(f"SELECT seq FROM {_SEQ} WHERE event_id % 17 = 0 OR (event_id % 13 = 0 AND k IS NOT NULL)")
def compare_by_sequence(spark, sf_dir):
    rows = _events(spark, sf_dir)
    return batching.different_by_sequence(rows, _changed(rows))


_CASES = {"itself": "SELECT seq, event_id, k FROM s", "changed": _CHANGED, "twice": "SELECT seq, event_id, k FROM s UNION ALL SELECT seq, event_id, k FROM s", "nothing": "SELECT seq, event_id, k FROM s WHERE FALSE"}


@query(
    f"WITH s AS (FROM {_SEQ}) "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS other, NOT EXISTS ((SELECT seq, event_id, k FROM s) EXCEPT ALL ({q})) AND NOT EXISTS (({q}) EXCEPT ALL (SELECT seq, event_id, k FROM s)) AS same" for n, q in _CASES.items()
    )
)
def compare_rows(spark, sf_dir):
    rows = tables.written_out(_events(spark, sf_dir), "compared")
    others = {"itself": rows.repartition(5), "changed": _changed(rows), "twice": rows.union(rows), "nothing": rows.limit(0)}
    return spark.createDataFrame([(n, batching.same_rows(rows, other)) for n, other in others.items()], "other string, same boolean")


def _pairs(df: DataFrame, schema: StructType, mode: str = "strict", value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """A parser of one's own: the field's number from the text after the last blank."""
    return df.select(*keep, *[F.regexp_extract(value, r"(\d+)\}$", 1).cast(f.dataType).alias(f.name) for f in schema.fields])


@query(" UNION ALL ".join(f"SELECT '{p}' AS parser, event_id, CAST(props->>'k' AS BIGINT) AS k FROM events" for p in ("arrow", "catalyst", "own")))
def parser_registry(spark, sf_dir):
    lines = _t(spark, sf_dir, "events").select("event_id", F.col("props").alias("value"))
    parse.PARSERS["own"] = _pairs
    try:
        each = [parse.parser(n)(lines, PROPS, keep=("event_id",)).select(F.lit(n).alias("parser"), "event_id", F.col("k").cast("long").alias("k")) for n in sorted(parse.PARSERS)]
    finally:
        del parse.PARSERS["own"]
    return reduce(DataFrame.unionAll, each)


@query("SELECT CAST(s.source AS INTEGER) AS source, count(e.event_id) AS records, CAST(coalesce(sum(CAST(props->>'k' AS BIGINT)), 0) AS BIGINT) AS sum_k FROM range(4) s(source) LEFT JOIN events e ON e.user_id % 4 = s.source AND s.source IN (0, 3) GROUP BY 1")
def parser_enable(spark, sf_dir):
    """Parsers 1 and 2 of four get no line, and report zeros."""
    lines = _t(spark, sf_dir, "events").select("user_id", F.col("props").alias("value"))
    own = [parse.parse_records(lines.filter((F.col("user_id") % 4 == i) & F.lit(i in (0, 3))), PROPS) for i in range(4)]
    each = [d.agg(F.count("*").alias("records"), F.coalesce(F.sum(F.col("k").cast("long")), F.lit(0)).alias("sum_k")) for d in own]
    return merge.merge_sources(each)


_LISTS = {f.name: f.metadata["size"] for f in wide_record().fields if "size" in f.metadata}
_NUMBERS = ["timezone", "vin", "odometer", "avgspeed", "accel_decel", "speed_changes"]
_19_SQL = ", ".join(
    [
        *[f"o_orderkey * {i + 3} % 99 + 1 AS {n}" for i, n in enumerate(_NUMBERS)],
        *[f"CAST(list_sum(list_transform(range(1, {size + 1}), lambda i: o_orderkey * i % 99 + 1)) AS BIGINT) AS {n}" for n, size in _LISTS.items()],
    ]
)


@query(f"SELECT strftime(o_orderdate, '%Y-%m-%d') AS timestamp, o_orderkey % 2 = 0 AS hypermiling, o_custkey % 2 = 0 AS orientation, {_19_SQL} FROM orders")
def parse_record_of_19_fields(spark, sf_dir):
    """Text, flags, numbers and fixed-size lists, which come back as sums."""
    schema, key = wide_record(), F.col("o_orderkey")
    items = lambda n: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: key * i % 99 + 1)
    made = {"timestamp": F.date_format("o_orderdate", "yyyy-MM-dd"), "hypermiling": key % 2 == 0, "orientation": F.col("o_custkey") % 2 == 0}
    made |= {n: key * (i + 3) % 99 + 1 for i, n in enumerate(_NUMBERS)}
    made |= {n: items(size) for n, size in _LISTS.items()}
    lines = _t(spark, sf_dir, "orders").select(F.to_json(F.struct(*[made[f.name].alias(f.name) for f in schema.fields])).alias("value"))
    parsed = parse.parse_records(lines, schema)
    total = lambda n: F.aggregate(n, F.lit(0).cast("long"), lambda s, x: s + x.cast("long")).alias(n)
    numbers = [F.col(n).cast("long").alias(n) for n in _NUMBERS]
    return parsed.select("timestamp", "hypermiling", "orientation", *numbers, *map(total, _LISTS))


@query("SELECT event_id, event_id AS k FROM events WHERE event_id % 3 = 2")
def blank_lines(spark, sf_dir):
    """Two of three lines are blank."""
    made = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, "  ").otherwise(F.to_json(F.struct(F.col("event_id").alias("k"))))
    lines = without_blank_lines(_t(spark, sf_dir, "events").select("event_id", made.alias("value")))
    return parse.parse_records(lines, PROPS, keep=("event_id",)).select("event_id", F.col("k").cast("long").alias("k"))


def _as_files(spark, sf_dir, value, files: int) -> str:
    path = tables.scratch(spark, "lines")
    _t(spark, sf_dir, "events").select(value.alias("value")).repartition(files).write.text(path, lineSep="\n")
    return path


@query("SELECT props AS value, count(*) AS n FROM events GROUP BY 1")
def framed_lines(spark, sf_dir):
    return text_files(spark, _as_files(spark, sf_dir, F.col("props"), 4)).groupBy("value").agg(F.count("*").alias("n"))


@query("SELECT CAST(3 AS BIGINT) AS batches, count(*) AS records FROM events")
def rate_limited_stream(spark, sf_dir):
    """Three files, one in every micro-batch."""
    taken = tables.scratch(spark, "taken")

    def take(lines: DataFrame, batch: int) -> None:
        lines.write.mode("overwrite").parquet(f"{taken}/batch={batch}")

    stream = text_stream(spark, _as_files(spark, sf_dir, F.col("props"), 3), files_per_trigger=1)
    stream.writeStream.foreachBatch(take).option("checkpointLocation", tables.scratch(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(taken).agg(F.countDistinct("batch").alias("batches"), F.count("*").alias("records"))


def _options(spark, **more) -> ingest.Options:
    return ingest.Options(PROPS, tables.scratch(spark, "topic"), tables.scratch(spark, "checkpoint"), **more)


@query("SELECT CAST(props->>'k' AS BIGINT) AS k, count(*) AS n, TRUE AS numbered FROM events GROUP BY 1")
def ingest_records(spark, sf_dir):
    """Files to a topic by a stream, in three partitions; numbered: all numbers from 0 are there once."""
    options, schema = _options(spark, partitions=3, max_rows=200, messages_per_file=1), with_sequence(PROPS)
    ingest.run(text_stream(spark, _as_files(spark, sf_dir, F.col("props"), 4)), options)
    # a file of the topic is opened once for both
    rows = tables.written_out(batching.deserialize(Topic(spark, options.topic, schema).messages(), schema), "ingested")
    numbers = rows.agg(F.min("seq"), F.max("seq"), F.countDistinct("seq"), F.count("*")).first()
    numbered = numbers[0] is None or (numbers[0] == 0 and numbers[1] + 1 == numbers[2] == numbers[3])
    return rows.groupBy(F.col("k").cast("long").alias("k")).agg(F.count("*").alias("n")).withColumn("numbered", F.lit(bool(numbered)))


_BROKEN = "event_id % 5 = 0"


@query(f"SELECT count(*) AS received, count(*) FILTER ({_BROKEN}) AS quarantined, count(*) FILTER (NOT {_BROKEN}) AS published, CAST(sum(CASE WHEN {_BROKEN} THEN 1 + strlen('{{\"k\": -1}}') ELSE 1 + strlen(props) END) AS BIGINT) AS json_bytes FROM events")
def ingest_quarantine(spark, sf_dir):
    """Lines with a negative number go to the quarantine; counters come back from the metrics file."""
    options = _options(spark, mode="quarantine", metrics_path=tables.scratch(spark, "metrics"))
    lines = F.when(F.expr(_BROKEN), '{"k": -1}').otherwise(F.col("props"))
    got = ingest.run(text_stream(spark, _as_files(spark, sf_dir, lines, 4)), options)
    held = spark.read.text(f"{options.topic}/quarantine").filter(F.col("value") == '{"k": -1}').count()
    counters = spark.read.option("header", True).option("inferSchema", True).csv(options.metrics_path)
    size = counters.agg(F.sum("json_bytes").cast("long").alias("json_bytes"))
    return size.select(F.lit(got["received"]).cast("long").alias("received"), F.lit(held).cast("long").alias("quarantined"), F.lit(got["published"]).cast("long").alias("published"), "json_bytes")


_PUBLISHERS = "SELECT user_id % 6 AS publisher, count(*) AS rows, count(*) // 10 AS ipc, CAST(count(*) AS DOUBLE) / 256 AS publish_time, CAST(count(*) AS DOUBLE) / 64 AS thread_time FROM events GROUP BY 1"
_PUBLISHED = [("rows", "BIGINT"), ("ipc", "BIGINT"), ("publish_time", "DOUBLE"), ("thread_time", "DOUBLE")]


def _publishers(spark, sf_dir) -> DataFrame:
    rows = _t(spark, sf_dir, "events").groupBy((F.col("user_id") % 6).alias("publisher"))
    made = rows.agg(F.count("*").alias("rows"), F.expr("count(*) div 10").alias("ipc"), (F.count("*").cast("double") / 256).alias("publish_time"), (F.count("*").cast("double") / 64).alias("thread_time"))
    return made.withColumn("status", F.when(F.col("publisher") == 4, "no connection"))


@query(f"SELECT count(*) AS publishers, {', '.join(f'CAST(sum({c}) AS {t}) AS {c}' for c, t in _PUBLISHED)}, bool_and(publisher <> 4) AS ok FROM ({_PUBLISHERS})")
def publisher_metrics(spark, sf_dir):
    return metrics.publisher_rollup(_publishers(spark, sf_dir))


@query(f"SELECT publisher, rows, ipc, publish_time, thread_time FROM ({_PUBLISHERS})")
def metrics_csv(spark, sf_dir):
    """Metrics written as CSV and read again."""
    rows, path = _publishers(spark, sf_dir).drop("status"), tables.scratch(spark, "metrics")
    metrics.write_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


_TIMERS = ["t_parse", "t_resize", "t_serialize", "t_enqueue", "t_thread"]
_CONVERTERS = f"SELECT user_id % 8 AS worker, count(*) AS num_jsons, CAST(sum(strlen(props) + 1) AS BIGINT) AS json_bytes, count(*) AS num_parsed, count(*) // 10 AS num_ipc, CAST(sum(event_id) AS BIGINT) AS ipc_bytes, {', '.join(f'CAST(count(*) AS DOUBLE) / {2 ** (10 - i)} AS {t}' for i, t in enumerate(_TIMERS))} FROM events GROUP BY 1"


@query(f"SELECT count(*) AS num_threads, {', '.join(f'CAST(sum({c}) AS {"DOUBLE" if c.startswith("t_") else "BIGINT"}) AS {c}' for c in metrics.SUMS)} FROM ({_CONVERTERS})")
def converter_metrics(spark, sf_dir):
    """All ten counters and timers."""
    rows = _t(spark, sf_dir, "events").groupBy((F.col("user_id") % 8).alias("worker"))
    timers = [(F.count("*").cast("double") / 2 ** (10 - i)).alias(t) for i, t in enumerate(_TIMERS)]
    counts = [F.count("*").alias("num_jsons"), F.sum((F.octet_length("props") + 1).cast("long")).alias("json_bytes"), F.count("*").alias("num_parsed"), F.expr("count(*) div 10").alias("num_ipc"), F.sum("event_id").alias("ipc_bytes")]
    return metrics.rollup(rows.agg(*counts, *timers))


_FIELDS = {"flag": BooleanType(), "name": StringType(), "key": LongType()}
_DISPATCHED = [*[(n, t) for n, t in _FIELDS.items()], ("big", None), ("some", 0), ("four", 4)]


@query("SELECT * FROM (VALUES ('flag', 'bool'), ('name', 'string'), ('key', 'int64'), ('big', 'uint64'), ('some', 'list<item: uint64 not null>'), ('four', 'fixed_size_list<item: uint64 not null>[4]')) v(field, type)")
def type_dispatch(spark, sf_dir):
    """Arrow's type of every kind of field."""
    fields = [StructField(n, t, False) if n in _FIELDS else u64(n) if t is None else u64_list(n, t or None) for n, t in _DISPATCHED]
    return spark.createDataFrame([(f.name, str(f.type)) for f in to_arrow(StructType(fields))], "field string, type string")
