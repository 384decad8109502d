"""The query catalogue: every operator on the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from rillway import tables
from rillway.functions.schema import u64, u64_list
from rillway.operators import batching, lists, merge, metrics, parse, sequence
from rillway.plans.catalogue import ORACLE_SQL, PROPS, QUERIES, query  # noqa: F401
from rillway.plans.catalogue import table as _t

@query("SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def parse_event_props(spark, sf_dir):
    lines = _t(spark, sf_dir, "events").select("event_id", F.col("props").alias("value"))
    return parse.parse_records(lines, PROPS, keep=("event_id",)).select("event_id", F.col("k").cast("long").alias("k"))


@query("SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity > 25 AS large, l_suppkey, len(l_linestatus) AS width FROM lineitem")
def parse_wide_record(spark, sf_dir):
    schema = StructType([u64("l_orderkey"), u64("l_linenumber"), StructField("l_returnflag", StringType(), False), StructField("large", _bool(), False), u64("l_suppkey"), u64("width")])
    made = F.struct("l_orderkey", "l_linenumber", "l_returnflag", (F.col("l_quantity") > 25).alias("large"), "l_suppkey", F.length("l_linestatus").alias("width"))
    parsed = parse.parse_records(_t(spark, sf_dir, "lineitem").select(F.to_json(made).alias("value")), schema)
    return parsed.select(*[F.col(f.name).cast("long").alias(f.name) if f.metadata.get("unsigned") else f.name for f in schema.fields])


def _bool():
    from pyspark.sql.types import BooleanType

    return BooleanType()


def _scaled(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor((x.cast("double") + 4) * 1000)).alias("voltage"))


_SCALED = "list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 4) * 1000) AS BIGINT))"


@query(f"SELECT vec_id, len(embedding) AS n, CAST(list_sum({_SCALED}) AS BIGINT) AS total FROM embeddings")
def parse_list(spark, sf_dir):
    lines = _scaled(spark, sf_dir).select("vec_id", F.to_json(F.struct("voltage")).alias("value"))
    parsed = parse.parse_records(lines, StructType([u64_list("voltage")]), keep=("vec_id",))
    return parsed.select("vec_id", F.size("voltage").cast("long").alias("n"), F.aggregate("voltage", F.lit(0).cast("long"), lambda s, x: s + x.cast("long")).alias("total"))


_FAULT = "CAST(event_id % 6 AS INTEGER)"


@query(f"SELECT {_FAULT} AS kind, count(*) AS n, CAST(sum(CASE WHEN event_id % 6 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_valid FROM events GROUP BY ALL")
def strict_reject(spark, sf_dir):
    """Kinds: 0 valid, 1 extra key, 2 missing key, 3 fraction, 4 negative, 5 two objects on a line."""
    events, kind, p = _t(spark, sf_dir, "events"), (F.col("event_id") % 6).cast("int"), F.col("props")
    made = [p, F.regexp_replace(p, r"\}$", ', "x": 1}'), F.lit('{"j": 1}'), F.lit('{"k": 1.5}'), F.lit('{"k": -1}'), F.concat(p, p)]
    lines = events.select(kind.alias("kind"), reduce(lambda acc, i: F.when(kind == i, made[i]).otherwise(acc), range(1, 6), made[0]).alias("value"))
    return parse.parse_records(lines, PROPS, "quarantine", keep=("kind",)).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.col("valid").cast("long")).alias("n_valid"))


@query("SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def lenient_parse(spark, sf_dir):
    lines = _t(spark, sf_dir, "events").select("event_id", F.regexp_replace("props", r"\}$", ', "asdf": [1, 2]}').alias("value"))
    return parse.parse_records(lines, PROPS, "lenient", keep=("event_id",)).select("event_id", F.col("k").cast("long").alias("k"))


@query("SELECT o_orderkey AS order_key, o_custkey AS customer_key, o_orderpriority AS state_priority, o_orderstatus AS state_status FROM orders")
def flatten_record(spark, sf_dir):
    nested = F.struct(F.struct(F.col("o_orderkey").alias("key")).alias("order"), F.struct(F.col("o_custkey").alias("key")).alias("customer"), F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")).alias("state"))
    text = _t(spark, sf_dir, "orders").select(F.to_json(nested).alias("value"))
    key = StructType([StructField("key", LongType())])
    schema = StructType([StructField("order", key), StructField("customer", key), StructField("state", StructType([StructField("priority", StringType()), StructField("status", StringType())]))])
    return parse.flatten(parse.parse_records(text, schema))


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS seq FROM events")
def add_sequence(spark, sf_dir):
    return sequence.add_sequence(_t(spark, sf_dir, "events").select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "seq")


@query("SELECT any_value(seq) AS seq, any_value(vec_id) AS vec_id FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS seq FROM embeddings) GROUP BY vec_id")
def sequence_schema(spark, sf_dir):
    """The sequence column comes first."""
    return sequence.add_sequence(_t(spark, sf_dir, "embeddings").select("vec_id"), ["vec_id"])


_SEQ = "(SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS seq, count(*) OVER () AS n FROM events)"


def _numbered(spark, sf_dir, *columns):
    return sequence.add_sequence(_t(spark, sf_dir, "events").select("event_id", *columns), ["event_id"])


@query(f"SELECT CAST(CASE WHEN seq < n // 7 + n % 7 THEN 0 ELSE 1 + (seq - n // 7 - n % 7) // (n // 7) END AS INTEGER) AS buffer_id, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS num_rows FROM {_SEQ} GROUP BY 1")
def buffer_distribution(spark, sf_dir):
    total = _t(spark, sf_dir, "events").count()
    rows = _numbered(spark, sf_dir).withColumn("buffer_id", sequence.buffer_of(F.col("seq"), total, 7))
    return sequence.sequence_ranges(rows, ["buffer_id"])


@query(f"SELECT seq // 1024 AS batch_id, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS num_rows FROM {_SEQ} GROUP BY 1")
def resize_batches(spark, sf_dir):
    return sequence.sequence_ranges(_numbered(spark, sf_dir).withColumn("batch_id", batching.batch_of(F.col("seq"))), ["batch_id"])


_IN_BUFFER = "(SELECT *, user_id % 4 AS buffer_id, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS pos FROM events)"


@query(f"SELECT buffer_id, pos // 1024 AS slice_id, min(pos) AS first_seq, max(pos) AS last_seq, count(*) AS num_rows FROM {_IN_BUFFER} GROUP BY 1, 2")
def resize_within_buffer(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").withColumn("buffer_id", F.col("user_id") % 4)
    rows = sequence.place_within(rows, ["buffer_id"], ["event_id"], "seq")
    return sequence.sequence_ranges(rows.withColumn("slice_id", batching.batch_of(F.col("seq"))), ["buffer_id", "slice_id"])


@query(f"SELECT seq // 1024 AS batch_id, CAST(sum(strlen(props)) AS BIGINT) AS num_bytes, sum(strlen(props)) <= 10000 AS ok FROM {_SEQ} GROUP BY 1")
def message_size_guard(spark, sf_dir):
    rows = _numbered(spark, sf_dir, "props").withColumn("batch_id", batching.batch_of(F.col("seq")))
    sizes = rows.groupBy("batch_id").agg(F.sum(F.octet_length("props").cast("long")).alias("num_bytes"))
    return batching.check_sizes(sizes, max_bytes=10_000)


_LINES = "l_orderkey, l_partkey, l_linenumber, l_returnflag, l_quantity"


@query(f"SELECT {_LINES} FROM lineitem")
def ipc_roundtrip(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(*_LINES.split(", "))
    return batching.deserialize(batching.serialize(rows, rows.schema), rows.schema)


@query("SELECT count(*) AS records, count(*) AS in_messages, TRUE AS bounded FROM lineitem")
def serialize_messages(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(*_LINES.split(", "))
    messages = batching.serialize(rows, rows.schema, max_rows=500)
    return messages.agg(F.sum("num_rows").alias("records"), F.sum("num_rows").alias("in_messages"), F.max(F.col("num_rows") <= 500).alias("bounded"))


@query(f"SELECT first_seq, row_number() OVER (ORDER BY first_seq) AS rank FROM (SELECT min(seq) AS first_seq FROM {_SEQ} GROUP BY seq // 512)")
def order_messages(spark, sf_dir):
    batches = sequence.sequence_ranges(_numbered(spark, sf_dir).withColumn("batch_id", batching.batch_of(F.col("seq"), 512)), ["batch_id"])
    return sequence.add_sequence(batches.repartition(8).select("first_seq"), ["first_seq"], 1, "rank").select("first_seq", "rank")


@query(f"SELECT seq, event_id FROM {_SEQ} ORDER BY seq")
def restore_order(spark, sf_dir):
    return _numbered(spark, sf_dir).repartition(8).orderBy("seq")


_TAGS = "SELECT user_id % 4 AS tag, count(*) AS n FROM events GROUP BY 1"


@query(f"""SELECT event_id, e.user_id % 4 AS tag, CAST(first_seq AS BIGINT) + row_number() OVER (PARTITION BY e.user_id % 4 ORDER BY event_id) - 1 AS seq
FROM events e JOIN (SELECT tag, coalesce(sum(n) OVER (ORDER BY tag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_seq FROM ({_TAGS})) f ON e.user_id % 4 = f.tag""")
def tag_to_sequence(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 4).alias("tag"))
    counts = rows.groupBy("tag").agg(F.count("*").alias("n"))
    first = sequence.running_total(counts, F.col("n"), ["tag"], "first_seq").select("tag", "first_seq")
    return sequence.tag_to_sequence(rows, "tag", "event_id", first)


@query("SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS returned FROM lineitem")
def byte_to_bool(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").withColumn("flag", (F.col("l_returnflag") == "R").cast("tinyint"))
    return rows.select("l_orderkey", "l_linenumber", parse.byte_to_boolean("flag").alias("returned"))


@query("SELECT vec_id, len(embedding) AS n, CAST(embedding[12] AS DOUBLE) AS item_11 FROM embeddings WHERE len(embedding) = 64")
def fixed_size_list(spark, sf_dir):
    """Rows of eight vectors' values in one run, looked up by row."""
    rows = _t(spark, sf_dir, "embeddings").withColumn("run", F.concat(F.array_repeat(F.lit(0.0).cast("float"), 64), "embedding"))
    view = rows.select("vec_id", lists.fixed_size_view("run", F.lit(1), 64).alias("view")).filter(F.size("view") == 64)
    return view.select("vec_id", F.size("view").cast("long").alias("n"), F.col("view")[11].cast("double").alias("item_11"))


def _words(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("words"))


@query("SELECT doc_id, len(string_split(text, ' ')) AS len FROM documents")
def list_lengths(spark, sf_dir):
    return lists.lengths(_words(spark, sf_dir), "words").select("doc_id", "len")


@query("SELECT doc_id, len, CAST(coalesce(sum(len) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM (SELECT doc_id, len(string_split(text, ' ')) AS len FROM documents)")
def list_offsets(spark, sf_dir):
    return lists.offsets(lists.lengths(_words(spark, sf_dir), "words").select("doc_id", "len"), "len", ["doc_id"])


@query("SELECT vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings")
def list_values(spark, sf_dir):
    return lists.values(_t(spark, sf_dir, "embeddings"), ["vec_id"], "embedding").withColumn("v", F.col("v").cast("double"))


@query("SELECT doc_id, array_to_string(w, ' ') AS joined, CAST(len(w) AS INTEGER) AS n FROM (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: length(x) > 3) AS w FROM documents)")
def list_from_offsets(spark, sf_dir):
    """The words of all documents in one run, as they are read, and lists made of it by their offsets; documents without a
    word of over three letters have empty lists, those without text none."""
    words = _t(spark, sf_dir, "documents").select("doc_id", F.filter(F.split("text", " "), lambda w: F.length(w) > 3).alias("words"))
    placed = lists.offsets(lists.lengths(words, "words").select("doc_id", "len", "words"), "len")
    runs = placed.select(F.col("off").alias("at"), F.col("words").alias("w"))
    made = lists.from_runs(placed.select("doc_id", "off", "len"), ["doc_id"], "off", "len", runs, "at", "w", "words")
    return made.select("doc_id", F.array_join("words", " ").alias("joined"), F.size("words").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_returnflag AS flag FROM lineitem WHERE l_returnflag <> 'N'")
def drop_empty(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.nullif(F.col("l_returnflag"), F.lit("N")).alias("flag"))
    return parse.drop_empty(rows, "flag")


@query("SELECT n_nationkey, CAST(unnest(range(len(n_name))) + 1 AS BIGINT) AS pos, unnest(string_split(n_name, '')) AS ch FROM nation")
def explode_chars(spark, sf_dir):
    return lists.characters(_t(spark, sf_dir, "nation"), ["n_nationkey"], "n_name")


@query("SELECT CAST(user_id % 4 AS INTEGER) AS source, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def merge_sources(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    return merge.merge_sources([events.filter(F.col("user_id") % 4 == i) for i in range(4)]).groupBy("source").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT event_id, src, row_number() OVER (ORDER BY n, src) - 1 AS out_pos FROM (SELECT event_id, event_type AS src, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events)")
def round_robin_merge(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("src"))
    return merge.round_robin(rows, "src", "event_id").select("event_id", "src", "out_pos")


@query("SELECT count(*) AS records FROM events")
def record_count(spark, sf_dir):
    return _t(spark, sf_dir, "events").agg(F.count("*").alias("records"))


@query("SELECT event_type, CAST(sum(strlen(props) + 1) AS BIGINT) AS bytes, count(*) AS records FROM events GROUP BY 1")
def bytes_per_source(spark, sf_dir):
    return metrics.bytes_per_source(_t(spark, sf_dir, "events"), "event_type", "props")


@query("SELECT count(*) AS records, CAST(sum(length(props)) AS BIGINT) AS total_chars, max(length(props)) AS largest FROM events")
def json_size_stats(spark, sf_dir):
    return metrics.size_stats(_t(spark, sf_dir, "events"), "props")


_WORKERS = """SELECT user_id % 8 AS worker, count(*) AS num_jsons, CAST(sum(strlen(props) + 1) AS BIGINT) AS json_bytes, count(*) // 10 AS num_ipc, CAST(sum(event_id) AS BIGINT) AS ipc_bytes, CAST(count(*) AS DOUBLE) / 1024 AS t_parse,
CASE WHEN user_id % 8 IN (2, 5) THEN 'worker ' || CAST(user_id % 8 AS VARCHAR) || ' failed' END AS status FROM events GROUP BY 1"""


def _workers(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").withColumn("worker", F.col("user_id") % 8)
    made = rows.groupBy("worker").agg(
        F.count("*").alias("num_jsons"), F.sum((F.octet_length("props") + 1).cast("long")).alias("json_bytes"), F.expr("count(*) div 10").alias("num_ipc"), F.sum("event_id").alias("ipc_bytes"), (F.count("*").cast("double") / 1024).alias("t_parse")
    )
    return made.withColumn("status", F.when(F.col("worker").isin(2, 5), F.concat(F.lit("worker "), F.col("worker").cast("string"), F.lit(" failed"))))


_SUMS = ["num_jsons", "json_bytes", "num_ipc", "ipc_bytes", "t_parse"]
_ROLLED = f"SELECT count(*) AS num_threads, {', '.join(f'CAST(sum({c}) AS {"DOUBLE" if c[0] == "t" else "BIGINT"}) AS {c}' for c in _SUMS)} FROM ({_WORKERS})"


@query(_ROLLED)
def metrics_rollup(spark, sf_dir):
    return metrics.rollup(_workers(spark, sf_dir), _SUMS)


@query(f"SELECT string_agg(status, chr(10) ORDER BY worker) AS messages, min_by(status, worker) FILTER (status IS NOT NULL) AS first FROM ({_WORKERS})")
def status_aggregate(spark, sf_dir):
    return metrics.failures(_workers(spark, sf_dir), "worker")


@query(f"""SELECT json_bytes / 1e6 / (t_parse / num_threads) AS mb_per_s, json_bytes / 1048576 / (t_parse / num_threads) AS mib_per_s, num_jsons / 1e6 / (t_parse / num_threads) AS mjson_per_s,
CASE WHEN num_jsons > 0 THEN CAST(ipc_bytes AS DOUBLE) / num_jsons ELSE 0 END AS bytes_per_json, CASE WHEN num_ipc > 0 THEN ipc_bytes // num_ipc ELSE 0 END AS bytes_per_message FROM ({_ROLLED})""")
def throughput_report(spark, sf_dir):
    return metrics.throughput(metrics.rollup(_workers(spark, sf_dir), _SUMS))


@query("SELECT user_id, event_id, latency_us FROM (SELECT user_id, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS latency_us FROM events) WHERE latency_us IS NOT NULL")
def stage_latency(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return metrics.stage_latency(rows, ["user_id"], "event_id", "ts").select("user_id", "event_id", "latency_us")


@query("SELECT event_id AS first_seq, event_id AS last_seq, CAST((event_id % 7) * 1000 AS BIGINT) AS parse, CAST((event_id % 5) * 1000 AS BIGINT) AS resize FROM events")
def latency_table(spark, sf_dir):
    at = lambda us: F.timestamp_micros(F.unix_micros("ts") + us)
    rows = _t(spark, sf_dir, "events").select(F.col("event_id").alias("first_seq"), F.col("event_id").alias("last_seq"), F.col("ts").cast("timestamp").alias("receive"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    rows = rows.withColumn("parse", at(F.col("event_id") % 7)).withColumn("resize", at(F.col("event_id") % 7 + F.col("event_id") % 5))
    return metrics.latency_columns(rows, ["receive", "parse", "resize"])


@query("SELECT event_type, CAST(sum(event_id * 1000) AS DOUBLE) / count(*) * 1e-6 AS mean_ms FROM events GROUP BY 1")
def mean_latency(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("event_type").agg(metrics.mean_latency_ms(F.col("event_id") * 1000).alias("mean_ms"))


@query("SELECT event_type, 1e-6 * count(*) * 5232640 / 2.0 AS goodput_mb FROM events GROUP BY 1")
def goodput(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("event_type").agg(metrics.goodput(F.count("*"), F.lit(5_232_640), F.lit(2.0)).alias("goodput_mb"))


@query("SELECT event_type, epoch_us(min(ts)) AS received FROM events GROUP BY 1")
def worst_case_receive(spark, sf_dir):
    return merge.worst_case_receive(_t(spark, sf_dir, "events"), "ts", ["event_type"]).withColumn("received", F.unix_micros(F.col("received").cast("timestamp")))


@query("SELECT CAST(n AS BIGINT) AS received, CAST(n AS BIGINT) AS parsed, CAST(n AS BIGINT) AS published, TRUE AS complete FROM (SELECT count(*) AS n FROM events)")
def completeness_check(spark, sf_dir):
    lines = _t(spark, sf_dir, "events").select("event_id", F.col("props").alias("value"))
    rows = parse.parse_records(lines, PROPS, keep=("event_id",)).withColumn("k", F.col("k").cast("long"))
    messages = batching.serialize(rows, rows.schema)
    # the lines are parsed once: messages hold all that was parsed, or the parser fails
    received = lines.count()
    sums = messages.agg(F.coalesce(F.sum("num_rows"), F.lit(0)).alias("published"))
    return sums.select(F.lit(received).cast("long").alias("received"), F.col("published").alias("parsed"), "published", (F.col("published") == received).alias("complete"))


@query("SELECT n_nationkey, 'n_nationkey : ' || CAST(n_nationkey AS VARCHAR) || chr(10) || 'n_name : ' || n_name AS text FROM nation")
def record_to_text(spark, sf_dir):
    nation = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return parse.record_text(nation).withColumn("n_nationkey", F.regexp_extract("text", r"n_nationkey : (\d+)", 1).cast("int")).select("n_nationkey", "text")


@query("SELECT range AS seq, 16 AS size, repeat('A', 16) AS text FROM range(100)")
def synthetic_payloads(spark, sf_dir):
    from rillway.sources.lines import payloads

    return payloads(spark, 100, 16).select("seq", F.octet_length("message").alias("size"), F.col("message").cast("string").alias("text"))


@query("SELECT CAST(500 AS BIGINT) AS records, CAST(500 AS BIGINT) AS valid, TRUE AS bounded")
def generate_records(spark, sf_dir):
    from rillway.functions.schema import list_record
    from rillway.sources.generator import json_records

    parsed = parse.parse_records(json_records(spark, 500, list_record()), list_record(), "quarantine", keep=("seq",))
    inside = F.forall("voltage", lambda x: x <= 2047) & F.size("voltage").between(1, 16)
    return parsed.agg(F.count("*").alias("records"), F.sum(F.col("valid").cast("long")).alias("valid"), F.min(inside).alias("bounded"))


@query("SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def stream_parse(spark, sf_dir):
    """The sink is a table in the shared folder: one in memory would hold all rows in the driver."""
    events = _t(spark, sf_dir, "events")
    # a pattern, as a stream takes a path without one for a folder; so the table may be a file or a folder of files
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]")
    lines = stream.select("event_id", F.col("props").alias("value"))
    parsed = parse.parse_records(lines, PROPS, keep=("event_id",)).select("event_id", F.col("k").cast("long").alias("k"))
    out = tables.scratch(spark, "stream_parse")
    writer = parsed.writeStream.format("parquet").option("path", out).option("checkpointLocation", tables.scratch(spark, "checkpoint"))
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(parsed.schema).parquet(out)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parse, number and batch the events, and sum up every batch."""
    lines = _t(spark, sf_dir, "events").select("event_id", F.col("props").alias("value"))
    rows = sequence.add_sequence(parse.parse_records(lines, PROPS, keep=("event_id",)), ["event_id"])
    batches = rows.withColumn("batch_id", batching.batch_of(F.col("seq"), 256))
    return batches.groupBy("batch_id").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("num_rows"), F.sum(F.col("k").cast("long")).alias("sum_k"))


from rillway.plans import topics  # noqa: E402, F401 (registers its queries)
