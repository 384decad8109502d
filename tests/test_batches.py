"""Messages, topics, sequences and the stream end to end."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rillway.functions.schema import from_arrow, list_record, read_schema, to_arrow, u64, wide_record, with_sequence, write_schema
from rillway.operators import batching, lists, merge, metrics, sequence
from rillway.operators.parse import PARSERS, parse_records
from rillway.sources.generator import json_records
from rillway.sources.lines import payloads, text_files, text_stream
from rillway.streaming.ingest import Options, run
from rillway.streaming.topic import SchemaMismatch, Topic


def records(spark, n, schema):
    return parse_records(json_records(spark, n, schema), schema, keep=("seq",))


@pytest.mark.parametrize("schema", [list_record(), wide_record()])
def test_round_trip(spark, schema):
    rows, full = records(spark, 500, schema), with_sequence(schema)
    messages = batching.serialize(rows, full, max_rows=64)
    sizes = messages.select("first_seq", "last_seq", "num_rows", "num_bytes").collect()
    assert sum(m["num_rows"] for m in sizes) == 500 and max(m["num_rows"] for m in sizes) <= 64
    assert all(m["last_seq"] - m["first_seq"] + 1 == m["num_rows"] for m in sizes)
    back = batching.deserialize(messages, full)
    assert batching.same_rows(rows, back)
    assert not batching.different_by_sequence(rows, back).count()
    assert batching.different_by_sequence(rows, back.filter("seq <> 3")).collect()[0]["seq"] == 3


def test_size_guard_fails_or_splits(spark):
    rows, full = records(spark, 200, list_record()), with_sequence(list_record())
    with pytest.raises(Exception, match="reduce the rows"):
        batching.serialize(rows.coalesce(1), full, max_bytes=2000).collect()
    split = batching.serialize(rows.coalesce(1), full, max_bytes=4000, resplit=True)
    assert split.agg(F.sum("num_rows"), F.max("num_bytes") <= 4000).first() == (200, True)
    with pytest.raises(Exception, match="too large"):
        batching.failing(split, max_bytes=10).collect()


def test_schema_files(tmp_path):
    for name in ("s.as", "s.json"):
        write_schema(wide_record(), str(tmp_path / name))
        got = read_schema(str(tmp_path / name))
        assert [(f.name, f.dataType, f.metadata.get("size")) for f in got] == [(f.name, f.dataType, f.metadata.get("size")) for f in wide_record()]
    assert to_arrow(from_arrow(to_arrow(wide_record()))) == to_arrow(wide_record())
    (tmp_path / "bad.as").write_bytes(b"nonsense")
    for path in ("", str(tmp_path / "missing"), str(tmp_path / "bad.as")):
        with pytest.raises(OSError):
            read_schema(path)


def test_sequences(spark):
    rows = spark.range(1000).withColumn("k", F.pmod(F.hash("id"), F.lit(97)))
    got = [(r["seq"], r["k"], r["id"]) for r in sequence.add_sequence(rows, ["k", "id"], 5).collect()]
    want = sorted((r["k"], r["id"]) for r in rows.collect())
    assert sorted(got) == [(i + 5, k, x) for i, (k, x) in enumerate(want)]
    assert sequence.add_sequence(rows.limit(0), ["id"]).count() == 0
    sizes = spark.range(10).select(F.col("id"), sequence.buffer_of(F.col("id"), 10, 4).alias("b")).groupBy("b").count().collect()
    assert sorted((r["b"], r["count"]) for r in sizes) == [(0, 4), (1, 2), (2, 2), (3, 2)]


def test_places_within_keys(spark):
    rows = spark.createDataFrame([(k, i) for i in range(300) for k in (["a", None, "b"] if i % 3 else ["a"])], "k string, i long")
    got = sorted((str(r["k"]), r["i"], r["p"]) for r in sequence.place_within(rows, ["k"], ["i"], "p").collect())
    want = []
    for k in ("a", "b", None):
        own = sorted(r["i"] for r in rows.collect() if r["k"] == k)
        want += [(str(k), i, p) for p, i in enumerate(own)]
    assert got == sorted(want)


def test_messages_hold_neighbours(spark):
    """Rows of several ranges of numbers in one partition give messages of one range each."""
    full = with_sequence(list_record())
    rows = records(spark, 800, list_record()).withColumn("p", F.floor(F.col("seq") / 100) % 2).repartition(2, "p").sortWithinPartitions("seq").drop("p")
    sizes = batching.serialize(rows, full, max_rows=64).select("first_seq", "last_seq", "num_rows").collect()
    assert sum(m["num_rows"] for m in sizes) == 800
    assert all(m["last_seq"] - m["first_seq"] + 1 == m["num_rows"] for m in sizes)


def test_no_time_gives_no_rates(spark):
    row = spark.createDataFrame([(1, 1, 0, 0, 0.0, 1)], "num_jsons long, json_bytes long, num_ipc long, ipc_bytes long, t_parse double, num_threads long")
    assert metrics.throughput(row).first()["mb_per_s"] is None


def test_lists_and_merge(spark):
    rows = spark.createDataFrame([(1, [5, 6]), (2, []), (3, [7])], "id long, l array<int>")
    off = lists.offsets(lists.lengths(rows, "l"), "len", ["id"]).orderBy("id").collect()
    assert [r["off"] for r in off] == [0, 2, 2]
    back = lists.from_values(lists.values(rows, ["id"], "l"), ["id"], "pos", "v", "l").orderBy("id").collect()
    assert [(r["id"], r["l"]) for r in back] == [(1, [5, 6]), (3, [7])]
    back = lists.from_values(lists.values(rows, ["id"], "l"), ["id"], "pos", "v", "l", rows).orderBy("id").collect()
    assert [(r["id"], r["l"]) for r in back] == [(1, [5, 6]), (2, []), (3, [7])]
    items = spark.createDataFrame([(2, 7), (0, 5), (1, 6)], "at long, v int")
    placed = lists.offsets(lists.lengths(rows, "l").select("id", "len"), "len", ["id"])
    back = lists.from_offsets(placed, ["id"], "off", "len", items, "at", "v", "l").orderBy("id").collect()
    assert [(r["id"], r["l"]) for r in back] == [(1, [5, 6]), (2, []), (3, [7])]
    merged = merge.round_robin(spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "s string, o int"), "s", "o").orderBy("out_pos")
    assert [(r["s"], r["o"]) for r in merged.collect()] == [("a", 1), ("b", 1), ("a", 2)]


def _records_shuffled(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("bits", [3, 6, 11])
def test_lists_of_runs(spark, monkeypatch, bits):
    """Runs and lists that don't end where the other does, rows alike, without key, length or values."""
    monkeypatch.setattr(lists, "GRID_BITS", bits)
    monkeypatch.setattr(lists, "GRID", 1 << bits)
    items = list(range(1000))
    cuts = [0, 1, 63, 64, 65, 200, 201, 650, 1000]
    runs = spark.createDataFrame([(a, items[a:b]) for a, b in zip(cuts, cuts[1:])] + [(5, [])], "at long, v array<int>")
    wanted = [(1, 0, 3), (2, 3, 500), (3, 503, 0), (3, 503, 0), (None, 503, 397), (4, 600, 100), (4, 600, 100), (5, 900, None), (6, 999, 1), (None, 640, 64)]
    placed = spark.createDataFrame(wanted, "id int, off long, len long")
    got = lists.from_runs(placed, ["id"], "off", "len", runs, "at", "v", "l").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, None if n is None else items[o : o + n])) for i, o, n in wanted)


def test_lists_are_not_moved_by_item(spark, tmp_path):
    from rillway.plans.queries import QUERIES

    text = " ".join(f"word{i}" for i in range(5000))
    docs = [(1, text), (2, None), (3, ""), (4, "a bc"), (4, "same number"), (None, "last words")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    joins = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = _records_shuffled(spark)
        got = QUERIES["list_from_offsets"](spark, str(tmp_path)).collect()
        assert _records_shuffled(spark) - before < 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joins)
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(x) for x in [(1, text, 5000), (2, None, None), (3, "", 0), (4, "", 0), (4, "same number", 2), (None, "last words", 2)])


def test_no_messages_give_no_rates(spark):
    row = spark.createDataFrame([(0, 0, 0, 0, 1.0, 1)], "num_jsons long, json_bytes long, num_ipc long, ipc_bytes long, t_parse double, num_threads long")
    got = metrics.throughput(row).first()
    assert got["bytes_per_message"] == 0 and got["bytes_per_json"] == 0.0


def test_topic_refuses_another_schema(spark, tmp_path):
    path = str(tmp_path / "topic")
    Topic(spark, path, with_sequence(list_record()))
    Topic(spark, path, with_sequence(list_record()))
    with pytest.raises(SchemaMismatch):
        Topic(spark, path, with_sequence(wide_record()))


@pytest.mark.parametrize("parser", ["catalyst", "arrow"])
def test_stream_equals_batch(spark, tmp_path, parser):
    schema, lines = list_record(), str(tmp_path / "in")
    json_records(spark, 400, schema).orderBy("seq").coalesce(1).select("value").write.text(lines)
    options = Options(schema, str(tmp_path / "topic"), str(tmp_path / "cp"), max_rows=100, parser=parser, latency_path=str(tmp_path / "lat"))
    assert run(text_stream(spark, lines), options) == {"received": 400, "published": 400}
    json_records(spark, 100, schema, seed=1).coalesce(1).select("value").write.mode("append").text(lines)
    assert run(text_stream(spark, lines), options) == {"received": 500, "published": 500}
    rows = batching.deserialize(Topic(spark, options.topic, with_sequence(schema)).messages(), with_sequence(schema))
    assert sorted(r["seq"] for r in rows.select("seq").collect()) == list(range(500))
    whole = parse_records(text_files(spark, lines), schema)
    assert batching.same_rows(rows.select("voltage"), whole)


def test_quarantine_counters_and_latencies(spark, tmp_path):
    schema, lines = StructType([u64("v")]), str(tmp_path / "in")
    made = ['{"v": %d}' % i if i % 7 else '{"v": -%d}' % (i + 1) for i in range(300)]
    spark.createDataFrame([(x,) for x in made], "value string").coalesce(1).write.text(lines)
    options = Options(schema, str(tmp_path / "topic"), str(tmp_path / "cp"), max_rows=50, mode="quarantine", partitions=3, messages_per_file=2, latency_path=str(tmp_path / "lat"), metrics_path=str(tmp_path / "met"))
    assert run(text_stream(spark, lines), options) == {"received": 300, "published": 257, "quarantined": 43}
    topic = Topic(spark, options.topic, with_sequence(schema))
    rows = batching.deserialize(topic.messages(), with_sequence(schema)).orderBy("seq").collect()
    assert [(r["seq"], int(r["v"])) for r in rows] == list(enumerate(i for i in range(300) if i % 7))
    bad = {r["value"] for r in spark.read.text(f"{options.topic}/quarantine").collect()}
    assert bad == {x for i, x in enumerate(made) if i % 7 == 0}
    latency = spark.read.option("header", True).option("inferSchema", True).csv(options.latency_path)
    assert latency.columns == ["First", "Last", "Parse", "Resize", "Serialize", "Pop", "Publish"]
    assert latency.agg(F.sum(F.col("Last") - F.col("First") + 1), F.min("Parse") > 0, F.min("Publish") > 0).first() == (257, True, True)
    counters = spark.read.option("header", True).option("inferSchema", True).csv(options.metrics_path).first()
    assert (counters["num_jsons"], counters["num_invalid"], counters["json_bytes"]) == (300, 43, sum(len(x) + 1 for x in made))


def test_only_messages_are_made_in_the_partitions(spark, tmp_path):
    """Lines are parsed where they are read, many small files share a task, and all is as with fewer."""
    schema, lines, plans = StructType([u64("v")]), str(tmp_path / "in"), []
    spark.range(1000).selectExpr("""concat('{"v": ', id, '}') AS value""").coalesce(4).write.text(lines)

    def own(df, *a, **k):
        plans.append(df._jdf.queryExecution().analyzed().toString())
        return parse_records(df, *a, **k)

    packed = spark.conf.get("spark.sql.files.maxPartitionBytes")
    PARSERS["own"] = own
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        options = Options(schema, str(tmp_path / "topic"), str(tmp_path / "cp"), max_rows=10, parser="own", partitions=3, messages_per_file=1, metrics_path=str(tmp_path / "met"))
        assert run(text_stream(spark, lines), options) == {"received": 1000, "published": 1000}
        messages = Topic(spark, options.topic, with_sequence(schema)).messages()
        assert len(messages.inputFiles()) >= 100 and messages.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    finally:
        del PARSERS["own"]
        spark.conf.set("spark.sql.files.maxPartitionBytes", packed)
    assert len(plans) == 1 and "Repartition" not in plans[0]
    parts = {f.rpartition("/")[2].split("-")[1] for f in messages.inputFiles()}
    assert len(parts) == 3
    rows = batching.deserialize(messages, with_sequence(schema))
    assert rows.select("seq").distinct().count() == rows.count() == 1000 and rows.agg(F.max("seq")).first()[0] == 999
    counters = spark.read.option("header", True).option("inferSchema", True).csv(options.metrics_path).first()
    assert (counters["num_ipc"], counters["ipc_bytes"]) == messages.agg(F.count("*"), F.sum("num_bytes")).first()


def test_publisher_sums(spark):
    df = spark.createDataFrame([(10, 2, 0.5, 1.0, None), (20, 3, 0.25, 1.0, "late")], "rows long, ipc long, publish_time double, thread_time double, status string")
    assert metrics.publisher_rollup(df).first() == (2, 30, 5, 0.75, 2.0, False)


def test_payloads(spark):
    assert payloads(spark, 3, 5).agg(F.count("*"), F.max(F.octet_length("message"))).first() == (3, 5)
    assert u64("x").metadata["unsigned"]
