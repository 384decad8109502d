"""Sources: lines from servers, files and Arrow files."""

import socket
import threading
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rillway.sources.lines import record_batch_file
from rillway.sources.replay import ReplayReader, replayable_stream


def serve(data: list[bytes], pause: float = 0.0) -> str:
    """A server that sends the pieces to one client and closes."""
    listening = socket.create_server(("localhost", 0))

    def send():
        client, _ = listening.accept()
        with client:
            for piece in data:
                client.sendall(piece)
                time.sleep(pause)
        listening.close()

    threading.Thread(target=send, daemon=True).start()
    return f"localhost:{listening.getsockname()[1]}"


def test_what_was_received_is_read_again(tmp_path):
    server = serve([b"one\ntw", b"o\nthree\nfo", b"ur"], 0.05)
    options = {"servers": server, "spool": str(tmp_path), "timeout": "3", "batchbytes": "7"}
    reader = ReplayReader(options)
    offsets = [reader.initialOffset()]
    for _ in range(20):
        offsets.append(reader.latestOffset())

    def lines(r, a, b):
        return [x for p in r.partitions(offsets[a], offsets[b]) for (x,) in r.read(p)]

    assert lines(reader, 0, -1) == ["one", "two", "three", "four"]
    assert [x for i in range(20) for x in lines(reader, i, i + 1)] == ["one", "two", "three", "four"]
    # another reader, as after a failure, finds the same without the server
    assert lines(ReplayReader(options), 0, -1) == ["one", "two", "three", "four"]
    reader.commit(offsets[-1])
    assert lines(reader, 0, -1) == [] and reader.latestOffset() == offsets[-1]


def test_spool_is_required():
    with pytest.raises(ValueError):
        ReplayReader({"port": "1"})


def test_stream_of_two_servers(spark, tmp_path):
    servers = [serve([b"".join(b'{"v": %d}\n' % i for i in range(n, 500, 2))]) for n in (0, 1)]
    stream = replayable_stream(spark, str(tmp_path / "spool"), servers, batch_bytes=1000, timeout=0.2)
    writer = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
    running = writer.trigger(processingTime="0 seconds").start()
    until, n = time.time() + 90, 0
    while n < 500 and time.time() < until and running.isActive:
        time.sleep(1)
        n = spark.read.schema("value string").parquet(str(tmp_path / "out")).count()
    running.stop()
    got = spark.read.parquet(str(tmp_path / "out")).select(F.get_json_object("value", "$.v").cast("int").alias("v"))
    assert sorted(r["v"] for r in got.collect()) == list(range(500))


def test_record_batch_file_holds_one_batch(spark, tmp_path):
    table = pa.table({"a": pa.array([1, 2], pa.uint64()), "b": ["x", None]})
    for name, batches in (("one", 1), ("two", 2)):
        with pa.ipc.new_file(tmp_path / name, table.schema) as f:
            for _ in range(batches):
                f.write_batch(table.to_batches()[0])
    rows = record_batch_file(spark, str(tmp_path / "one")).orderBy("a").collect()
    assert [(int(r["a"]), r["b"]) for r in rows] == [(1, "x"), (2, None)]
    with pytest.raises(OSError):
        record_batch_file(spark, str(tmp_path / "two"))


def test_stream_of_a_table_stays_out_of_the_driver(spark, tmp_path):
    from rillway.plans.queries import QUERIES

    made = spark.range(1000).selectExpr("id AS event_id", """concat('{"k": ', id, '}') AS props""")
    made.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["stream_parse"](spark, str(tmp_path))
    assert got.inputFiles()  # a table in memory has none
    assert sorted(map(tuple, got.collect())) == [(i, i) for i in range(1000)]
