"""The pipeline end to end: lines to parsed, numbered, batched and published records.

Numbers go on from one micro-batch to the next: the first number of each is stored with the topic, so
that a micro-batch that is run again after a failure gets the same numbers and replaces its messages.
With its numbers go the counters and instants of every micro-batch.
"""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rillway import tables
from rillway.functions.schema import with_sequence
from rillway.operators import batching, parse
from rillway.operators.metrics import latency_file, write_csv
from rillway.operators.sequence import add_sequence
from rillway.streaming.topic import Topic

log = logging.getLogger("rillway")


@dataclass
class Options:
    schema: StructType
    topic: str
    checkpoint: str
    max_rows: int = batching.MAX_ROWS
    max_message_bytes: int = batching.MAX_BYTES
    parser: str = "catalyst"
    #: strict, lenient, or quarantine: invalid lines go to the topic's folder quarantine, the others are numbered
    mode: str = "strict"
    partitions: int | None = None
    resplit: bool = False
    #: seconds between micro-batches; None takes in what is there and ends
    interval: float | None = None
    messages_per_file: int | None = None
    #: CSV files: a row for every message, or micro-batch
    latency_path: str | None = None
    metrics_path: str | None = None


COUNTERS = "batch long, first long, next long, num_jsons long, json_bytes long, num_invalid long, num_ipc long, ipc_bytes long, receive long, publish long"


def _publish(options: Options, topic: Topic):
    out = with_sequence(options.schema)

    def publish(lines: DataFrame, batch: int) -> None:
        spark, receive, before = lines.sparkSession, time.time_ns(), tables.count()
        start = max((r["next"] for r in _numbers(spark, topic.path) if r["batch"] < batch), default=0)
        lines = lines.filter(F.length(F.trim("value")) > 0).persist()
        parse_with = parse.parser(options.parser)
        try:
            received, size = lines.agg(F.count("*"), F.sum(F.octet_length("value").cast("long") + 1)).first()
            placed = lines.withColumn("__at", F.monotonically_increasing_id())
            invalid = 0
            if options.mode == "quarantine":
                checked = tables.written_out(parse_with(placed, options.schema, mode=options.mode, keep=("__at",)), "checked")
                checked.filter("not valid").select("value").write.mode("overwrite").text(f"{topic.path}/quarantine/batch={batch}")
                invalid = checked.filter("not valid").count()
                records = add_sequence(checked.filter("valid").drop("value", "valid"), ["__at"], start).drop("__at")
            else:
                records = parse_with(add_sequence(placed, ["__at"], start), options.schema, mode=options.mode, keep=("seq",))
            # lines are parsed by all tasks there are; only the messages are made in the partitions asked for
            messages = batching.serialize(_spread(records, options, start, received - invalid), out, options.max_rows, options.max_message_bytes, options.resplit, instants=True)
            sent = Observation()
            topic.publish(messages.observe(sent, F.count("*").alias("num_ipc"), F.coalesce(F.sum("num_bytes"), F.lit(0)).alias("ipc_bytes")), batch, options.messages_per_file)
            entry = [(batch, start, start + received - invalid, received, size or 0, invalid, sent.get["num_ipc"], sent.get["ipc_bytes"], receive, time.time_ns())]
            spark.createDataFrame(entry, COUNTERS).coalesce(1).write.mode("overwrite").parquet(f"{topic.path}/numbers/of={batch}")
        finally:
            lines.unpersist()
            tables.drop(before)

    return publish


def _spread(rows: DataFrame, options: Options, start: int, count: int) -> DataFrame:
    """count rows, numbered from start on, in ranges of equal length; these are known, so nothing is sampled for them."""
    if not options.partitions:
        return rows
    at = F.floor((F.col("seq") - start) * options.partitions / max(count, 1)).cast("int")
    return rows.repartitionById(options.partitions, at).sortWithinPartitions("seq")


def _counters(spark: SparkSession, path: str) -> DataFrame | None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/numbers")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema(COUNTERS + ", of long").parquet(f"{path}/numbers").drop("of")


def _numbers(spark: SparkSession, path: str) -> list:
    """The last two micro-batches: the one before, and the one that may run again."""
    counters = _counters(spark, path)
    return counters.select("batch", "next").orderBy(F.desc("batch")).limit(2).collect() if counters is not None else []


def metrics_of(spark: SparkSession, topic: str) -> DataFrame:
    """A row for every micro-batch of a topic: counters, and seconds from receiving to publishing."""
    return _counters(spark, topic).withColumn("seconds", (F.col("publish") - F.col("receive")) / 1e9)


def latencies_of(spark: SparkSession, topic: str, messages: DataFrame) -> DataFrame:
    """A row for every message: its numbers, and nanoseconds between the stages.  There is no queue: popping takes no time."""
    batches = _counters(spark, topic).select("batch", "receive", "publish")
    return latency_file(messages.join(batches, "batch").withColumn("pop", F.col("serialize")))


def run(stream: DataFrame, options: Options) -> dict[str, int]:
    """Take in the stream and report; incomplete publishing is an error.  With an interval it goes on until
    the query is stopped."""
    spark = stream.sparkSession
    topic = Topic(spark, options.topic, with_sequence(options.schema))
    writer = stream.select("value").writeStream.foreachBatch(_publish(options, topic)).option("checkpointLocation", options.checkpoint)
    writer = writer.trigger(availableNow=True) if options.interval is None else writer.trigger(processingTime=f"{options.interval} seconds")
    writer.start().awaitTermination()
    return report(spark, options, topic)


def report(spark: SparkSession, options: Options, topic: Topic) -> dict[str, int]:
    """What the topic received and holds; writes the CSV files that the options name."""
    counters = _counters(spark, topic.path)
    if counters is None:
        return {"received": 0, "published": 0}
    if options.latency_path:
        write_csv(latencies_of(spark, topic.path, topic.messages()), options.latency_path)
    if options.metrics_path:
        write_csv(metrics_of(spark, topic.path), options.metrics_path)
    received, invalid, size, seconds = counters.agg(F.sum("num_jsons"), F.sum("num_invalid"), F.sum("json_bytes"), F.sum(F.col("publish") - F.col("receive")) / 1e9).first()
    published = topic.messages().agg(F.sum("num_rows")).first()[0]
    out = {"received": received, "published": int(published or 0)} | ({"quarantined": invalid} if options.mode == "quarantine" else {})
    log.info("%s; %.3g MB/s, %.3g M records/s", out, size / 1e6 / max(seconds, 1e-9), received / 1e6 / max(seconds, 1e-9))
    if received != out["published"] + invalid:
        raise RuntimeError(f"incomplete: {out}")
    return out
