"""Metrics: sums over workers, rates, latencies, and their CSV form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUMS = ["num_jsons", "json_bytes", "num_parsed", "num_ipc", "ipc_bytes", "t_parse", "t_resize", "t_serialize", "t_enqueue", "t_thread"]
STAGES = ["receive", "parse", "resize", "serialize", "pop", "publish"]


def rollup(df: DataFrame, sums: list[str] | None = None) -> DataFrame:
    """One row: the number of workers, the sum of every counter and timer."""
    return df.agg(F.count("*").alias("num_threads"), *[F.sum(c).alias(c) for c in sums or SUMS])


def failures(df: DataFrame, order: str, status: str = "status") -> DataFrame:
    """One row: the messages of all failed workers, and that of the first."""
    bad = F.array_sort(F.collect_list(F.when(F.col(status).isNotNull(), F.struct(order, status))))
    return df.agg(bad.alias("__b")).select(F.array_join(F.transform("__b", lambda x: x[status]), "\n").alias("messages"), F.get("__b", F.lit(0))[status].alias("first"))


def throughput(rolled: DataFrame, seconds: str = "t_parse") -> DataFrame:
    """Rates of a rollup; the mean time is the total by the number of workers.  No time gives no rates."""
    mean = F.try_divide(F.col(seconds), F.col("num_threads"))
    rate = lambda x: F.try_divide(x, mean)
    per = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(0.0)
    return rolled.select(
        rate(F.col("json_bytes") / 1e6).alias("mb_per_s"),
        rate(F.col("json_bytes") / 2**20).alias("mib_per_s"),
        rate(F.col("num_jsons") / 1e6).alias("mjson_per_s"),
        per("ipc_bytes", "num_jsons").alias("bytes_per_json"),
        F.when(F.col("num_ipc") > 0, F.expr("ipc_bytes div num_ipc")).otherwise(0).cast("long").alias("bytes_per_message"),
    )


def stage_latency(df: DataFrame, keys: list[str], stage: str, at: str, name: str = "latency_us") -> DataFrame:
    """Microseconds since the stage before, for every stage but the first."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    before = F.lag(micros).over(Window.partitionBy(*keys).orderBy(stage))
    return df.withColumn(name, micros - before).filter(F.col(name).isNotNull())


def latency_columns(df: DataFrame, stages: list[str] | None = None) -> DataFrame:
    """first_seq, last_seq and a column for each stage but the first: nanoseconds since the one before."""
    stages = stages or STAGES
    return df.select("first_seq", "last_seq", *[((F.unix_micros(b) - F.unix_micros(a)) * 1000).alias(b) for a, b in zip(stages, stages[1:])])


def latency_file(messages: DataFrame) -> DataFrame:
    """First, Last and a column for each stage but the first, from instants in nanoseconds: time since the stage before."""
    own = [((F.col(b) - F.col(a)).cast("long")).alias(b.capitalize()) for a, b in zip(STAGES, STAGES[1:])]
    return messages.select(F.col("first_seq").alias("First"), F.col("last_seq").alias("Last"), *own)


def publisher_rollup(df: DataFrame) -> DataFrame:
    """One row: sums over the publishers, and whether all went well."""
    sums = [F.sum(c).alias(c) for c in ("rows", "ipc", "publish_time", "thread_time")]
    return df.agg(F.count("*").alias("publishers"), *sums, F.every(F.col("status").isNull()).alias("ok"))


def mean_latency_ms(nanos: Column) -> Column:
    return F.sum(nanos) / F.count(nanos) * 1e-6


def goodput(messages: Column, size: Column, seconds: Column) -> Column:
    return 1e-6 * messages * size / seconds


def size_stats(df: DataFrame, value: str = "value") -> DataFrame:
    return df.agg(F.count("*").alias("records"), F.sum(F.length(value)).alias("total_chars"), F.max(F.length(value)).cast("long").alias("largest"))


def bytes_per_source(df: DataFrame, source: str, value: str = "value") -> DataFrame:
    """Bytes that every source delivered, a line break for each record included."""
    return df.groupBy(source).agg(F.sum((F.octet_length(value) + 1).cast("long")).alias("bytes"), F.count("*").alias("records"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
