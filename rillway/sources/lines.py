"""Sources of newline-terminated records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """value, and origin and block (file and place of the split), which give an order to what is read."""
    lines = spark.read.text(path, lineSep="\n")
    return lines.select("value", F.col("_metadata.file_name").alias("origin"), F.col("_metadata.file_block_start").alias("block"))


def text_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text").option("lineSep", "\n")
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def socket_stream(spark: SparkSession, host: str = "localhost", port: int = 10197) -> DataFrame:
    """Lines from a TCP server.  For demonstration: what was received is lost with the query."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def without_blank_lines(df: DataFrame, value: str = "value") -> DataFrame:
    return df.filter(F.length(F.trim(F.col(value))) > 0)


def payloads(spark: SparkSession, count: int, size: int, letter: str = "A") -> DataFrame:
    """count messages of size equal bytes."""
    return spark.range(count).select(F.col("id").alias("seq"), F.repeat(F.lit(letter), size).cast("binary").alias("message"))


def record_batch_file(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an Arrow file that holds exactly one batch; the file is read by the driver."""
    import pyarrow as pa

    from rillway.functions.schema import from_arrow
    from rillway.operators.batching import _loose
    from rillway.operators.parse import _plain

    with pa.memory_map(path) as f:
        try:
            reader = pa.ipc.open_file(f)
            batches = [reader.get_batch(i) for i in range(reader.num_record_batches)]
        except pa.ArrowInvalid:
            f.seek(0)
            batches = list(pa.ipc.open_stream(f))
    if len(batches) != 1:
        raise OSError(f"{path} holds {len(batches)} batches; one is expected")
    batch = batches[0]
    plain = pa.schema([pa.field(x.name, _plain(_loose(x.type))) for x in batch.schema])
    columns = [c.cast(_loose(c.type)) if pa.types.is_fixed_size_list(c.type) else c for c in batch.columns]
    return spark.createDataFrame(pa.table(columns, names=batch.schema.names).cast(plain), from_arrow(batch.schema).simpleString())
