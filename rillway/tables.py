"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session without it gets a temporary folder of its own."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own is None:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="rillway-"))
        own = _local[0]
    return own.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted with the tables."""
    path = f"{shared_dir(spark)}/rillway-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written_out(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet and read back: whoever reads it sees the same rows, and lost executors cost a re-read."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def count() -> int:
    return len(_written)


def drop(since: int = 0) -> None:
    """Delete the tables written from the since-th on."""
    gone, _written[since:] = _written[since:], []
    for spark, path in gone:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _at_exit() -> None:
    try:
        drop()
    except BaseException:  # the session may be gone
        pass
