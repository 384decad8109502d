"""Helpers shared by the corpus operators: table access and durable intermediate tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where the session has it.

    Only a local session without that setting (tests) gets a temporary folder of its own.
    """
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own is None:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = getattr(shared_dir, "_local", None)
        if own is None:
            own = shared_dir._local = tempfile.mkdtemp(prefix="rillway-")
    return own.rstrip("/")


#: Spark removes the shuffle files of a query when it ends; nothing reads them once its table is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs a re-read and not a recomputation.  The files
    go when the driver process ends, or earlier by drop_materialized().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rillway-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _written.append((spark, path))
    return spark.read.schema(schema).parquet(path)


_written: list[tuple[SparkSession, str]] = []


def written() -> int:
    """How many tables materialize() has written that are still there."""
    return len(_written)


def drop_materialized(since: int = 0, but: int = 0) -> None:
    """Delete the tables that materialize() has written, from the since-th on, without the last few."""
    last = len(_written) - but
    gone, _written[since:last] = _written[since:last], []
    for spark, path in gone:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM may be gone at exit; the shared folder is scratch space
            if os.path.isdir(path):
                import shutil

                shutil.rmtree(path, ignore_errors=True)


@atexit.register
def _at_exit() -> None:
    try:
        drop_materialized()
    except BaseException:
        pass
