"""A topic as a directory: its schema first, then messages.

Opening a topic writes the schema if there is none, and otherwise compares: another schema refuses to
start.  Messages are appended as Parquet, under the number of the micro-batch that brought them, so
that a repeated micro-batch replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class SchemaMismatch(ValueError):
    pass


class Topic:
    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        stored = self.stored_schema(spark, path)
        if stored is None:
            spark.createDataFrame([(schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/schema")
        elif stored != schema:
            raise SchemaMismatch(f"the topic's schema is {stored.simpleString()}, that of the messages {schema.simpleString()}")

    @staticmethod
    def stored_schema(spark: SparkSession, path: str) -> StructType | None:
        import json

        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/schema")
        if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return None
        return StructType.fromJson(json.loads(spark.read.text(f"{path.rstrip('/')}/schema").first()["value"]))

    def publish(self, messages: DataFrame, batch: int = 0, per_file: int | None = None) -> None:
        writer = messages.write.mode("overwrite")
        (writer.option("maxRecordsPerFile", per_file) if per_file else writer).parquet(f"{self.path}/messages/batch={batch}")

    def messages(self) -> DataFrame:
        return self._read(f"{self.path}/messages")

    def batch(self, batch: int) -> DataFrame:
        return self._read(f"{self.path}/messages/batch={batch}")

    def _read(self, path: str) -> DataFrame:
        """Messages may be a file each, of which Spark gives a task only a few: these share as many tasks as their bytes ask
        for, but four for every core at least."""
        rows, session = self.spark.read.parquet(path), self.spark._jsparkSession.sessionState()
        size = int(rows._jdf.queryExecution().analyzed().stats().sizeInBytes())
        return rows.coalesce(max(4 * self.spark.sparkContext.defaultParallelism, -(-size // session.conf().filesMaxPartitionBytes())))
