"""Documents that arrive in a landing folder, a few files a trigger, each document written once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_landing(spark: SparkSession, path: str, schema: StructType, *, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest(stream: DataFrame, process: Callable[[DataFrame], DataFrame], *, target: str, checkpoint: str) -> StreamingQuery:
    """Run `process` on each micro-batch and write its rows under target/batch=<number>.

    A batch that is repeated after a failure overwrites its own folder, so the sink holds every row once.
    """

    def write(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
