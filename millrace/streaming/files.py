"""File streams.  The engine itself is a batch engine; stateless plans also run on what has newly arrived."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def run_available(
    spark: SparkSession, source: str, schema: T.StructType, step: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, max_files: int = 1000
) -> None:
    """Apply a stateless ``step`` to the Parquet files in ``source`` not yet seen, append to ``target``, and end."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    writer = step(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
