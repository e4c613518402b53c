"""Incremental ingest of landing files."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T


def ingest_landing(spark: SparkSession, landing: str, schema: T.StructType | str, out: str, checkpoint: str, files_per_batch: int = 1000) -> None:
    """Append the rows of files that came since the last call to the parquet table ``out``.

    The stream's checkpoint remembers the files, so a call that failed half way neither loses
    nor repeats any.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
