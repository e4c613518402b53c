"""Reading and writing tables: parquet and CSV sinks, landing files, keys still to land."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, optional: bool = False) -> DataFrame | None:
    """A parquet table; None if ``optional`` and absent."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    try:
        return reader.parquet(path)
    except AnalysisException as e:
        if optional and "PATH_NOT_FOUND" in str(e):
            return None
        raise


#: Bytes of a file that might be a placeholder: one without columns has a footer only.
PLACEHOLDER = 1 << 20


def readable_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths of the parquet files of ``pattern`` whose footer lists any column.

    Landing jobs leave placeholder files without columns, which no parquet scan survives. Files
    over ``PLACEHOLDER`` bytes are told by their listed length alone; only smaller ones are opened.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(pattern)
    large = files.filter(F.col("length") > PLACEHOLDER).select("path")

    def with_columns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa
        import pyarrow.parquet as pq

        for batch in batches:
            keep = [len(pq.read_schema(pa.BufferReader(x))) > 0 for x in batch["content"]]
            yield batch.loc[keep, ["path"]]

    small = files.filter(F.col("length") <= PLACEHOLDER).select("path", "content").mapInPandas(with_columns, "path string")
    return sorted(r.path for r in large.union(small).collect())


def merge_landing(spark: SparkSession, pattern: str, schema: T.StructType | str, key: str | None = None) -> DataFrame:
    """One table of all landing files; with ``key``, that column is taken from the file's name."""
    paths = readable_files(spark, pattern)
    if not paths:
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).parquet(*paths)
    if key is None:
        return df
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.parquet$", 1)
    return df.withColumn(key, name)


def pending_keys(universe: DataFrame, landed: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Keys of the universe that have not landed; the first ``limit`` in order if given."""
    left = universe.select(key).distinct().join(landed.select(key).distinct(), key, "left_anti")
    return left if limit is None else left.orderBy(key).limit(limit)


def write_by_year(df: DataFrame, path: str, date: str = "date", key: str = "stock_id", tasks: int = 16, rows_per_file: int = 5_000_000) -> None:
    """Parquet partitioned by the year of ``date``; a year is ``tasks`` tasks, dealt by ``key`` (by the whole row if there is none), its files bounded."""
    by = [key] if key in df.columns else df.columns
    dealt = df.withColumn("year", F.year(date)).repartition("year", F.pmod(F.xxhash64(*by), F.lit(tasks)))
    dealt.sortWithinPartitions("year", *by[:1], date).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("year").parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, key: str = "stock_id", order: str = "date", buckets: int = 64) -> DataFrame:
    """The table written in buckets of ``key``, each one file sorted by ``key`` and ``order``, and read back.

    Rows are dealt by the buckets' own hash, so a task writes one file. Windows and joins by
    ``key`` over what is read shuffle no more. Buckets are to be as many as keep a file to about a GB.
    """
    df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key, order).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def write_report(df: DataFrame, path: str) -> None:
    """One CSV file with a header, for results that are already small."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
