"""Intermediate tables in the folder that the driver and all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``: unlike a local
checkpoint, such a table survives the loss of any executor.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
#: Set while a table is written. Shuffle files go when the query that made them has ended, since a written table
#: needs them no more; and a batch that goes to Python holds so many bytes at most, as it lies in memory several times.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder as the cluster names it.

    Where it is unset, a session in one process (tests, local runs) gets a new temporary folder;
    on a cluster, whose executors would each write to their own disks, that is an error.
    """
    root = spark.conf.get(_SETTING, None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{_SETTING} must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(_SETTING, root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call gets."""
    return f"{scratch_dir(spark)}/tidemark-{uuid.uuid4().hex}/{name}"


@contextmanager
def settings_of(spark: SparkSession, settings: Mapping[str, str]) -> Iterator[None]:
    """These settings of the session for a while."""
    was = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, name: str, compression: str = "snappy", files: Mapping[str, int] | None = None) -> DataFrame:
    """Write ``df`` once, with ``files`` as options of the format, and return the written table; what follows never recomputes ``df``."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with settings_of(spark, _WHILE_WRITING):
        df.write.options(**(files or {})).option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` returned and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            if path.getParent().getName().startswith("tidemark-"):
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path.getParent(), True)
