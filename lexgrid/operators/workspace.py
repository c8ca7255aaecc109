"""Tables written once and read again: a table that several branches of a plan read is computed once, and outlives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, removed when the driver's JVM ends; a local one only on a local master where that is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/lexgrid-checkpoints"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/lexgrid-{uuid.uuid4().hex}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{path.toString()}/table"


def materialise(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read from there."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
