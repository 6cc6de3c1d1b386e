"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


FILE_BYTES = 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`; a temporary folder only where none is set and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"{tempfile.gettempdir()}/photolith-checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/photolith/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df`, written as a table and read again: its lineage ends there and its partitioning is forgotten."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def stored_compact(df: DataFrame, name: str) -> DataFrame:
    """As `stored`; a table of many files that hold little is written again in as few as its bytes need."""
    out = stored(df, name)
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(out.stored_at)
    summary = path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path)
    wanted = 1 + summary.getLength() // FILE_BYTES
    if summary.getFileCount() <= 4 * wanted + 12:
        return out
    again = stored(out.coalesce(wanted), name)
    drop(out)
    return again


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Delete the tables behind what `stored` returned, once nothing that is still to run reads them."""
    for df in tables:
        delete(df.sparkSession, df.stored_at)
