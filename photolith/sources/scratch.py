"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from photolith.errors import SourceError


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` as the cluster sets it; a temporary folder only where it's unset and everything runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise SourceError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"{tempfile.gettempdir()}/photolith-scratch"
    return found


def settle(df: DataFrame, name: str) -> DataFrame:
    """`df` written and read again, so that its lineage ends and its rows can't change on a second reading."""
    path = f"{shared_folder(df.sparkSession)}/photolith/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what `settle` wrote, once nothing that is still to run reads it."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
