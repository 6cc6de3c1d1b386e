"""An inbox that is taken in as a stream of batches: an addition to the batch run, with the same plan."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from photolith import schemas
from photolith.plans.ingest import apply_plan, plan_ingest
from photolith.sources.catalog import Catalog


def take_in(spark: SparkSession, inbox: str, catalog: Catalog, checkpoint: str, at: datetime, threshold: int = 8, source: str | None = None):
    """Ingest what has arrived as Parquet files of identified rows since the last call, then stop.

    A batch that is run again after a failure imports nothing twice: its files are exact duplicates then.
    """

    def batch(rows: DataFrame, _: int) -> None:
        plan = plan_ingest(rows, catalog.read("assets"), catalog.read("linked_files"), catalog.read("review_queue"), threshold)
        apply_plan(plan, catalog, at, source)

    stream = spark.readStream.schema(schemas.IDENTIFIED).parquet(inbox)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
