"""What a contract's rulings add up to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolith.functions import values
from photolith.operators.contract import DISPOSITIONS, INCLUDED, REVIEW


def summary(decisions: DataFrame) -> DataFrame:
    """One row of counts, bytes and dates; one pass with partial aggregation."""
    size = F.coalesce(F.col("filesize"), F.lit(0))
    is_in = F.col("disposition").isin(*INCLUDED)
    movie, live, missing = (F.coalesce(F.col(c), F.lit(False)) for c in ("is_movie", "is_live_photo", "is_missing"))
    count = lambda c: F.count_if(c)
    total = lambda c: F.coalesce(F.sum(F.when(c, size)), F.lit(0)).cast("bigint")
    found = decisions.agg(
        F.count(F.lit(1)).alias("scanned"), count(is_in).alias("included_count"), total(is_in).alias("included_bytes"),
        count(~is_in & (F.col("disposition") != REVIEW)).alias("excluded_count"), count(F.col("disposition") == REVIEW).alias("review_count"),
        count(is_in & ~movie).alias("included_photos"), count(is_in & movie).alias("included_movies"), count(is_in & live).alias("included_live_photos"),
        count(is_in & missing).alias("cloud_only_count"), total(is_in & missing).alias("cloud_only_bytes"),
        count(F.col("in_untagged_window")).alias("window_count"), total(F.col("in_untagged_window")).alias("window_bytes"),
        F.min(F.when(is_in, F.col("date"))).alias("earliest"), F.max(F.when(is_in, F.col("date"))).alias("latest"),
    )
    return found.withColumn("estimated_hours", values.download_hours(F.col("cloud_only_bytes")))


def by_disposition(decisions: DataFrame) -> DataFrame:
    """Count and bytes of every disposition, those that don't occur with zeros."""
    spark = decisions.sparkSession
    every = spark.createDataFrame([(i, d) for i, d in enumerate(DISPOSITIONS)], "ordinal int, disposition string")
    found = decisions.groupBy("disposition").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("filesize"), F.lit(0)).alias("n_bytes"))
    return F.broadcast(every).join(found, "disposition", "left").select("ordinal", "disposition", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"))


def by_subject(decisions: DataFrame) -> DataFrame:
    """How many included items show each subject; an item counts for all of its subjects."""
    rows = decisions.filter(F.col("disposition").isin(*INCLUDED)).select(F.explode("matched_subjects").alias("subject"))
    return rows.groupBy("subject").agg(F.count(F.lit(1)).alias("n"))


def unknown_dates(decisions: DataFrame) -> DataFrame:
    """File names (or uuids) of the items that go to review."""
    return decisions.filter(F.col("disposition") == REVIEW).select("uuid", F.coalesce(F.nullif("original_filename", F.lit("")), "uuid").alias("name"))
