"""Index statistics and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def asset_stats(assets: DataFrame) -> DataFrame:
    """Counts, bytes and dates of the assets in one pass."""
    return assets.agg(
        F.count(F.lit(1)).alias("assets"), F.coalesce(F.sum("filesize"), F.lit(0)).alias("total_bytes"),
        F.count_if(F.col("media_type") == "photo").alias("photos"), F.count_if(F.col("media_type") == "video").alias("videos"),
        F.count_if(F.col("taken_at").isNull()).alias("undated"), F.count_if(F.col("gps_latitude").isNotNull()).alias("located"),
        F.count_if(F.col("gps_source") == "inferred").alias("located_inferred"), F.min("taken_at").alias("earliest"), F.max("taken_at").alias("latest"),
    )


def index_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """One row over all tables: asset_stats and the counts of links, open reviews, sources and tagged assets."""
    one = asset_stats(tables["assets"])
    parts = (
        tables["linked_files"].agg(F.count(F.lit(1)).alias("linked_files")),
        tables["review_queue"].agg(F.count_if(F.col("status") == "open").alias("open_reviews")),
        tables["sources"].agg(F.count(F.lit(1)).alias("sources")),
        tables["asset_persons"].agg(F.count_distinct("asset_id").alias("tagged_people")),
    )
    for part in parts:
        one = one.join(F.broadcast(part))  # one row each
    return one


def counted(df: DataFrame, key: str, where: Column | None = None) -> DataFrame:
    """How many rows each value of `key` has: open reviews by kind, links by reason."""
    return (df.filter(where) if where is not None else df).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def listed(df: DataFrame, limit: int | None = None, order: str = "id", **equal) -> DataFrame:
    """Rows that equal all the values given (None: any), ordered, at most `limit`: a listing for people."""
    for column, value in equal.items():
        if value is not None:
            df = df.filter(F.col(column) == F.lit(value))
    df = df.orderBy(order)
    return df if limit is None else df.limit(limit)


def listed_with_rest(df: DataFrame, limit: int, order: str = "id", **equal) -> DataFrame:
    """As `listed`, with n_more: how many rows the limit leaves out ("and N more"). One count with partial aggregation beside a top-k."""
    every = listed(df, None, order, **equal)
    n = F.count(F.lit(1))
    return every.limit(limit).join(F.broadcast(every.agg((n - F.least(n, F.lit(limit))).alias("n_more"))))  # one row


def names_of(asset_persons: DataFrame, persons: DataFrame) -> DataFrame:
    """(asset_id, name) of all tags."""
    return asset_persons.join(persons.select(F.col("id").alias("person_id"), "name"), "person_id").select("asset_id", "name")
