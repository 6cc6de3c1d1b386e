"""Statistics that are kept with the parts of a table, made when a part is written and put together when they're asked for.

A part's summary is a few numbers in the index's state. Counts and bytes add up, the earliest and the latest date are compared, and what must be
counted distinct over all parts has its ids as bitmaps beside the part, 32,768 ids to a row, which are joined by OR. So statistics read
no rows of a table, also after it was replaced, and cost what the number of parts and of distinct ids asks for.
"""

from __future__ import annotations

from collections import Counter
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolith import schemas
from photolith.operators import stats

#: Columns whose distinct values are counted over all parts of a table, and those by which rows are counted.
DISTINCT = {"asset_persons": "asset_id"}
GROUPED = {"linked_files": ("reason",), "review_queue": ("status", "kind")}
EXTREMES = {"earliest": min, "latest": max}


def summary(table: str, rows: DataFrame) -> dict:
    """What is kept of a part's rows, as JSON can hold it."""
    if table == "assets":
        said = stats.asset_stats(rows).head().asDict()
        return {k: v.isoformat() if isinstance(v, datetime) else v for k, v in said.items()}
    if table in GROUPED:
        keys = GROUPED[table]
        return {"groups": [[*r] for r in rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).collect()]}
    return {"rows": rows.count()}


def ids(table: str, rows: DataFrame) -> DataFrame | None:
    """(bucket, bits): the distinct ids of a part, or None if the table has none to count."""
    if table not in DISTINCT:
        return None
    own = F.col(DISTINCT[table])
    return rows.groupBy(F.bitmap_bucket_number(own).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(own)).alias("bits"))


def distinct(bitmaps: DataFrame) -> DataFrame:
    """How many distinct ids the bitmaps of several parts hold; one row."""
    joined = bitmaps.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return joined.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))


def assets(parts: list[dict]) -> dict:
    """The statistics of all parts of the assets together."""
    out: dict = {}
    for part in parts:
        for k, v in part.items():
            if k in EXTREMES:
                known = [x for x in (out.get(k), v) if x is not None]
                out[k] = EXTREMES[k](known) if known else None
            else:
                out[k] = out.get(k, 0) + v
    return out


def grouped(parts: list[dict]) -> Counter:
    """How many rows each group of all parts together has."""
    out: Counter = Counter()
    for part in parts:
        for *key, n in part["groups"]:
            out[tuple(key)] += n
    return out


def one_row(spark: SparkSession, kept: dict[str, list[dict]], tagged: int) -> DataFrame:
    """The same row as `stats.index_stats` makes by reading the tables."""
    empty = spark.createDataFrame([], schemas.ASSETS)
    schema = stats.asset_stats(empty).schema
    said = assets([{f.name: None if f.name in EXTREMES else 0 for f in schema}, *kept["assets"]])
    row = [datetime.fromisoformat(v) if k in EXTREMES and v is not None else v for k, v in ((f.name, said[f.name]) for f in schema)]
    rest = {
        "linked_files": grouped(kept["linked_files"]).total(),
        "open_reviews": sum(n for (status, _), n in grouped(kept["review_queue"]).items() if status == "open"),
        "sources": sum(p["rows"] for p in kept["sources"]),
        "tagged_people": tagged,
    }
    found = spark.createDataFrame([tuple(row)], schema)
    return found.select("*", *[F.lit(v).cast("bigint").alias(k) for k, v in rest.items()])
