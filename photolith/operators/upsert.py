"""Insert-or-ignore, get-or-create and updates on tables of plain files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photolith.functions.keys import unused
from photolith.sources.scratch import settle


def first_of_each(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in an order; ranks are limited before the shuffle. Null keys are one key; of equal rows one stays; an empty table gives none."""
    (nth,) = unused(df, "_nth")
    return df.withColumn(nth, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col(nth) == 1).drop(nth)


def numbered(df: DataFrame, order: list[str], start: int, name: str = "id") -> DataFrame:
    """`df` with consecutive numbers from `start` in an order, without gathering rows in one task.

    Range partitions are in order; only their sizes come to the driver.
    """
    (part,) = unused(df, "_at")
    ranged = settle(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "numbered")
    sizes = sorted((r[0], r[1]) for r in ranged.groupBy(part).agg(F.count(F.lit(1))).collect())
    offset, at = {}, start
    for k, size in sizes:
        offset[k], at = at, at + size
    if not offset:
        return ranged.withColumn(name, F.lit(None).cast("bigint")).drop(part)
    first = F.element_at(F.create_map(*[F.lit(x).cast("bigint" if i % 2 else "int") for kv in offset.items() for i, x in enumerate(kv)]), F.col(part))
    nth = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return ranged.withColumn(name, (first + nth - 1).cast("bigint")).drop(part)


def new_rows(table: DataFrame, rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The rows to insert: of each key the first, and only keys that the table doesn't have."""
    return first_of_each(rows, key, order).join(table.select(*key), key, "left_anti")


def get_or_create(table: DataFrame, names: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The table with rows (id, name) for all names, and only the new ones; new ids follow the largest in order of name."""
    fresh = names.select(name).filter(F.col(name).isNotNull()).distinct().join(table.select(name), name, "left_anti")
    start = (table.agg(F.max("id")).head()[0] or 0) + 1
    fresh = numbered(fresh, [name], start).select("id", name)
    return table.select("id", name).unionByName(fresh), fresh


def resolve_review(reviews: DataFrame, ids: list[int], resolution: str, at) -> DataFrame:
    """`reviews` with some resolved; ids that aren't there change nothing."""
    chosen = F.col("id").isin(*ids) if ids else F.lit(False)
    to = {"status": F.lit("resolved"), "resolution": F.lit(resolution), "resolved_at": F.lit(at).cast("timestamp")}
    return reviews.withColumns({k: F.when(chosen, v).otherwise(F.col(k)) for k, v in to.items()})
