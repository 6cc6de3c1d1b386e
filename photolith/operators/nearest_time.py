"""The anchor nearest in time, on the same day and within a window.

Answers are found for times, not for rows: anchors of one time come down to the first and the last of them, targets of one time to that
time, both before any shuffle. Times are dealt by day and `bucket_minutes` of the day. Within its bucket a time finds the neighbouring
anchors with a window function; beyond it, the last anchor of the buckets before and the first of those after come from a summary with
one row per bucket, at most a day's number of buckets per day. The answers then go back to the targets by a join on the time, dealt anew
on both sides, so that a time that very many targets share (a clock never set) can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from photolith.functions import values
from photolith.functions.keys import dealt_anew


def nearest(targets: DataFrame, anchors: DataFrame, time: str, ident: str, carry: list[str], window_hours: float, bucket_minutes: int = 10) -> DataFrame:
    """The targets that have an anchor in reach, with the anchor's ident and time (`anchor_...`), its `carry` columns, and gap_s.

    An anchor counts if it's on the same calendar day and no further than the window; of two equally near ones the
    earlier wins, of several at one time the last id before the target and the first id after it. Rows without a time are
    neither targets nor anchors; a null id sorts first; repeated targets are answered each on its own; an empty table on either side gives no rows.
    """
    record = F.struct(F.col(time).alias("t"), F.col(ident).alias("i"), *[F.col(c).alias(c) for c in carry])
    points = anchors.filter(F.col(time).isNotNull()).select(F.col(time).alias("_t"), record.alias("_anchor"))
    points = points.groupBy("_t").agg(F.min_by("_anchor", F.struct("_anchor.i")).alias("first"), F.max_by("_anchor", F.struct("_anchor.i")).alias("last"))
    none = F.lit(None).cast(points.schema["last"].dataType)
    # The target's columns travel as one, so none of them can clash with the names used here.
    asked = targets.filter(F.col(time).isNotNull()).select(F.col(time).alias("_t"), F.struct(*[F.col(f"`{c}`") for c in targets.columns]).alias("_target"))

    wanted = asked.select("_t", none.alias("first"), none.alias("last"), F.lit(True).alias("_asked")).distinct()
    times = points.withColumn("_asked", F.lit(None).cast("boolean")).unionByName(wanted)
    times = times.groupBy("_t").agg(F.first("first", ignorenulls=True).alias("first"), F.first("last", ignorenulls=True).alias("last"), F.max("_asked").alias("_asked"))
    times = times.withColumns({"_day": F.to_date("_t"), "_part": F.floor((F.hour("_t") * 60 + F.minute("_t")) / bucket_minutes)})

    parts = times.groupBy("_day", "_part").agg(F.min_by("first", F.when(F.col("first").isNotNull(), F.col("_t"))).alias("first"), F.max_by("last", F.when(F.col("last").isNotNull(), F.col("_t"))).alias("last"))
    by_day = Window.partitionBy("_day").orderBy("_part")
    far = parts.select("_day", "_part", _last(by_day).alias("_before"), F.first("first", ignorenulls=True).over(by_day.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))

    # An anchor at the very time of a target counts as one after it.
    order = Window.partitionBy("_day", "_part").orderBy("_t")
    near = times.withColumns({"_prev": _last(order), "_next": F.first("first", ignorenulls=True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
    found = near.filter("_asked").join(far, ["_day", "_part"]).withColumns({"_prev": F.coalesce("_prev", "_before"), "_next": F.coalesce("_next", "_after")})
    limit = F.lit(float(window_hours) * 3600)
    gap = {side: values.gap_seconds(F.col(f"{side}.t"), F.col("_t")) for side in ("_prev", "_next")}
    found = found.withColumns({"_gp": F.when(gap["_prev"] <= limit, gap["_prev"]), "_gn": F.when(gap["_next"] <= limit, gap["_next"])})
    use_next = F.col("_gn").isNotNull() & (F.col("_gp").isNull() | (F.col("_gn") < F.col("_gp")))
    best = F.when(use_next, F.col("_next")).when(F.col("_gp").isNotNull(), F.col("_prev"))
    answers = found.select("_t", F.col("_t").cast("string").alias("_key"), best.alias("_best"), F.least("_gp", "_gn").alias("_gap")).filter("_best IS NOT NULL")

    # Text alone could name two times, where clocks are set back.
    joined = asked.withColumn("_key", F.col("_t").cast("string")).join(dealt_anew(answers, "_key"), ["_key", "_t"])
    return joined.select("_target.*", F.col("_best.i").alias(f"anchor_{ident}"), F.col("_best.t").alias(f"anchor_{time}"), *[F.col(f"_best.{c}").alias(f"anchor_{c}") for c in carry], F.col("_gap").alias("gap_s"))


def _last(order: WindowSpec) -> Column:
    """The last anchor of the rows before this one."""
    return F.last("last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
