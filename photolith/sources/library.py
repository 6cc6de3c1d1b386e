"""Photo libraries as tables of items."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolith import schemas
from photolith.config import Family
from photolith.errors import SourceError
from photolith.functions import dates, paths, text
from photolith.operators.upsert import first_of_each

#: The columns of a library snapshot that the contract depends on.
REQUIRED = ("uuid", "original_filename", "date", "persons", "albums", "screenshot", "hidden", "intrash", "shared", "isphoto", "ismovie", "live_photo", "ismissing", "original_filesize", "path")


def to_items(photos: DataFrame, strict: bool = True) -> DataFrame:
    """A library snapshot as items. Absent values take the safe side: an unknown owner isn't the contributor."""
    lacking = schemas.missing_columns(photos, REQUIRED)
    if lacking and strict:
        raise SourceError(f"the library lacks {', '.join(lacking)}")
    types = {"date": "timestamp_ntz", "persons": "array<string>", "albums": "array<string>", "original_filesize": "bigint"}
    texts = ("uuid", "original_filename", "path")
    get = lambda c: (F.col(c) if c in photos.columns else F.lit(None)).cast(types.get(c, "string" if c in texts else "boolean"))
    flag = lambda c, absent: F.coalesce(get(c), F.lit(absent))
    name = F.coalesce(get("original_filename"), F.lit(""))
    return photos.select(
        get("uuid").alias("uuid"), name.alias("original_filename"), dates.known_date(get("date")).alias("date"), text.real_names(get("persons")).alias("persons"), text.real_names(get("albums")).alias("albums"),
        (flag("screenshot", False) | paths.looks_like_screenshot(name)).alias("is_screenshot"), flag("hidden", False).alias("is_hidden"), flag("intrash", False).alias("in_trash"), flag("shared", True).alias("is_shared"),
        flag("isphoto", True).alias("is_photo"), flag("ismovie", False).alias("is_movie"), flag("live_photo", False).alias("is_live_photo"), flag("ismissing", False).alias("is_missing"),
        F.coalesce(get("original_filesize"), F.lit(0)).cast("bigint").alias("filesize"), get("path").alias("path"),
    )


def all_items(live: DataFrame, trashed: DataFrame) -> DataFrame:
    """Live and trashed items, each uuid once; the live one wins."""
    both = live.withColumn("_from", F.lit(0)).unionByName(trashed.withColumn("_from", F.lit(1)))
    return first_of_each(both, ["uuid"], ["_from", *[c for c in ("original_filename", "path") if c in live.columns]]).drop("_from")


def demo(spark: SparkSession, family: Family, cutoff: date, each: int = 2) -> DataFrame:
    """A made-up library for trying things out, enumerated from the contract's own rules.

    For every way an item can be ruled on (the flag or date that decides it) and every subject tagged or none, there are `each` items,
    spread over the years around the cutoff; every third is a film, every fifth lies only in the cloud.
    """
    names = [s.name for s in family.subjects] or ["Someone"]
    tags = F.array(F.array().cast("array<string>"), *[F.array(F.lit(n)) for n in names])
    deciding = F.array(*[F.lit(x) for x in ("nothing", "screenshot", "shared", "hidden", "intrash", "album", "undated")])
    cases = spark.range(1).select(F.explode(deciding).alias("why"), F.lit(0).alias("one"))
    cases = cases.select("why", F.explode(tags).alias("persons")).select("why", "persons", F.explode(F.array(F.lit(-1), F.lit(1))).alias("side"))
    cases = cases.select("why", "persons", "side", F.explode(F.sequence(F.lit(1), F.lit(each))).alias("nth"))
    label = F.concat_ws("-", "why", F.when(F.col("side") < 0, "before").otherwise("after"), F.coalesce(F.try_element_at("persons", F.lit(1)), F.lit("nobody")), "nth")
    turn = F.pmod(F.xxhash64(label), F.lit(1000))
    film = turn % 3 == 0
    away = F.col("side") * (1 + turn * 2)
    rows = cases.select(
        F.sha1(label.cast("binary")).alias("uuid"), F.concat(label, F.when(film, ".mov").otherwise(".heic")).alias("original_filename"),
        F.when(F.col("why") != "undated", F.date_add(F.lit(cutoff), away.cast("int")).cast("timestamp_ntz")).alias("date"), "persons",
        F.when(F.col("why") == "album", F.array(F.lit("Recently Deleted"))).otherwise(F.array().cast("array<string>")).alias("albums"),
        *[(F.col("why") == c).alias(c) for c in ("screenshot", "hidden", "intrash", "shared")],
        (~film).alias("isphoto"), film.alias("ismovie"), (~film & (turn % 7 == 0)).alias("live_photo"), (turn % 5 == 0).alias("ismissing"),
        (turn * 10_007 + 200_000).alias("original_filesize"), F.lit(None).cast("string").alias("path"),
    )
    return to_items(rows)
