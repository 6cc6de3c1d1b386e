"""People and places for assets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolith.config import Family
from photolith.functions import text, values
from photolith.functions.keys import unused
from photolith.operators.nearest_time import nearest


def person_tags(pairs: DataFrame, assets: DataFrame, family: Family) -> DataFrame:
    """Each name of each (sha256, names) row with the asset it belongs to: asset_id (null: no such asset), raw, person, known.

    Rows without a checksum or names aren't read. Checksums join anew on both sides, so AQE can split a hot one.
    """
    rows = pairs.filter((F.coalesce(F.col("sha256"), F.lit("")) != "") & (F.size("names") > 0))
    joined = rows.join(assets.select("sha256", F.col("id").alias("asset_id")), "sha256", "left")
    each = joined.select("sha256", "asset_id", F.explode("names").alias("raw"))
    subject = text.subject_of(F.col("raw"), family)
    return each.select("sha256", "asset_id", "raw", F.coalesce(subject, "raw").alias("person"), subject.isNotNull().alias("known"))


def person_counts(pairs: DataFrame, assets: DataFrame) -> DataFrame:
    """files_read, matched, unmatched and coverage of (sha256, names) rows."""
    rows = pairs.filter((F.coalesce(F.col("sha256"), F.lit("")) != "") & (F.size("names") > 0))
    joined = rows.join(assets.select("sha256", F.lit(True).alias("_there")), "sha256", "left")
    found = joined.agg(F.count(F.lit(1)).alias("files_read"), F.count("_there").alias("matched"))
    return found.withColumn("unmatched", F.col("files_read") - F.col("matched")).withColumn("coverage", values.ratio(F.col("matched"), F.col("files_read")))


def tally(tags: DataFrame) -> DataFrame:
    """How often each person was applied, and how often by names that aren't in the roster; names count as written, repeats too."""
    return tags.filter("asset_id IS NOT NULL").groupBy("person").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("known")).alias("n_unknown"))


def infer_locations(assets: DataFrame, window_hours: float = 6.0) -> DataFrame:
    """Updates (id, latitude, longitude, source, gap_s, confidence, band) for dated assets without a location.

    Anchors are assets with a recorded location only, so a guess never leads to another. A gap whose confidence
    rounds to 0 gives nothing.
    """
    anchors = assets.filter("gps_source = 'exif' AND gps_latitude IS NOT NULL")
    targets = assets.filter("gps_latitude IS NULL AND taken_at IS NOT NULL").select("id", "taken_at")
    found = nearest(targets, anchors, "taken_at", "id", ["gps_latitude", "gps_longitude"], window_hours)
    found = found.withColumn("confidence", values.confidence(F.col("gap_s"))).filter("confidence > 0")
    return found.select("id", F.col("anchor_gps_latitude").alias("latitude"), F.col("anchor_gps_longitude").alias("longitude"), F.lit("inferred").alias("source"), "gap_s", "confidence", values.band(F.col("gap_s")).alias("band"))


def location_counts(assets: DataFrame, updates: DataFrame) -> DataFrame:
    """considered, inferred, skipped, by band, and coverage."""
    asked = assets.filter("gps_latitude IS NULL AND taken_at IS NOT NULL").agg(F.count(F.lit(1)).alias("considered"))
    made = updates.agg(F.count(F.lit(1)).alias("inferred"), F.count_if(F.col("band") == "high").alias("high"), F.count_if(F.col("band") == "low").alias("low"))
    found = asked.join(F.broadcast(made))  # one row each
    return found.withColumn("skipped", F.col("considered") - F.col("inferred")).withColumn("coverage", values.ratio(F.col("inferred"), F.col("considered")))


def set_locations(assets: DataFrame, updates: DataFrame) -> DataFrame:
    """`assets` with updates (id, latitude, longitude, source) applied; a recorded location gives way only to another recorded one."""
    ident, lat, lon, source = unused(assets, "_id", "_lat", "_lon", "_source")
    new = updates.select(F.col("id").alias(ident), F.col("latitude").alias(lat), F.col("longitude").alias(lon), F.col("source").alias(source))
    joined = assets.join(new, F.col("id") == F.col(ident), "left")
    takes = F.col(ident).isNotNull() & ~(F.coalesce(F.col("gps_source") == "exif", F.lit(False)) & (F.col(source) != "exif"))
    to = {"gps_latitude": lat, "gps_longitude": lon, "gps_source": source}
    return joined.withColumns({k: F.when(takes, F.col(v)).otherwise(F.col(k)) for k, v in to.items()}).select(*assets.columns)


def backfill_candidates(assets: DataFrame) -> DataFrame:
    """Assets to read a location for: dated ones without any, and undated ones that aren't located."""
    missing = assets.filter("gps_latitude IS NULL AND taken_at IS NOT NULL")
    located = assets.filter("gps_latitude IS NOT NULL").select("id")
    return missing.unionByName(assets.filter("taken_at IS NULL").join(located, "id", "left_anti"))


def backfill(assets: DataFrame, read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Updates for, and counts of, the candidates, given what their files say: (vault_path, latitude, longitude); a path without a row is missing."""
    joined = backfill_candidates(assets).select("id", "vault_path").join(read.select("vault_path", "latitude", "longitude", F.lit(True).alias("_there")), "vault_path", "left")
    lat, lon = values.coordinates(F.col("latitude"), F.col("longitude"))
    joined = joined.select("id", "vault_path", lat.alias("latitude"), lon.alias("longitude"), F.coalesce("_there", F.lit(False)).alias("there"))
    updates = joined.filter("latitude IS NOT NULL").select("id", "latitude", "longitude", F.lit("exif").alias("source"))
    counts = joined.agg(F.count_if("there").alias("examined"), F.count("latitude").alias("located"), F.count_if(F.col("there") & F.col("latitude").isNull()).alias("still_unlocated"), F.count_if(~F.col("there")).alias("missing_files"))
    return updates, counts
