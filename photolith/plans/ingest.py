"""An ingest run as a plan: what would be imported, linked and queued. Carrying it out is a separate step (`photolith.plans.filing`), so a dry
run is the plan alone."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolith import schemas
from photolith.errors import ConstraintError
from photolith.functions import dates, paths, values
from photolith.functions.keys import dealt_anew, merged
from photolith.operators import dedupe, upsert
from photolith.sources.catalog import Catalog
from photolith.sources.scratch import settle


def filed(new: DataFrame, taken: DataFrame) -> DataFrame:
    """vault_path, spare_path and renamed for new files.

    A name goes to the first file that asks for it in its month's folder, unless the archive has it already; the others get eight
    digits of their checksum, which is everybody's spare name. `taken` holds the archive's (vault_path, sha256).
    """
    folder = F.concat(dates.month_directory(F.col("taken_at")), F.lit("/"))
    wished, old, first = upsert.unused(new, "_wish", "_old", "_first")
    rows = new.withColumn(wished, F.concat(folder, paths.name(F.col("path"))))
    # However many files ask for one name, only the best of them travels.
    best = rows.groupBy(wished).agg(F.min(F.struct(dedupe.order_key().alias("key"), "path")).alias(first)).select(wished, F.col(first)["path"].alias(first))
    rows = rows.join(merged(taken.select(F.col("vault_path").alias(wished), F.col("sha256").alias(old))), wished, "left")
    rows = rows.join(merged(dealt_anew(best, wished)), wished)
    free = (F.col(old).isNull() & (F.col(first) == F.col("path"))) | F.coalesce(F.col(old) == F.col("sha256"), F.lit(False))
    suffixed = F.concat(folder, paths.stem(F.col("path")), F.lit("-"), F.substring("sha256", 1, 8), paths.suffix(F.col("path")))
    rows = rows.withColumns({"renamed": ~free, "spare_path": suffixed})
    return rows.withColumn("vault_path", F.when(F.col("renamed"), suffixed).otherwise(F.col(wished))).drop(wished, old, first)


@dataclass
class Plan:
    """The verdicts of a batch, and the rows they lead to (without ids)."""

    verdicts: DataFrame
    assets: DataFrame
    links: DataFrame
    reviews: DataFrame

    def counts(self) -> DataFrame:
        """scanned, imported, linked, deferred, bytes, undated, renamed, and whether every file is accounted for."""
        size = F.coalesce(F.col("filesize"), F.lit(0))
        new, linked = F.col("verdict") == dedupe.NEW, F.col("verdict").isin(dedupe.EXACT, dedupe.TWIN)
        late = F.col("verdict").isin(dedupe.AMBIGUOUS, dedupe.HIGHER)
        total = lambda c: F.coalesce(F.sum(F.when(c, size)), F.lit(0)).alias
        found = self.verdicts.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(new).alias("imported"), F.count_if(linked).alias("linked"), F.count_if(late).alias("deferred"), total(new)("imported_bytes"), total(linked)("linked_bytes"), F.count_if(new & F.col("taken_at").isNull()).alias("undated"))
        found = found.join(F.broadcast(self.assets.agg(F.count_if("renamed").alias("renamed"))))  # one row each
        return found.withColumn("balanced", F.col("imported") + F.col("linked") + F.col("deferred") == F.col("scanned"))

    def reasons(self) -> DataFrame:
        """(kind, n) of links and review entries; an undated import is both imported and queued."""
        verdicts = self.verdicts.filter(F.col("verdict") != dedupe.NEW).select(F.col("verdict").alias("kind"))
        undated = self.verdicts.filter((F.col("verdict") == dedupe.NEW) & F.col("taken_at").isNull()).select(F.lit("unknown_date").alias("kind"))
        return verdicts.unionByName(undated).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def plan_ingest(identified: DataFrame, assets: DataFrame, links: DataFrame | None = None, reviews: DataFrame | None = None, threshold: int = 8) -> Plan:
    """What a run over identified files does to an archive."""
    files = identified.withColumn("bits", values.hash_words(F.col("phash")))
    archive = assets.withColumn("bits", values.hash_words(F.col("phash")))
    verdicts = settle(dedupe.greedy(files, archive, threshold), "verdicts")
    new = filed(verdicts.filter(F.col("verdict") == dedupe.NEW), assets)
    located = F.col("gps_latitude").isNotNull() & F.col("gps_longitude").isNotNull()
    new = new.withColumns({"original_filename": paths.name(F.col("path")), "media_type": paths.media_type(F.col("path")), "gps_source": F.when(located, "exif")})
    new = settle(new.select("path", "sha256", "phash", "vault_path", "spare_path", "original_filename", "taken_at", "taken_at_source", "media_type", "filesize", "width", "height", "gps_latitude", "gps_longitude", "gps_source", "renamed", dedupe.order_key().alias("rank")), "new-assets")

    linked = verdicts.filter(F.col("verdict").isin(dedupe.EXACT, dedupe.TWIN)).select("sha256", F.col("path").alias("original_path"), "master_id", "master_path", F.col("verdict").alias("reason"), "filesize")
    if links is not None:  # a path that has a link keeps the one it has
        linked = linked.join(merged(links.select("original_path")), "original_path", "left_anti")
    names = assets.select(F.col("id").alias("master_id"), F.col("vault_path").alias("_old"))
    fresh = new.select(F.col("path").alias("master_path"), F.col("vault_path").alias("_new"))
    late = verdicts.filter(F.col("verdict").isin(dedupe.AMBIGUOUS, dedupe.HIGHER)).join(merged(names), "master_id", "left").join(merged(fresh), "master_path", "left")
    detail = F.to_json(F.struct("distance", F.coalesce("_old", "_new").alias("master")))
    late = late.select(F.col("path").alias("original_path"), F.lit(None).cast("string").alias("asset_path"), F.col("verdict").alias("kind"), detail.alias("detail"))
    if reviews is not None:  # only an open entry stands in the way of another
        late = late.join(merged(reviews.filter("status = 'open'").select("original_path")), "original_path", "left_anti")
    undated = new.filter("taken_at IS NULL").select(F.col("path").alias("original_path"), F.col("path").alias("asset_path"), F.lit("unknown_date").alias("kind"), F.to_json(F.struct(F.col("original_filename").alias("filename"), "vault_path")).alias("detail"))
    return Plan(verdicts, new, linked, late.unionByName(undated))


def source_row(catalog: Catalog, label: str | None, at: datetime) -> tuple[int | None, dict[str, DataFrame]]:
    """The id of a source, and what has to be appended for it."""
    if label is None:
        return None, {}
    sources = catalog.read("sources")
    known = sources.filter(F.col("label") == label).select("id").head()
    if known is not None:
        return known[0], {}
    last = sources.agg(F.max("id")).head()[0] or 0
    return last + 1, {"sources": catalog.spark.createDataFrame([(last + 1, label, "other", at)], schemas.SOURCES)}


def next_id(catalog: Catalog, table: str) -> int:
    return (catalog.read(table).agg(F.max("id")).head()[0] or 0) + 1


def link_rows(catalog: Catalog, links: DataFrame, ids: DataFrame, at: datetime) -> DataFrame:
    """Links as rows to append; `ids` names the assets (id) of a run's files (path)."""
    known = ids.select(F.col("path").alias("_path"), F.col("id").alias("_id"))
    links = links.join(merged(known), F.col("master_path") == F.col("_path"), "left").withColumn("master_asset_id", F.coalesce("master_id", "_id"))
    return upsert.numbered(links, ["original_path"], next_id(catalog, "linked_files")).withColumn("seen_at", F.lit(at).cast("timestamp"))


def review_rows(catalog: Catalog, reviews: DataFrame, ids: DataFrame, at: datetime) -> DataFrame:
    """Review entries as rows to append."""
    known = ids.select(F.col("path").alias("_path"), F.col("id").alias("_id"))
    reviews = reviews.join(merged(known), F.col("asset_path") == F.col("_path"), "left").withColumn("asset_id", F.col("_id"))
    reviews = upsert.numbered(reviews, ["original_path", "kind"], next_id(catalog, "review_queue"))
    return reviews.withColumns({"status": F.lit("open"), "created_at": F.lit(at).cast("timestamp")})


def apply_plan(plan: Plan, catalog: Catalog, at: datetime, source: str | None = None) -> None:
    """Record a plan in one commit, for files that are in the vault or need no copy; `filing.ingest` copies them first.

    A second run over the same files imports nothing.
    """
    source_id, appended = source_row(catalog, source, at)
    assets = settle(upsert.numbered(plan.assets, ["rank"], next_id(catalog, "assets")), "numbered-assets")
    rows = assets.withColumn("imported_at", F.lit(at).cast("timestamp")).withColumn("source_id", F.lit(source_id).cast("bigint"))
    if not rows.filter("vault_path IS NULL OR sha256 IS NULL").isEmpty():
        raise ConstraintError("files without a checksum or a place can't be imported")
    links, reviews = link_rows(catalog, plan.links, assets, at), review_rows(catalog, plan.reviews, assets, at)
    catalog.commit(appended | {"assets": rows, "linked_files": links, "review_queue": reviews})
