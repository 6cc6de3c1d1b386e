"""Registered queries over sources, sinks and stored tables, and over functions that no query of `catalogue` shows by itself.

They first write the driver's tables as files of a drive or as an index in the shared folder, then read them through the library.
"""

from __future__ import annotations

import os
import uuid
from datetime import date, datetime
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolith import schemas
from photolith.config import Contract, Family, Subject
from photolith.errors import SourceError
from photolith.functions import paths, text, values
from photolith.operators import contract, enrich, inventory, stats, upsert, verify
from photolith.plans import filing
from photolith.plans.catalogue import FAMILY, RULES, items, located, registered, table
from photolith.plans.catalogue_sql import _ITEMS
from photolith.plans.made_files import FORMS, made, picture
from photolith.sources import decoders, files, library, purge
from photolith.sources.catalog import Catalog
from photolith.sources.embedded import byte_reader
from photolith.sources.scratch import settle, shared_folder
from photolith.sources.vault import copy_into_vault, over_cores
from photolith.streaming.inbox import take_in

NOW = datetime(2024, 5, 1, 10)
#: The most rows of a batch that are made or written as Python values at a time.
HELD = 256


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder, which must be mounted where tasks run."""
    base = urlparse(shared_folder(spark))
    if base.scheme not in ("", "file"):
        raise SourceError("files need a mounted folder")
    return f"{base.path.rstrip('/')}/photolith/{name}-{uuid.uuid4().hex}"


def put(rows: DataFrame, root: str) -> None:
    """Write (rel_path, content), texts or bytes, as files where tasks run."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, HELD):
                part = batch.slice(a, HELD)
                for rel, content in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    os.makedirs(os.path.dirname(f"{root}/{rel}"), exist_ok=True)
                    with open(f"{root}/{rel}", "wb") as f:
                        f.write(content if isinstance(content, bytes) else (content or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    os.makedirs(root, exist_ok=True)
    rows.select("rel_path", "content").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def drive(spark: SparkSession, sf_dir: str) -> str:
    """Documents as files of a drive: pictures in folders by language, every fifth with a sidecar, some hidden or in a system folder."""
    d, root = table(spark, sf_dir, "documents"), folder(spark, "drive")
    i, lang = F.col("doc_id"), F.coalesce("lang", F.lit("none"))
    place = F.when(i % 11 == 3, F.format_string(".trashes/%d.jpg", i)).when(i % 11 == 4, F.concat(lang, F.format_string("/.%d.jpg", i))).when(i % 11 == 5, F.concat(lang, F.format_string("/%d.txt", i)))
    media = d.select(place.alias("other"), F.concat(lang, F.format_string("/P %d.jpg", i)).alias("own"), F.col("text").alias("content"))
    side = F.to_json(F.struct(F.format_string("2020-01-0%d", i % 9 + 1).alias("date"), F.array(lang, F.lit("x")).alias("albums"), F.array(F.lit("Trey"), F.col("source")).alias("persons")))
    sides = d.filter(i % 5 == 0).select(F.concat(lang, F.format_string("/P %d.jpg.json", i)).alias("rel_path"), F.when(i % 25 == 0, "[1]").when(i % 35 == 5, F.regexp_replace(side, '"', "'")).when(i % 35 == 10, F.concat(side, F.lit(" x"))).otherwise(side).alias("content"))
    put(over_cores(media.select(F.coalesce("other", "own").alias("rel_path"), "content").unionByName(sides)), root)
    return root


@registered
def q70_manifest(spark, sf_dir):
    """A drive's manifest, written to it and read back."""
    root = drive(spark, sf_dir)
    files.write_manifest(files.build_manifest(spark, root), root)
    return files.read_manifest(spark, root)


@registered
def q71_manifest_tags(spark, sf_dir):
    root = drive(spark, sf_dir)
    rest = F.col("size_bytes") % 7
    spaced = F.when(rest == 0, F.concat(F.lit("\t"), "sha256", F.lit("\n"))).when(rest == 1, "\t").otherwise(F.col("sha256"))
    files.write_manifest(files.build_manifest(spark, root).withColumn("sha256", spaced), root)
    found, source = files.tags_from(spark, root)
    return found.select("sha256", text.join_names(F.col("names")).alias("names"), F.lit(source).alias("source"))


@registered
def q72_sidecar_tags(spark, sf_dir):
    found, source = files.tags_from(spark, drive(spark, sf_dir))
    return found.select("sha256", text.join_names(F.col("names")).alias("names"), F.lit(source).alias("source"))


@registered
def q73_listing(spark, sf_dir):
    listed = files.list_files(spark, drive(spark, sf_dir))
    return listed.select("rel_path", "size_bytes", paths.is_content(F.col("rel_path")).alias("kept"))


@registered
def q74_file_checksums(spark, sf_dir):
    found = files.with_sha256(files.scan(files.list_store(spark, drive(spark, sf_dir))).withColumn("path", F.url_decode(F.regexp_replace("path", "^file:/*", "/"))))
    return found.select(F.regexp_extract("rel_path", "[^/]*$", 0).alias("name"), "size_bytes", "sha256")


def _reader(batch: list[str]) -> pd.DataFrame:
    """A metadata reader that knows files by the digits of their names, as the program gives values."""
    rows = []
    for p in batch:
        n = int("".join(c for c in p.rsplit("/", 1)[1] if c.isdigit()))
        if n % 4:
            rows.append({"path": p, "DateTimeOriginal": "0000:00:00 00:00:00", "CreateDate": f"2016:01:02 03:04:0{n % 10}" if n % 4 > 1 else None, "ImageWidth": str(n % 50), "ImageHeight": "20", "GPSLatitude": "0" if n % 3 == 0 else "10.5", "GPSLongitude": "0" if n % 3 == 0 else "-20.25"})
    return pd.DataFrame(rows, columns=["path", *files.DATE_TAGS, *files.SIZE_TAGS, *files.PLACE_TAGS])


@registered
def q75_identified(spark, sf_dir):
    """Files of a drive with embedded metadata, sidecar dates and checksums."""
    listed = files.list_files(spark, drive(spark, sf_dir))
    media = files.scan(listed)
    side = files.read_sidecars(spark, listed, media).join(media, "rel_path").select("path", "date")
    found = files.identify(media, files.metadata(files.read_embedded(media, _reader), side))
    return found.select("rel_path", F.date_format("taken_at", "yyyy-MM-dd HH:mm:ss").alias("taken_at"), "taken_at_source", "width", "height", "gps_latitude", "sha256")


@registered
def q76_vault_copies(spark, sf_dir):
    """Files copied into a vault, twice, and verified there."""
    media = settle(files.with_sha256(files.scan(files.list_files(spark, drive(spark, sf_dir)))), "hashed")
    plan = media.select("path", F.concat(F.lit("undated/"), "rel_path").alias("vault_path"), "sha256", F.col("size_bytes").alias("filesize"))
    vault = folder(spark, "vault")
    wrong = [copy_into_vault(plan, vault).filter("error IS NOT NULL").count() for _ in range(2)]
    there = files.with_sha256(files.list_files(spark, vault)).select(F.col("rel_path").alias("path"), "size_bytes", "sha256")
    return verify.verify_vault(plan, there).withColumn("n_errors", F.lit(sum(wrong)))


@registered
def q90_purged_drive(spark, sf_dir):
    """What is left of a drive after its trash and its orphaned sidecars were removed."""
    root = drive(spark, sf_dir)
    purge.clean(spark, root)
    return files.list_files(spark, root).select("rel_path", "size_bytes")


@registered
def q88_embedded_bytes(spark, sf_dir):
    """What the bytes of encoded files tell, whose metadata are made from documents; some files are cut off, some go in circles."""
    root = folder(spark, "camera")

    def encoded(batches):
        for batch in batches:
            names, contents = [], []
            for n in batch.column(0).to_pylist():
                form = FORMS[n % len(FORMS)]
                date = f"{2000 + n % 20}:{n % 12 + 1:02}:{n % 28 + 1:02} {n % 24:02}:30:{n % 60:02}" if n % 5 else None
                lat, lon = n % 181 - 90, n % 361 - 180
                place = (lat + (0.5 if lat >= 0 else -0.5), lon + (0.5 if lon >= 0 else -0.5)) if n % 4 else None
                data = made(form, "<>"[n % 2], date, (n % 5000 + 17, n % 3000 + 17), place, cyclic=n % 11 == 2)
                names.append(f"{n}.{form}")
                contents.append(data[:12] if n % 11 == 1 else data)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(contents, type=pa.binary())], names=["rel_path", "content"])

    put(over_cores(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"))).mapInArrow(encoded, "rel_path string, content binary"), root)
    found = files.metadata(files.read_embedded(files.scan(files.list_files(spark, root)), byte_reader))
    taken = F.date_format("taken_at", "yyyy-MM-dd HH:mm:ss").alias("taken_at")
    return found.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), taken, "taken_at_source", "width", "height", "gps_latitude", "gps_longitude")


@registered
def q89_perceptual_hashes(spark, sf_dir):
    """Hashes of pictures of 32 x 32 whose 8 x 8 fields are the components of embeddings, decoded from PNG, BMP and TIFF files."""
    root, forms = folder(spark, "pictures"), ("png", "bmp", "tif")

    def encoded(batches):
        for batch in (b.slice(a, HELD) for b in batches for a in range(0, b.num_rows, HELD)):
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            found = [(f"{n}.{forms[n % 3]}", picture(np.array(v, dtype=np.uint8).reshape(8, 8).repeat(4, axis=0).repeat(4, axis=1), forms[n % 3])) for n, v in rows]
            names, contents = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, type=pa.string()), pa.array(contents, type=pa.binary())], names=["rel_path", "content"])

    level = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x.cast("double") * 256 + 128))).cast("int")
    vectors = table(spark, sf_dir, "embeddings").filter(F.size("embedding") == 64).select(F.col("vec_id").cast("long"), F.transform("embedding", level))
    put(over_cores(vectors).mapInArrow(encoded, "rel_path string, content binary"), root)
    found = decoders.with_phash(files.scan(files.list_files(spark, root)))
    return found.select(F.regexp_extract("path", r"(\d+)\.[a-z]+$", 1).cast("bigint").alias("vec_id"), "phash")


def filing_run(spark, sf_dir):
    """A drive taken into a vault, after every 13th picture has changed, every 17th found both its names taken, and every 19th one."""
    root, vault = drive(spark, sf_dir), folder(spark, "vault")
    known = files.identify(files.scan(files.list_files(spark, root)), spark.createDataFrame([], "path string, taken_at timestamp_ntz, taken_at_source string, width int, height int, gps_latitude double, gps_longitude double"))
    known = settle(known, "identified")
    number = F.regexp_extract("rel_path", r"(\d+)\.jpg$", 1).cast("long")
    put(known.filter(number % 13 == 0).select("rel_path", F.lit("changed").alias("content")), root)
    other, name = F.lit("other content").alias("content"), F.concat(F.lit("undated/P "), number.cast("string"))
    put(known.filter((number % 17 == 0) | (number % 19 == 0)).select(F.concat(name, F.lit(".jpg")).alias("rel_path"), other), vault)
    put(known.filter(number % 17 == 0).select(F.concat(name, F.lit("-"), F.substring("sha256", 1, 8), F.lit(".jpg")).alias("rel_path"), other), vault)
    found = filing.ingest(known, Catalog(spark, folder(spark, "index")), vault, "first", NOW, "drive", chunk=1 + known.count() // 3)
    return found.withColumn("rel_path", paths.relative_to(F.col("path"), root))


@registered
def q86_filing(spark, sf_dir):
    """What became of every file of a run some of whose copies fail."""
    return filing_run(spark, sf_dir).select("rel_path", "outcome", "renamed", F.coalesce("error", F.lit("")).alias("error"))


@registered
def q87_filing_balance(spark, sf_dir):
    return filing.counts(filing_run(spark, sf_dir))


@registered
def q77_sinks(spark, sf_dir):
    """A selection's ids as lines of a file, and a report as JSON, read back."""
    root = folder(spark, "out")
    os.makedirs(root)
    ids = contract.selected(contract.decide(items(spark, sf_dir), Contract(cutoff=date(2024, 1, 16)), FAMILY))
    n = files.write_lines(ids, f"{root}/ids.txt")
    files.write_report(ids.agg(F.count(F.lit(1)).alias("n")), f"{root}/report.json", library="events")
    said = spark.read.option("multiLine", True).json(f"{root}/report.json").select("n", "library")
    return spark.read.text(f"{root}/ids.txt").select(F.col("value").alias("uuid"), F.lit(n).alias("n_written")).join(F.broadcast(said))  # one row


@registered
def q78_index(spark, sf_dir):
    """Statistics, as they are kept with the parts, of an index that was written in two appends, with a review resolved and persons replaced."""
    catalog = Catalog(spark, folder(spark, "index"))
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    rows = o.select(
        key.alias("id"), key.cast("string").alias("sha256"), F.format_string("2020/01/%d.jpg", key).alias("vault_path"), key.cast("string").alias("original_filename"), F.when(key % 7 != 0, F.col("o_orderdate")).alias("taken_at"),
        F.lit("exif").alias("taken_at_source"), F.when(key % 2 == 0, "video").otherwise("photo").alias("media_type"), F.col("o_custkey").alias("filesize"), F.lit(NOW).alias("imported_at"), F.lit(1).alias("source_id"),
    )
    catalog.append("sources", spark.createDataFrame([(1, "phone", "other", NOW)], schemas.SOURCES))
    for part in (0, 1):
        catalog.append("assets", rows.filter(key % 2 == part))
    catalog.append("linked_files", o.filter("o_orderkey % 5 = 1").select(key.alias("id"), F.lit("s").alias("sha256"), key.cast("string").alias("original_path"), key.alias("master_asset_id"), F.lit("exact_duplicate").alias("reason")))
    reviews = o.filter("o_orderkey % 9 = 1").select(key.alias("id"), key.alias("asset_id"), key.cast("string").alias("original_path"), F.lit("unknown_date").alias("kind"), F.lit("open").alias("status"))
    catalog.append("review_queue", reviews)
    catalog.replace("review_queue", upsert.resolve_review(catalog.read("review_queue"), [1, 10, 3], "kept", NOW))
    people, _ = upsert.get_or_create(catalog.read("persons"), table(spark, sf_dir, "region").select(F.col("r_name").alias("name")), "name")
    catalog.append("persons", people)
    catalog.append("asset_persons", o.filter("o_orderkey % 3 = 0").select(key.alias("asset_id"), (key % 5 + 1).alias("person_id"), F.lit("manifest").alias("source")))
    return catalog.stats().select("assets", "total_bytes", "photos", "videos", "undated", "linked_files", "open_reviews", "sources", "tagged_people")


@registered
def q79_all_items(spark, sf_dir):
    live = items(spark, sf_dir).filter("CAST(uuid AS bigint) % 3 <> 0")
    gone = items(spark, sf_dir).filter("CAST(uuid AS bigint) % 2 = 0").withColumn("in_trash", F.lit(True))
    return library.all_items(live, gone).select("uuid", "in_trash", "filesize")


@registered
def q80_demo(spark, sf_dir):
    """A library together with the made-up one for its contract: of each disposition the items of both."""
    both = library.all_items(items(spark, sf_dir), library.demo(spark, FAMILY, RULES.cutoff))
    return inventory.by_disposition(contract.decide(both, RULES, FAMILY)).select("disposition", "n")


@registered
def q94_migrated_assets(spark, sf_dir):
    """Assets that were written in the first version of their table, read in the present one, and how many columns they lacked."""
    key = F.col("o_orderkey")
    old = table(spark, sf_dir, "orders").select(
        key.alias("id"), key.cast("string").alias("sha256"), key.cast("string").alias("vault_path"), F.lit("x").alias("original_filename"), F.lit("exif").alias("taken_at_source"),
        F.lit("photo").alias("media_type"), F.col("o_custkey").alias("filesize"), F.lit(NOW).alias("imported_at"),
    )
    old = schemas.conform(old, schemas.ASSETS_V1)
    lacking = len(schemas.missing_columns(old, schemas.ASSETS))
    return schemas.migrate(old, "assets").select("id", "vault_path", "filesize", F.col("gps_source").isNull().alias("unplaced"), F.lit(lacking).alias("lacking"))


def drop_in(rows: DataFrame, inbox: str) -> None:
    """Identified rows as further files of an inbox, as many as there are tasks that make them; a stream takes all that has arrived as one batch."""
    schemas.conform(rows, schemas.IDENTIFIED).write.mode("append").parquet(inbox)


@registered
def q95_streamed_inbox(spark, sf_dir):
    """The assets of an inbox that was taken in as a stream, in two batches that share pictures."""
    root, catalog = folder(spark, "stream"), Catalog(spark, folder(spark, "index"))
    d, path = table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    content = F.coalesce("text", F.lit(""))
    rows = d.select(F.concat(F.lit("/in/"), path).alias("path"), path.alias("rel_path"), F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("bigint").alias("filesize"), F.lit("unknown").alias("taken_at_source"), "doc_id")
    for part in (0, 1):
        drop_in(rows.filter(F.col("doc_id") % 2 == part), f"{root}/inbox")
        take_in(spark, f"{root}/inbox", catalog, f"{root}/offsets", NOW, source="stream").awaitTermination()
    links = catalog.read("linked_files").groupBy(F.col("master_asset_id").alias("id")).agg(F.count(F.lit(1)).alias("n_links"))
    return catalog.read("assets").join(links, "id", "left").select("original_filename", "sha256", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


@registered
def q81_names_outside_ascii(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    family = Family((Subject("Jo Strauß", ("ΟΔΥΣΣΕΥΣ", "İlker")), Subject("Finn", ("ﬁnn",))))
    tags = ("jo  STRAUSS", "οδυσσευς", "i̇lker", "FINN", "Strauss", " JO\tSTRAUẞ ")
    tag = F.element_at(F.array(*[F.lit(t) for t in tags]), (F.col("c_custkey") % len(tags) + 1).cast("int"))
    return c.select("c_custkey", text.subject_of(tag, family).alias("subject"), text.has_any(F.array(tag), ("Straße", "STRAUSS")).alias("excluded"))


@registered
def q82_hash_distances(spark, sf_dir):
    """Distances of hexadecimal hashes, of equal and of unequal length."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("s"))
    size = (F.col("doc_id") % 3 * 16 + 8).cast("int")
    left, right = F.substring(F.col("s"), F.lit(1), size), F.substring(F.reverse("s"), F.lit(1), F.when(F.col("doc_id") % 7 == 0, size + 1).otherwise(size))
    return d.select("doc_id", values.hamming(left, right).alias("distance"))


@registered
def q83_confidence(spark, sf_dir):
    found = enrich.infer_locations(located(spark, sf_dir))
    return found.select("id", F.round(F.col("confidence") * 1000).cast("int").alias("thousandths"), "band")


@registered
def q84_readable(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    return p.select(
        "p_partkey", values.format_size(k * 512).alias("size"), values.format_duration(k.cast("double") / 8).alias("duration"), values.plural(k, "item").alias("items"),
        paths.relative_to(F.concat(F.when(k % 2 == 0, "/root/a/").otherwise("/elsewhere/"), k.cast("string")), "/root/a/").alias("path"),
    )


@registered
def q85_listing_and_rest(spark, sf_dir):
    """The first rows of a listing for people, and how many more there are."""
    return stats.listed_with_rest(table(spark, sf_dir, "events").select("event_id", "event_type"), 20, "event_id", event_type="purchase")


_LANG = "coalesce(lang, 'none')"
_NAMES = f"""
f AS (SELECT doc_id, {_LANG} AS lang, source, coalesce(text, '') AS content, doc_id % 11 AS k FROM documents),
placed AS (SELECT *, CASE k WHEN 3 THEN '.trashes/' || doc_id || '.jpg' WHEN 4 THEN lang || '/.' || doc_id || '.jpg' WHEN 5 THEN lang || '/' || doc_id || '.txt' ELSE lang || '/P ' || doc_id || '.jpg' END AS rel_path FROM f),
media AS (SELECT *, doc_id % 5 = 0 AND doc_id % 25 <> 0 AND doc_id % 35 NOT IN (5, 10) AS told FROM placed WHERE k NOT IN (3, 4, 5)),
side AS (SELECT doc_id, lang || '/P ' || doc_id || '.jpg.json' AS rel_path,  CASE WHEN doc_id % 25 = 0 THEN '[1]' WHEN doc_id % 35 = 5 THEN replace(said, '"', '''') WHEN doc_id % 35 = 10 THEN said || ' x' ELSE said END AS content FROM (SELECT *, '{{"date":"2020-01-0' || (doc_id % 9 + 1) || '","albums":["' || lang || '","x"],"persons":["Trey","' || source || '"]}}' AS said FROM f WHERE doc_id % 5 = 0))
"""
_FILED = f"""{_NAMES},
copies AS (SELECT doc_id, rel_path, strlen(content) AS size, doc_id % 13 = 0 AS changed, doc_id % 13 = 0 OR doc_id % 17 = 0 AS bad, sha256(content) AS s FROM media),
firsts AS (SELECT *, min(CASE WHEN NOT bad THEN rel_path END) OVER (PARTITION BY s) AS good FROM copies),
filed AS (SELECT *, CASE WHEN rel_path = good THEN 'imported' WHEN good IS NULL OR rel_path < good THEN 'failed' ELSE 'linked' END AS outcome FROM firsts)"""
_DEMO = ", ".join(f"('{d}', {n})" for d, n in (("INCLUDE_PRE_CUTOFF", 16), ("INCLUDE_TAGGED", 6), ("EXCLUDE_NOT_OWNED", 16), ("EXCLUDE_ALBUM", 48), ("EXCLUDE_SCREENSHOT", 8), ("EXCLUDE_UNTAGGED", 2), ("REVIEW_UNKNOWN_DATE", 16)))

ORACLE_SQL: dict[str, str] = {
    "q70_manifest": f"""WITH {_NAMES} SELECT rel_path AS path, CASE WHEN told THEN '2020-01-0' || (doc_id % 9 + 1) ELSE '' END AS date, CASE WHEN told THEN lang || '; x' ELSE '' END AS albums,
        CASE WHEN told THEN 'Trey; ' || source ELSE '' END AS persons, CAST(strlen(content) AS BIGINT) AS size_bytes, sha256(content) AS sha256 FROM media""",
    "q71_manifest_tags": f"WITH {_NAMES} SELECT sha256(content) AS sha256, 'Trey; ' || source AS names, 'manifest' AS source FROM media WHERE told AND strlen(content) % 7 <> 1",
    "q72_sidecar_tags": f"WITH {_NAMES} SELECT sha256(content) AS sha256, 'Trey; ' || source AS names, 'sidecar' AS source FROM media WHERE told",
    "q73_listing": f"""WITH {_NAMES} SELECT rel_path, CAST(strlen(content) AS BIGINT) AS size_bytes, k NOT IN (3, 4, 5) AS kept FROM placed UNION ALL SELECT rel_path, CAST(strlen(content) AS BIGINT), false FROM side""",
    "q74_file_checksums": f"WITH {_NAMES} SELECT 'P ' || doc_id || '.jpg' AS name, CAST(strlen(content) AS BIGINT) AS size_bytes, sha256(content) AS sha256 FROM media",
    "q75_identified": f"""WITH {_NAMES} SELECT rel_path, CASE WHEN told THEN '2020-01-0' || (doc_id % 9 + 1) || ' 00:00:00' WHEN doc_id % 4 > 1 THEN '2016-01-02 03:04:0' || (doc_id % 10) END AS taken_at,
        CASE WHEN told THEN 'sidecar' WHEN doc_id % 4 > 1 THEN 'exif' ELSE 'unknown' END AS taken_at_source, CAST(CASE WHEN doc_id % 4 > 0 AND doc_id % 50 > 0 THEN doc_id % 50 END AS INTEGER) AS width,
        CASE WHEN doc_id % 4 > 0 THEN 20 END AS height, CASE WHEN doc_id % 4 > 0 AND doc_id % 3 > 0 THEN CAST(10.5 AS DOUBLE) END AS gps_latitude, sha256(content) AS sha256 FROM media""",
    "q76_vault_copies": f"WITH {_NAMES} SELECT 'undated/' || rel_path AS path, 'ok' AS status, 0 AS n_errors FROM media",
    "q90_purged_drive": f"""WITH {_NAMES} SELECT rel_path, CAST(strlen(content) AS BIGINT) AS size_bytes FROM placed WHERE k <> 3
        UNION ALL SELECT s.rel_path, CAST(strlen(s.content) AS BIGINT) FROM side s JOIN media USING (doc_id)""",
    "q88_embedded_bytes": """
        WITH d AS (SELECT doc_id AS n, doc_id % 181 - 90 AS lat, doc_id % 361 - 180 AS lon, doc_id % 11 AS k, ['jpg', 'tif', 'png', 'webp', 'mov', 'heic'][doc_id % 6 + 1] AS form FROM documents),
        t AS (SELECT *, n || '.' || form AS name, k = 1 OR (k = 2 AND form = 'mov') AS lost, n % 4 > 0 AND abs(lat) < 90 AND abs(lon) < 180 AS placed FROM d),
        w AS (SELECT *, NOT lost AND k <> 2 AND n % 5 > 0 AS dated FROM t)
        SELECT name, CASE WHEN dated THEN printf('%d-%02d-%02d %02d:30:%02d', 2000 + n % 20, n % 12 + 1, n % 28 + 1, n % 24, n % 60) END AS taken_at, CASE WHEN dated THEN 'exif' ELSE 'unknown' END AS taken_at_source,
               CASE WHEN NOT lost THEN CAST(n % 5000 + 17 AS INTEGER) END AS width, CASE WHEN NOT lost THEN CAST(n % 3000 + 17 AS INTEGER) END AS height,
               CASE WHEN NOT lost AND placed THEN lat + CASE WHEN lat >= 0 THEN CAST(0.5 AS DOUBLE) ELSE -0.5 END END AS gps_latitude,
               CASE WHEN NOT lost AND placed THEN lon + CASE WHEN lon >= 0 THEN CAST(0.5 AS DOUBLE) ELSE -0.5 END END AS gps_longitude FROM w""",
    "q89_perceptual_hashes": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(0, least(255, floor(CAST(x AS DOUBLE) * 256 + 128)))) AS p FROM embeddings WHERE len(embedding) = 64),
        c AS (SELECT u, i, sum(2 * cos(pi() * u * (2 * (4 * i + s) + 1) / 64)) AS c FROM range(8) a(u), range(8) b(i), range(4) d(s) GROUP BY u, i),
        f AS (SELECT vec_id, i.generate_series AS y, j.generate_series AS x, p[8 * i.generate_series + j.generate_series + 1] AS level FROM v, generate_series(0, 7) i, generate_series(0, 7) j),
        h AS (SELECT vec_id, y, u, sum(level * c) AS part FROM f JOIN c ON f.x = c.i GROUP BY vec_id, y, u),
        t AS (SELECT vec_id, c.u AS down, h.u AS across, round(sum(part * c), 6) AS z FROM h JOIN c ON h.y = c.i GROUP BY vec_id, c.u, h.u),
        m AS (SELECT vec_id, median(z) AS middle FROM t GROUP BY vec_id),
        b AS (SELECT vec_id, (down * 8 + across) // 4 AS digit, sum(CASE WHEN z > middle THEN 1 << CAST(3 - (down * 8 + across) % 4 AS INTEGER) ELSE 0 END) AS value FROM t JOIN m USING (vec_id) GROUP BY vec_id, digit)
        SELECT vec_id, string_agg('0123456789abcdef'[CAST(value AS INTEGER) + 1], '' ORDER BY digit) AS phash FROM b GROUP BY vec_id""",
    "q86_filing": f"""WITH {_FILED} SELECT rel_path, outcome, outcome = 'imported' AND doc_id % 19 = 0 AS renamed,
        CASE WHEN outcome <> 'failed' THEN '' WHEN doc_id % 17 = 0 THEN 'other content is there' ELSE 'the copy differs from its checksum' END AS error FROM filed""",
    "q87_filing_balance": f"""WITH {_FILED} SELECT count(*) AS scanned, count(*) FILTER (WHERE outcome = 'imported') AS imported, count(*) FILTER (WHERE outcome = 'linked') AS linked, CAST(0 AS BIGINT) AS deferred,
        count(*) FILTER (WHERE outcome = 'failed') AS failed, CAST(coalesce(sum(size) FILTER (WHERE outcome = 'imported'), 0) AS BIGINT) AS imported_bytes, CAST(coalesce(sum(size) FILTER (WHERE outcome = 'linked'), 0) AS BIGINT) AS linked_bytes,
        count(*) FILTER (WHERE outcome = 'imported') AS undated, count(*) FILTER (WHERE outcome = 'imported' AND doc_id % 19 = 0) AS renamed, true AS balanced FROM filed""",
    "q77_sinks": f"""WITH {_ITEMS}, s AS (SELECT uuid FROM decided WHERE is_in) SELECT uuid, CAST((SELECT count(*) FROM s) AS INTEGER) AS n_written, (SELECT count(*) FROM s) AS n, 'events' AS library FROM s""",
    "q78_index": """
        SELECT count(*) AS assets, CAST(sum(o_custkey) AS BIGINT) AS total_bytes, count(*) FILTER (WHERE o_orderkey % 2 = 1) AS photos, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS videos, count(*) FILTER (WHERE o_orderkey % 7 = 0) AS undated,
               count(*) FILTER (WHERE o_orderkey % 5 = 1) AS linked_files, count(*) FILTER (WHERE o_orderkey % 9 = 1 AND o_orderkey NOT IN (1, 10)) AS open_reviews, CAST(1 AS BIGINT) AS sources, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS tagged_people FROM orders""",
    "q79_all_items": "SELECT CAST(event_id AS VARCHAR) AS uuid, event_id % 3 = 0 AS in_trash, CAST(floor(value * 1000) AS BIGINT) AS filesize FROM events WHERE event_id % 3 <> 0 OR event_id % 2 = 0",
    "q80_demo": f"""WITH {_ITEMS}, mixed AS (SELECT disposition, count(*) AS n FROM decided GROUP BY disposition UNION ALL SELECT disposition, CAST(n AS BIGINT) FROM (VALUES {_DEMO}) v(disposition, n))
        SELECT disposition, CAST(sum(n) AS BIGINT) AS n FROM mixed GROUP BY disposition""",
    "q94_migrated_assets": "SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS vault_path, o_custkey AS filesize, true AS unplaced, 3 AS lacking FROM orders",
    "q95_streamed_inbox": """
        WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS name, doc_id % 2 AS batch, sha256(coalesce(text, '')) AS sha256 FROM documents),
        r AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY batch, name) AS nth, count(*) OVER (PARTITION BY sha256) - 1 AS n_links FROM d)
        SELECT name AS original_filename, sha256, n_links FROM r WHERE nth = 1""",
    "q81_names_outside_ascii": """
        SELECT c_custkey, CASE c_custkey % 6 WHEN 3 THEN 'Finn' WHEN 4 THEN NULL ELSE 'Jo Strauß' END AS subject, c_custkey % 6 = 4 AS excluded FROM customer""",
    "q82_hash_distances": """
        WITH d AS (SELECT doc_id, sha256(CAST(doc_id AS VARCHAR)) AS s, doc_id % 3 * 16 + 8 AS size FROM documents),
        c AS (SELECT doc_id, size, unnest(range(1, size + 1)) AS i, s FROM d),
        b AS (SELECT doc_id, sum(bit_count(xor(CAST('0x' || s[i:i] AS INTEGER), CAST('0x' || reverse(s)[i:i] AS INTEGER)))) AS n FROM c GROUP BY doc_id)
        SELECT doc_id, CAST(CASE WHEN doc_id % 7 = 0 THEN 999 ELSE n END AS INTEGER) AS distance FROM b""",
    "q83_confidence": """
        WITH a AS (SELECT event_id AS id, CASE WHEN event_id % 50 <> 0 THEN ts END AS t, event_type FROM events),
        g AS (SELECT x.id, min(abs(epoch_us(x.t) - epoch_us(y.t))) AS gap FROM a x JOIN a y ON x.event_type = 'error' AND y.event_type = 'signup' AND CAST(x.t AS DATE) = CAST(y.t AS DATE) GROUP BY x.id)
        SELECT id, CAST(round_even(1.0 - (gap / 1e6) / 21600.0, 3) * 1000 AS INTEGER) AS thousandths, CASE WHEN gap <= 3600000000 THEN 'high' ELSE 'low' END AS band FROM g WHERE gap < 21589200000""",
    "q84_readable": """
        WITH p AS (SELECT p_partkey AS k, p_partkey * 512 AS size, p_partkey / 8 AS hours FROM part)
        SELECT k AS p_partkey, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN format('{:,.1f}', size / 1024) || ' KB' ELSE format('{:,.1f}', size / 1048576) || ' MB' END AS size,
               CASE WHEN hours * 60 < 1 THEN 'under a minute' WHEN hours < 1 THEN printf('%.0f', hours * 60) || ' minutes' WHEN hours < 24 THEN printf('%.1f', hours) || ' hours' ELSE printf('%.1f', hours / 24) || ' days' END AS duration,
               format('{:,}', k) || ' item' || CASE WHEN k = 1 THEN '' ELSE 's' END AS items, CASE WHEN k % 2 = 0 THEN '' ELSE '/elsewhere/' END || k AS path FROM p""",
    "q85_listing_and_rest": """
        WITH p AS (SELECT event_id, event_type FROM events WHERE event_type = 'purchase')
        SELECT event_id, event_type, (SELECT count(*) FROM p) - least((SELECT count(*) FROM p), 20) AS n_more FROM p ORDER BY event_id LIMIT 20""",
}
