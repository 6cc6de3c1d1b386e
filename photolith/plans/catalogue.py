"""The registered queries: every operator over the driver's tables, which stand in for libraries, archives and drives.

`events` is a library (and, for locations, an archive in time), `documents` a set of files with checksums, `embeddings` one with
perceptual hashes, `orders` and `lineitem` an index and what is on disk, `part` names, `pages` paths. Each query has the same
result as DuckDB SQL in `catalogue_sql`, but for those whose rounds SQL can't express.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolith import schemas
from photolith.config import Contract, Family, Subject
from photolith.functions import dates, paths, text, values
from photolith.functions.keys import dealt_anew
from photolith.operators import contract, dedupe, digest_tree, enrich, inventory, similarity, spellings, stats, upsert, verify
from photolith.operators.nearest_time import nearest
from photolith.plans.ingest import filed, plan_ingest
from photolith.sources import library

FAMILY = Family((Subject("Subject One", ("Subject 1", "Sub One"), 3), Subject("Subject Two", (), 3), Subject("Subject Three", ("Trey",), 2)))
RULES = Contract(cutoff=date(2024, 1, 16), exclude_albums=("Hidden", "Recently Deleted"))
PARTS = Family((Subject("Ring", ("ring",)), Subject("Widget", ("widget", "gadget")), Subject("Red", ())))
THRESHOLD = 20

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def registered(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def k_of(props):
    return F.get_json_object(props, "$.k").cast("int")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as library items."""
    e = table(spark, sf_dir, "events").withColumn("k", k_of(F.col("props")))
    kind = F.col("event_type")
    none = F.array().cast("array<string>")
    return e.select(
        F.col("event_id").cast("string").alias("uuid"), F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("original_filename"), F.when(F.col("k") % 10 != 0, F.col("ts")).alias("date"),
        F.when(kind == "signup", F.array(F.lit("  subject   ONE "), F.lit("Nobody"))).when((kind == "purchase") & (F.col("k") % 2 == 0), F.array(F.lit("TREY"), F.lit("Sub One"), F.lit("Trey"))).otherwise(none).alias("persons"),
        F.when(F.col("k") % 13 == 0, F.array(F.lit("Trips"), F.lit("recently  DELETED"))).otherwise(none).alias("albums"),
        (kind == "view").alias("is_screenshot"), (F.col("value") < 5).alias("is_hidden"), F.lit(False).alias("in_trash"), (kind == "error").alias("is_shared"), (F.col("k") % 3 != 0).alias("is_photo"),
        (F.col("k") % 3 == 0).alias("is_movie"), (F.col("k") % 5 == 1).alias("is_live_photo"), (F.col("k") % 4 == 0).alias("is_missing"), F.floor(F.col("value") * 1000).cast("bigint").alias("filesize"), F.lit(None).cast("string").alias("path"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract.decide(items(spark, sf_dir), RULES, FAMILY)


@registered
def q01_contract(spark, sf_dir):
    found = decisions(spark, sf_dir)
    return found.select("uuid", "disposition", text.join_names(F.col("matched_subjects")).alias("subjects"), "in_untagged_window")


@registered
def q02_untagged_window(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rules = Contract(cutoff=date(1998, 1, 31), window_months=13)
    no, none = F.lit(False), F.array().cast("array<string>")
    rows = o.select(F.col("o_orderkey").cast("string").alias("uuid"), F.col("o_orderdate").alias("date"), none.alias("persons"), none.alias("albums"), *[no.alias(c) for c in ("is_screenshot", "is_hidden", "in_trash", "is_shared")])
    return contract.decide(rows, rules, FAMILY).select("uuid", "disposition", "in_untagged_window")


@registered
def q03_by_disposition(spark, sf_dir):
    return inventory.by_disposition(decisions(spark, sf_dir)).select("disposition", "n", "n_bytes")


@registered
def q04_inventory_summary(spark, sf_dir):
    return inventory.summary(decisions(spark, sf_dir)).withColumn("estimated_hours", F.round("estimated_hours", 9))


@registered
def q05_by_subject(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.lit("INCLUDE_TAGGED").alias("disposition"), text.subjects_in(F.split("p_name", " "), PARTS).alias("matched_subjects"))
    return inventory.by_subject(words)


@registered
def q06_stats(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    assets = o.select(F.floor("o_totalprice").cast("bigint").alias("filesize"), F.when(F.col("o_orderstatus") == "F", "video").otherwise("photo").alias("media_type"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).alias("taken_at"), F.when(F.col("o_custkey") % 3 == 0, F.col("o_totalprice")).alias("gps_latitude"), F.when(F.col("o_custkey") % 3 == 0, F.when(F.col("o_custkey") % 2 == 0, "inferred").otherwise("exif")).alias("gps_source"))
    return stats.asset_stats(assets)


@registered
def q07_distinct_people(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@registered
def q08_grouped_counts(spark, sf_dir):
    return stats.counted(table(spark, sf_dir, "orders"), "o_orderpriority", F.col("o_orderstatus") == "O")


@registered
def q09_month_folders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("at", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate")))
    return o.groupBy(dates.month_directory(F.col("at")).alias("folder")).agg(F.count(F.lit(1)).alias("n"))


@registered
def q10_checksums(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))


def document_files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))


@registered
def q11_exact_duplicates(spark, sf_dir):
    d = document_files(spark, sf_dir)
    masters = d.groupBy("sha256").agg(F.min("doc_id").alias("master_id"), F.count(F.lit(1)).alias("copies"))
    return d.join(dealt_anew(masters, "sha256"), "sha256").select("doc_id", "master_id", "copies", (F.col("doc_id") != F.col("master_id")).alias("is_duplicate"))


@registered
def q12_best_first(spark, sf_dir):
    return upsert.first_of_each(document_files(spark, sf_dir), ["source"], [F.desc("n_chars"), "doc_id"]).select("source", "doc_id", "n_chars")


@registered
def q13_strictly_smaller(spark, sf_dir):
    d = document_files(spark, sf_dir).withColumns({"w": (F.col("doc_id") % 5).cast("int"), "h": (F.col("doc_id") % 7).cast("int")})
    master = upsert.first_of_each(d, ["lang", "source"], [F.desc("n_chars"), "doc_id"]).select("lang", "source", F.col("doc_id").alias("master_id"), F.col("w").alias("mw"), F.col("h").alias("mh"), F.col("n_chars").alias("ms"))
    c = F.col
    return d.join(master, ["lang", "source"]).select("doc_id", "master_id", values.strictly_smaller(c("w"), c("h"), c("n_chars"), c("mw"), c("mh"), c("ms")).alias("smaller"), dedupe.verdict_of(c("w"), c("h"), c("n_chars"), c("mw"), c("mh"), c("ms")).alias("verdict"), values.pixels(c("w"), c("h")).alias("pixels"))


@registered
def q14_collision_names(spark, sf_dir):
    d = document_files(spark, sf_dir)
    new = d.select(F.concat(F.lit("inbox/"), F.col("doc_id").cast("string"), F.lit("/"), F.col("source"), F.lit(".jpg")).alias("path"), F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.col("source")).alias("rel_path"), "doc_id", "sha256", F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.col("n_chars").alias("filesize"), F.when(F.col("lang") != "en", F.make_timestamp_ntz(F.lit(2020), F.when(F.col("lang") == "de", 1).otherwise(2), F.lit(1), F.lit(0), F.lit(0), F.lit(0))).alias("taken_at"))
    new = upsert.first_of_each(new, ["sha256"], ["doc_id"])
    taken = spark.createDataFrame([("undated/src0.jpg", "0" * 64)], "vault_path string, sha256 string")
    return filed(new, taken).select("doc_id", "vault_path", "renamed")


@registered
def q15_names(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", text.join_names(F.split("p_name", " ")).alias("joined"))
    p = p.withColumn("joined", F.concat("joined", F.lit(" ;; ")))
    return p.select("p_partkey", text.join_names(text.split_names(F.col("joined"))).alias("names"), F.size(text.split_names(F.col("joined"))).cast("bigint").alias("n"))


@registered
def q16_normalized_tags(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    raw = F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit("\t \n"), F.lower(F.col("c_mktsegment")), F.lit(" "))
    return c.select("c_custkey", text.normalize_tag(raw).alias("tag"))


STAMPS = ("2015:06:15 12:00:00", "2015-06-15T12:00:00.123", "0000:00:00 00:00:00", "2015:02:30 10:00:00", "2015:06:15 24:00:00", "2015:06:15 23:59:60", "not a date", "2016:02:29 01:02:03+07:00", "", None, "\t2015:06:15 12:00:00", "\n\u00a02015:06:15 12:00:01\r")


@registered
def q17_embedded_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    made = F.concat(F.date_format("o_orderdate", "yyyy:MM:dd"), F.lit(" 0"), (F.col("o_orderkey") % 10).cast("string"), F.lit(":30:15.25"))
    fixed = F.element_at(F.array(*[F.lit(s).cast("string") for s in STAMPS]), (F.col("o_orderkey") % len(STAMPS) + 1).cast("int"))
    raw = F.when(F.col("o_orderkey") % 2 == 0, made).otherwise(fixed)
    return o.select("o_orderkey", F.date_format(dates.parse_embedded(raw), "yyyy-MM-dd HH:mm:ss").alias("taken_at"))


@registered
def q18_add_months(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.add_months(F.to_date("o_orderdate"), (F.col("o_orderkey") % 19).cast("int")).cast("string").alias("later"))


@registered
def q19_coordinates(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    lat, lon = values.coordinates((F.col("s_acctbal") / 100).cast("string"), F.when(F.col("s_suppkey") % 5 == 0, "x").otherwise((F.col("s_acctbal") / 50).cast("string")))
    zero = F.col("s_suppkey") % 7 == 0
    lat0, lon0 = values.coordinates(F.when(zero, "0").otherwise("1.5"), F.when(zero, "0.0").otherwise("2.5"))
    return s.select("s_suppkey", lat.alias("lat"), lon.alias("lon"), lat0.alias("lat0"), lon0.alias("lon0"), values.positive_int((F.col("s_suppkey") - 5).cast("string")).alias("width"))


def fingerprints(spark, sf_dir):
    """A 64-bit sign fingerprint of each embedding."""
    one = F.lit(1).cast("bigint")
    bits = F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda acc, i: F.when(F.element_at("embedding", i + 1) > 0, acc.bitwiseOR(F.call_function("shiftleft", one, i))).otherwise(acc))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", bits.alias("bits"))


@registered
def q20_hamming_pairs(spark, sf_dir):
    rows = fingerprints(spark, sf_dir).select("vec_id", "bits")
    return similarity.links(rows, "vec_id", THRESHOLD).select("a", "b", F.col("distance").cast("int").alias("distance"))


def embedded_files(spark, sf_dir):
    """Embeddings as files with contents: every tenth file and the fifth after it are one content, of the other odd ones up to three in a row are."""
    prints, v = fingerprints(spark, sf_dir), F.col("vec_id")
    same = F.when(v % 2 == 0, v).when(v % 10 == 5, v - 5).otherwise(F.floor(v / 6) * 6 + 1)
    files = prints.select("vec_id", same.alias("content")).join(prints.select(v.alias("content"), "bits"), "content")
    c = F.col("content")
    return files.select("vec_id", "bits", (c % 9 * 100).cast("int").alias("width"), (c % 7 * 100).cast("int").alias("height"), (c % 11 * 1000).cast("bigint").alias("filesize"), F.sha2(c.cast("string"), 256).alias("sha256"))


def incoming(spark, sf_dir):
    """The odd ones, as files of an inbox."""
    rows, v = embedded_files(spark, sf_dir).filter("vec_id % 2 = 1"), F.col("vec_id")
    taken = F.when(v % 4 == 1, F.make_timestamp_ntz(F.lit(2020), (v % 3 + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    return rows.select(F.format_string("in/%d/%d.jpg", v, v % 197).alias("path"), F.format_string("%010d", v).alias("rel_path"), "sha256", "bits", "width", "height", "filesize", "vec_id", taken.alias("taken_at"))


def archive(spark, sf_dir):
    """The even ones, as assets."""
    return embedded_files(spark, sf_dir).filter("vec_id % 2 = 0").select(F.col("vec_id").alias("id"), "sha256", "bits", "width", "height", "filesize")


def classified(spark, sf_dir):
    return dedupe.classify(incoming(spark, sf_dir), archive(spark, sf_dir), THRESHOLD)


@registered
def q21_classify(spark, sf_dir):
    return classified(spark, sf_dir).select("vec_id", "verdict", "master_id", F.col("distance").cast("int").alias("distance"))


@registered
def q22_greedy(spark, sf_dir):
    return dedupe.greedy(incoming(spark, sf_dir), archive(spark, sf_dir), THRESHOLD).select("vec_id", "verdict", "master_id", "master_path", "distance")


@registered
def q23_verdict_counts(spark, sf_dir):
    return classified(spark, sf_dir).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("filesize"), F.lit(0)).alias("n_bytes"))


def as_assets(files):
    rows = files.withColumn("phash", F.lower(F.lpad(F.hex("bits"), 16, "0")))
    return schemas.conform(rows.withColumns({"vault_path": F.format_string("2020/02/%d.jpg", "id"), "original_filename": F.col("id").cast("string"), "taken_at_source": F.lit("unknown"), "media_type": F.lit("photo"), "imported_at": F.timestamp_micros(F.lit(0))}), schemas.ASSETS)


@registered
def q24_rerun(spark, sf_dir):
    """A second run after the first one's imports: nothing is new."""
    files = incoming(spark, sf_dir)
    first = dedupe.greedy(files, archive(spark, sf_dir), THRESHOLD)
    new = first.filter("verdict = 'new'").select((F.col("vec_id") + 1_000_000_000).alias("id"), "sha256", "bits", "width", "height", "filesize")
    again = dedupe.greedy(files, archive(spark, sf_dir).unionByName(new), THRESHOLD)
    return again.select("vec_id", "verdict", "master_id", "distance")


def ingest(spark, sf_dir):
    files = incoming(spark, sf_dir).withColumn("phash", F.lower(F.lpad(F.hex("bits"), 16, "0")))
    return plan_ingest(schemas.conform(files, schemas.IDENTIFIED), as_assets(archive(spark, sf_dir)), threshold=THRESHOLD)


@registered
def q25_ingest_plan(spark, sf_dir):
    """The accounting of a whole plan: one row."""
    return ingest(spark, sf_dir).counts()


@registered
def q26_ingest_reasons(spark, sf_dir):
    return ingest(spark, sf_dir).reasons()


@registered
def q27_ingest_places(spark, sf_dir):
    """Where new files go."""
    return ingest(spark, sf_dir).assets.select("path", "vault_path", "renamed", "original_filename", "media_type")


@registered
def q28_ingest_reviews(spark, sf_dir):
    """What a plan leaves to people, and the file each entry compares with."""
    found = ingest(spark, sf_dir).reviews
    return found.select("original_path", "kind", values.detail_map(F.col("detail")).getItem("master").alias("master"))


def located(spark, sf_dir):
    """Events as assets: sign-ups are located by a camera, errors aren't located."""
    e = table(spark, sf_dir, "events")
    own = F.col("event_type") == "signup"
    return e.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 50 != 0, F.col("ts")).alias("taken_at"), F.when(own, F.col("value")).when(F.col("event_type") != "error", F.lit(0.5)).alias("gps_latitude"), F.when(own, -F.col("value")).when(F.col("event_type") != "error", F.lit(0.25)).alias("gps_longitude"), F.when(own, "exif").when(F.col("event_type") != "error", "inferred").alias("gps_source"))


@registered
def q30_nearest_in_time(spark, sf_dir):
    a = located(spark, sf_dir)
    found = nearest(a.filter("gps_latitude IS NULL AND taken_at IS NOT NULL").select("id", "taken_at"), a.filter("gps_source = 'exif'"), "taken_at", "id", [], 2.0)
    return found.select("id", "anchor_id", F.round(F.col("gap_s") * 1_000_000).cast("bigint").alias("gap_us"))


@registered
def q31_location_bands(spark, sf_dir):
    return enrich.infer_locations(located(spark, sf_dir)).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@registered
def q32_set_locations(spark, sf_dir):
    a = located(spark, sf_dir)
    updates = enrich.infer_locations(a).select("id", "latitude", "longitude", "source")
    more = a.filter("id % 9 = 0 AND gps_latitude IS NOT NULL").select("id", F.lit(9.0).alias("latitude"), F.lit(8.0).alias("longitude"), F.lit("inferred").alias("source"))
    return enrich.set_locations(a, updates.unionByName(more)).select("id", "gps_latitude", "gps_longitude", "gps_source")


@registered
def q33_location_counts(spark, sf_dir):
    a = located(spark, sf_dir)
    return enrich.location_counts(a, enrich.infer_locations(a)).withColumn("coverage", F.round("coverage", 9))


def tag_rows(spark, sf_dir):
    """Line items as tagged files: the part's key as checksum, the part's name as people; every fifth part isn't an asset."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    pairs = li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_partkey").cast("string").alias("sha256"), F.when(F.col("l_suppkey") % 4 != 0, F.split("p_name", " ")).otherwise(F.array().cast("array<string>")).alias("names"))
    return pairs, p.filter("p_partkey % 5 <> 0").select(F.col("p_partkey").cast("string").alias("sha256"), F.col("p_partkey").alias("id"))


@registered
def q40_person_tags(spark, sf_dir):
    pairs, assets = tag_rows(spark, sf_dir)
    return enrich.tally(enrich.person_tags(pairs, assets, PARTS))


@registered
def q41_person_counts(spark, sf_dir):
    pairs, assets = tag_rows(spark, sf_dir)
    return enrich.person_counts(pairs, assets).withColumn("coverage", F.round("coverage", 9))


@registered
def q42_names_of_assets(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return stats.names_of(n.select(F.col("n_nationkey").alias("asset_id"), F.col("n_regionkey").alias("person_id")), r.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")))


def vault_tables(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    path = F.col("o_orderkey").cast("string")
    assets = o.filter("o_orderkey % 10 <> 3").select(path.alias("vault_path"), F.col("o_custkey").alias("filesize"), F.sha2(path, 256).alias("sha256"))
    key = F.col("o_orderkey")
    files = o.filter("o_orderkey % 10 <> 4").select(path.alias("path"), F.when(key % 10 == 5, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("size_bytes"), F.when(key % 10 == 6, "x").otherwise(F.sha2(path, 256)).alias("sha256"))
    return assets, files


@registered
def q43_verify_vault(spark, sf_dir):
    return verify.verify_vault(*vault_tables(spark, sf_dir))


@registered
def q44_verify_vault_shallow(spark, sf_dir):
    return verify.counts(verify.verify_vault(*vault_tables(spark, sf_dir), deep=False))


@registered
def q45_verify_manifest(spark, sf_dir):
    assets, files = vault_tables(spark, sf_dir)
    return verify.counts(verify.verify_manifest(assets.select(F.col("vault_path").alias("path"), "sha256"), files.select("path", "sha256")))


def dated_folders(spark, sf_dir):
    """Events as files in folders by day: what was listed, and what is there after something happened on the fifth of every month."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    path = F.concat(F.date_format("ts", "yyyy/MM/dd/"), n.cast("string"), F.lit(".jpg"))
    listed = e.select(path.alias("path"), F.sha2(path, 256).alias("sha256"))
    fifth = F.dayofmonth("ts") == 5
    there = e.filter(~(fifth & (n % 4 == 2))).select(F.when(fifth & (n % 4 == 3), F.concat(path, F.lit(".new"))).otherwise(path).alias("path"), F.when(fifth & (n % 4 == 1), "x").otherwise(F.sha2(path, 256)).alias("sha256"))
    return listed, there


@registered
def q91_verify_changed_folders(spark, sf_dir):
    """The files of folders that differ by the tree of digests."""
    return digest_tree.verify_changes(*dated_folders(spark, sf_dir))


@registered
def q92_verify_by_tree(spark, sf_dir):
    listed, there = dated_folders(spark, sf_dir)
    before = digest_tree.tree(listed)
    return digest_tree.counts(before, digest_tree.verify_changes(listed, there, before))


@registered
def q93_near_spellings(spark, sf_dir):
    """The nearest part names of misspelt ones."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("option"), "p_partkey")
    key = (F.col("p_partkey") % 7 + 1).cast("int")
    wrong = F.concat(F.substring(F.col("option"), F.lit(1), key), F.when(key % 2 == 0, "x").otherwise(""), F.substring(F.col("option"), key + 2, F.lit(99)))
    return spellings.closest(names.select(wrong.alias("name")), names)


@registered
def q46_orphans(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return o.join(li.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey")


@registered
def q47_orphan_sidecars(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    media = o.filter(key % 3 != 0).select(F.format_string("d/I_%d.jpg", key).alias("path"), F.lit(True).alias("is_media"), F.lit(False).alias("is_sidecar"))
    side = o.select(F.when(key % 2 == 0, F.format_string("d/I_%d.jpg.json", key)).otherwise(F.format_string("d/I_%d.json", key)).alias("path"), F.lit(False).alias("is_media"), F.lit(True).alias("is_sidecar"))
    return verify.orphan_sidecars(media.unionByName(side))


@registered
def q48_get_or_create(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    known = spark.createDataFrame([(1, "MACHINERY"), (7, "HOUSEHOLD")], "id bigint, name string")
    return upsert.get_or_create(known, c.select(F.col("c_mktsegment").alias("name")), "name")[0]


@registered
def q49_insert_or_ignore(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("asset_id"), F.col("event_type").alias("kind"), "value", "event_id")
    there = rows.filter("asset_id % 4 = 0").select("asset_id", "kind").distinct()
    return upsert.new_rows(there, rows, ["asset_id", "kind"], ["event_id"]).select("asset_id", "kind", "event_id", "value")


@registered
def q50_union_first_wins(spark, sf_dir):
    d = document_files(spark, sf_dir)
    live = d.filter("doc_id % 3 <> 0").withColumn("origin", F.lit("live"))
    gone = d.filter("doc_id % 2 = 0").withColumn("origin", F.lit("trash"))
    both = live.withColumn("_from", F.lit(0)).unionByName(gone.withColumn("_from", F.lit(1)))
    return upsert.first_of_each(both, ["doc_id"], ["_from"]).select("doc_id", "origin")


@registered
def q51_path_predicates(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    bare = F.regexp_replace(F.regexp_extract("url", "://([^?#]*)", 1), "/$", "")
    kinds = F.element_at(F.array(*[F.lit(x) for x in (".JPG", ".mov", ".heic", ".txt", "", ".trashes/a.png", "/__MACOSX/b.jpeg", "/.x.jpg")]), (F.col("page_id") % 8 + 1).cast("int"))
    rel = F.concat(bare, kinds)
    return p.select("page_id", paths.extension(rel).alias("ext"), paths.stem(rel).alias("stem"), paths.is_media(rel).alias("media"), paths.media_type(rel).alias("kind"), paths.can_hash(rel).alias("hashable"), paths.is_system(rel).alias("system"), paths.is_content(rel).alias("content"))


@registered
def q52_json_detail(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    bad = ("[1]", "{bad", "{'k':1}", '{"k":1} x', '{"k":1},{"k":2}', '{"k":1}],[{}', '{"k":1}}', '"k"', "", None)
    broken = F.element_at(F.array(*[F.lit(b).cast("string") for b in bad]), (F.col("event_id") % len(bad) + 1).cast("int"))
    raw = F.when(F.col("event_id") % 3 == 0, broken).otherwise(F.concat(F.lit(" "), F.col("props"), F.lit("\n")))
    found = values.detail_map(raw)
    return e.select("event_id", F.try_element_at(found, F.lit("k")).alias("k"), F.size(found).cast("bigint").alias("n"))


@registered
def q53_filtered_listing(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    return stats.listed(e, 50, "event_id", event_type="purchase", user_id=None)


@registered
def q54_count_listing(spark, sf_dir):
    return stats.counted(table(spark, sf_dir, "events"), "event_type").orderBy(F.desc("n"), "event_type")


@registered
def q55_date_precedence(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    shipped = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("ship"))
    rows = o.join(shipped, "o_orderkey", "left")
    at, source = dates.taken_at(F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-07:00\t"))), F.when(F.col("o_orderkey") % 4 == 1, "0000:00:00 00:00:00"), F.date_format("ship", "yyyy:MM:dd HH:mm:ss"))
    return rows.select("o_orderkey", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("taken_at"), source.alias("source"))


@registered
def q56_estimates(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("size", (F.col("l_quantity") * 1_000_000).cast("bigint"))
    found = li.groupBy("l_returnflag").agg(F.sum("size").alias("n_bytes"), F.count_if(F.col("l_linestatus") == "F").alias("part"), F.count(F.lit(1)).alias("whole"))
    return found.select("l_returnflag", "n_bytes", F.round(values.download_hours(F.col("n_bytes")), 6).alias("hours"), F.round(values.ratio(F.col("part"), F.col("whole")), 9).alias("share"), values.ratio(F.col("part"), F.lit(0)).alias("nothing"))


@registered
def q57_album_overlap(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", text.has_any(F.split("p_name", " "), ("RED ", "Bolt")).alias("excluded"))


@registered
def q58_backfill(spark, sf_dir):
    a = located(spark, sf_dir).withColumn("vault_path", F.col("id").cast("string"))
    read = a.filter("id % 3 <> 0").select("vault_path", F.when(F.col("id") % 5 == 0, "0").otherwise("12.5").alias("latitude"), F.when(F.col("id") % 5 == 0, "0").when(F.col("id") % 7 == 0, "999").otherwise("-3.25").alias("longitude"))
    return enrich.backfill(a, read)[1]


@registered
def q59_backfill_updates(spark, sf_dir):
    a = located(spark, sf_dir).withColumn("vault_path", F.col("id").cast("string"))
    read = a.filter("id % 3 <> 0").select("vault_path", F.when(F.col("id") % 5 == 0, "0").otherwise("12.5").alias("latitude"), F.lit("-3.25").alias("longitude"))
    return enrich.backfill(a, read)[0]


@registered
def q60_constraints(spark, sf_dir):
    o, li, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "customer")
    parts = [("orders_unique", schemas.duplicate_keys(o, ["o_orderkey"])), ("lineitem_unique", schemas.duplicate_keys(li, ["l_orderkey", "l_linenumber"])), ("lineitem_orders", schemas.orphans(li, "l_orderkey", o, "o_orderkey")), ("orders_customer", schemas.orphans(o, "o_custkey", c.filter("c_custkey % 20 <> 1"), "c_custkey"))]
    out = None
    for name, rows in parts:
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@registered
def q61_latest_version(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.max("event_id").alias("version"))


@registered
def q62_library_flags(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    names = F.element_at(F.array(*[F.lit(x) for x in ("Screenshot 1.png", " screen shot 2.png", "IMG_1.jpg", "my screenshot.png", "\tScreenshot 3.png", "\u00a0\u2003SCREENSHOT.png")]), (F.col("event_id") % 6 + 1).cast("int"))
    photos = e.select(F.col("event_id").alias("uuid"), names.alias("original_filename"), F.when(F.col("event_id") % 9 == 0, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).otherwise(F.col("ts")).alias("date"), F.array(F.lit(" "), F.col("event_type"), F.lit(None).cast("string")).alias("persons"))
    found = library.to_items(photos, strict=False)
    return found.select(F.col("uuid").cast("bigint").alias("uuid"), "is_screenshot", "is_shared", "is_photo", F.col("date").isNull().alias("undated"), text.join_names(F.col("persons")).alias("persons"), "filesize")


@registered
def q63_selected(spark, sf_dir):
    return contract.selected(decisions(spark, sf_dir))


@registered
def q64_unknown_dates(spark, sf_dir):
    return inventory.unknown_dates(decisions(spark, sf_dir))
