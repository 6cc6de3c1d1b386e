"""WARC archives: writing with payload deduplication, and reading with a verified chain of boundaries.

Writing: a record is header, block and a closing empty line; the text writer with that line as separator lays records end
to end. Payloads are compared by length and SHA-1: of equal ones the smallest id is written as a response, the others
as revisits of it. Only the groups of two and more are gathered, and only ids and digests are shuffled, with partial aggregation.

Reading: the archives are split at every occurrence of the magic line, in splits of any size, each task emitting a
candidate for each occurrence and, from its header, the offset of its successor. The candidates are written once; what follows works on
their narrow columns (file, offset, extent) and on that table alone, so it can't matter how a later read is split. Candidates of a split that follow each other
without a gap are one run; a run leads to the candidate at its last member's successor. Pointer jumping from the start
of each file marks the runs reached; candidates outside them are magic inside payloads, whose bytes go back to
the record that holds them. The number of rounds is the logarithm of the runs in a file, none where a file is one split and no payload holds the magic.
A candidate that is a whole record by its own header leaves its bytes behind and keeps their SHA-1; where it turns out to be part
of a payload, its bytes are fetched by that digest, and a piece that isn't found is an error.

Defined cases: null html: an empty payload (a response or a revisit like any other); null url: an empty target; line breaks in a url
are percent-encoded; rows with the id of their group's response are responses too; a null id is written as `none`, never
becomes the response of a group that has an id, and reads back as null; other columns are ignored; an empty table
gives no rows. Everything runs as DataFrame expressions in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photolith.llm._bytes import columns
from photolith.llm._store import delete, drop, new_path, stored

MAGIC = "WARC/1.1\r\n"
BLANK = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
RECORDS_PER_FILE = 50_000
BROADCAST_GROUPS = 200_000

_HEX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """The upper-case base32 SHA-1 of a binary or string column: 40 bits, so 8 characters, at a time."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*parts)), _HEX32, _BASE32)


def first_of_equal(rows: DataFrame) -> DataFrame:
    """digest, size and the smallest id of every payload that two or more of the rows (id, digest, size) have."""
    groups = rows.groupBy("digest", "size").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    return groups.filter("n > 1").drop("n")


def write(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> None:
    """Write one record for each row of `df`."""
    rows = columns(df, id=id_col, url=url_col, html=html_col).withColumn("html", F.coalesce("html", F.lit("")))
    sized = rows.select("id", "url", "html", base32_sha1(F.col("html")).alias("digest"), F.octet_length("html").cast("long").alias("size"))
    table = equal = stored(first_of_equal(sized.filter(F.col("size") >= least_bytes).select("id", "digest", "size")), "equal-payloads")
    if equal.count() <= BROADCAST_GROUPS:  # 60 bytes each; beyond, a join that AQE splits where a payload is hot
        equal = F.broadcast(equal)
    joined = sized.join(equal, ["digest", "size"], "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    text_ids = df.schema[id_col].dataType.simpleString() == "string"
    shown = lambda c: F.concat(F.lit("t:"), F.url_encode(c)) if text_ids else c.cast("string")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(shown(c), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(BLANK))
    block_size = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))
    target = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    header = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("id")),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), target,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name(F.col("first_id")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), block_size.cast("string"), F.lit(BLANK),
    )
    record = F.concat(header, http, F.when(revisit, "").otherwise(F.col("html")))
    joined.select(record.alias("value")).write.option("lineSep", BLANK).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)
    drop(table)


def _field(header: Column, name: str) -> Column:
    value = F.regexp_extract(header, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)
    return F.when(value != "", value)


def _block_columns(segment: Column) -> dict[str, Column]:
    """What a record's bytes after the magic line say."""
    header = F.substring_index(segment, BLANK, 1)
    head = F.octet_length(header) + 4
    length = F.try_to_number(_field(header, "Content-Length"), F.lit("9" * 18)).cast("long")
    return {"header": header, "head": head, "length": length}


def _payload_columns(raw: Column, header: Column, head: Column, length: Column, id_type: str) -> list[Column]:
    block = F.substring(raw, head + 1, length)
    http = F.substring_index(block.cast("string"), BLANK, 1)
    payload = F.substring(block, F.octet_length(http) + 5, length)
    kind = F.lower(_field(header, "WARC-Type"))
    full = kind != "revisit"
    page = lambda name: F.regexp_extract(_field(header, name), "<urn:page:t:([^>]*)>" if id_type == "string" else "<urn:page:(-?[0-9]+)>", 1)
    named = lambda name: F.url_decode(F.when(_field(header, name).contains("<urn:page:t:"), page(name))) if id_type == "string" else F.when(page(name) != "", page(name).cast(id_type))
    return [
        named("WARC-Record-ID").alias("page_id"),
        F.when(full, F.octet_length(payload).cast("long")).otherwise(_field(http, "Content-Length").try_cast("long")).alias("payload_bytes"),
        F.when(full, base32_sha1(payload)).otherwise(F.regexp_replace(_field(header, "WARC-Payload-Digest"), "^sha1:", "")).alias("payload_digest"),
        kind.alias("record_type"),
        named("WARC-Refers-To").alias("refers_to"),
    ]


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """The stretches between magic lines."""
    return spark.read.option("lineSep", MAGIC).text(path)


def candidates(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """A row for each stretch between magic lines: its split and place in it, its record's extent if it is one, and its columns.

    Stretches that aren't whole records by their own header keep their bytes, the others a digest of them.
    """
    raw = _scan(spark, path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"))
    said = _block_columns(F.col("value"))
    rows = raw.select("file", "block", "nth", "value", F.octet_length("value").cast("long").alias("size"), said["header"].alias("header"), said["head"].cast("long").alias("head"), said["length"].alias("length"))
    extent = F.lit(len(MAGIC)) + F.col("head") + F.col("length") + F.lit(len(BLANK))
    rows = rows.withColumn("extent", F.when(F.col("header").contains("WARC-Type"), extent))
    whole = F.coalesce(F.col("extent") == F.col("size") + len(MAGIC), F.lit(False))
    read = F.struct(*_payload_columns(F.col("value").cast("binary"), F.col("header"), F.col("head").cast("int"), F.col("length").cast("int"), id_type))
    return rows.select("file", "block", "nth", "size", "extent", F.when(whole, read).alias("record"), F.when(~whole, F.col("value")).alias("value"), F.when(whole, F.unhex(F.sha1("value"))).alias("digest"))


def placed(rows: DataFrame) -> DataFrame:
    """(file, block, nth, offset, extent, torn) of candidates, with prefix sums in each split and over the splits of a file."""
    total = F.col("size") + len(MAGIC)
    narrow = rows.select("file", "block", "nth", "size", "extent", F.col("record").isNull().alias("torn"))
    blocks = narrow.groupBy("file", "block").agg(F.sum(total).alias("bytes"))
    before = F.coalesce(F.sum("bytes").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum(total).over(Window.partitionBy("file", "block").orderBy("nth"))
    at = narrow.withColumn("inside", inside).join(blocks.select("file", "block", before.alias("before")), ["file", "block"])
    # What is before a file's first magic line, normally nothing, has no magic line of its own.
    return at.withColumn("offset", F.col("before") + F.col("inside") - F.col("size") - 2 * len(MAGIC)).filter("offset >= 0").select("file", "block", "nth", "offset", "extent", "torn")


def reachable(rows: DataFrame) -> DataFrame:
    """The rows (file, block, nth, offset, extent, ...) of `rows` with the column `real`: whether the chain from offset 0 comes to them."""
    order = Window.partitionBy("file", "block").orderBy("offset")
    after = F.col("offset") + F.col("extent")
    linked = F.coalesce(F.lag(after).over(order) == F.col("offset"), F.lit(False))
    rows = stored(rows.withColumn("run", F.max(F.when(~linked, F.col("offset"))).over(order)), "warc-places")
    runs = rows.groupBy("file", "run").agg(F.max_by(after, "offset").alias("to"))
    links = runs.select("file", F.col("run").alias("source"), F.col("to").alias("offset")).filter("offset IS NOT NULL")
    enters = rows.select("file", "offset", "run").join(links, ["file", "offset"])
    reached = runs.filter("run = 0").select("file", "run")
    made = []
    many = runs.groupBy("file").count().agg(F.max("count")).head()[0] or 0
    if many > 1:
        jump = stored(enters.select("file", F.col("source"), F.col("run").alias("target")), "warc-jumps")
        made.append(jump)
        step = 1
        while step < many:
            ahead = reached.join(jump, (reached.file == jump.file) & (reached.run == jump.source)).select(jump.file, F.col("target").alias("run"))
            reached = stored(reached.unionByName(ahead).distinct(), "warc-reached")
            made.append(reached)
            twice = jump.alias("a").join(jump.alias("b"), F.expr("a.file = b.file AND a.target = b.source")).select("a.file", "a.source", "b.target")
            step *= 2
            if step < many:
                jump = stored(twice, "warc-jumps")
                made.append(jump)
    entry = reached.withColumnRenamed("run", "source").join(enters, ["file", "source"]).select("file", "run", F.col("offset").alias("entry"))
    entry = entry.unionByName(reached.filter("run = 0").select("file", "run", F.col("run").alias("entry")))
    entry = entry.groupBy("file", "run").agg(F.min("entry").alias("entry"))
    out = stored(rows.join(entry, ["file", "run"], "left").withColumn("real", F.coalesce(F.col("offset") >= F.col("entry"), F.lit(False))).drop("run", "entry"), "warc-reachable")
    drop(rows, *made)
    return out


def _some(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_GROUPS else ids  # 40 bytes each at most


def read(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """One row for each record of the archives under `path`, which may be deleted or changed once this has returned; ids are numbers or, as `string`, texts."""
    rows = stored(candidates(spark, path, id_type), "warc-candidates")
    places = reachable(placed(rows))
    unreal = stored(places.filter("NOT real").select("nth"), "warc-unreal")
    whole = rows.filter("record IS NOT NULL").join(_some(unreal), "nth", "left_anti").select("record.*")
    # Records that magic inside their payload cut into several stretches: put together again.
    cut = places.join(places.filter("torn OR NOT real").select("file").distinct(), "file", "left_semi")
    holder = F.last(F.when(F.col("real"), F.struct("offset", "torn")), ignorenulls=True).over(Window.partitionBy("file").orderBy("offset"))
    torn = stored(cut.withColumn("holder", holder).filter("holder.torn").select("nth", "file", "offset", F.col("holder.offset").alias("at")), "warc-torn")
    drop(places)
    pieces = torn.join(rows.select("nth", "value", "digest"), "nth")
    lost = torn.join(rows.filter("record IS NOT NULL").select("nth", "digest"), "nth").select("digest").distinct()
    if not lost.isEmpty():  # whole records inside payloads, whose bytes were left behind
        again = _scan(spark, path).select(F.unhex(F.sha1("value")).alias("digest"), F.col("value").alias("bytes_again"))
        again = stored(again.join(_some(lost), "digest", "left_semi").dropDuplicates(["digest"]), "warc-again")
        pieces = pieces.join(again, "digest", "left").withColumn("value", F.coalesce("value", "bytes_again"))
    held = F.coalesce("value", F.raise_error(F.concat(F.lit("a piece of the record at "), F.col("at").cast("string"), F.lit(" is missing from "), F.col("file"))).cast("string"))
    piece = F.struct("offset", held.alias("value"))
    joined = pieces.groupBy("file", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["value"]), MAGIC).alias("value"))
    said = _block_columns(F.col("value"))
    joined = joined.select("value", said["header"].alias("header"), said["head"].alias("head"), said["length"].cast("int").alias("length"))
    return whole.unionByName(joined.select(*_payload_columns(F.col("value").cast("binary"), F.col("header"), F.col("head"), F.col("length"), id_type)))


def write_and_read(df: DataFrame, **options) -> DataFrame:
    """The records of `df` after a round trip through archives, which are deleted once they are read."""
    path = new_path(df.sparkSession, "warc")
    write(df, path, **options)
    found = read(df.sparkSession, path, df.schema[options.get("id_col", "page_id")].dataType.simpleString())
    delete(df.sparkSession, path)
    return found
