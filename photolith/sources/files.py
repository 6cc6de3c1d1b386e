"""Media files, their checksums, sidecars and manifests."""

from __future__ import annotations

import csv
import io
import json
import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from itertools import accumulate
from pathlib import Path
from urllib.parse import urlparse

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photolith import schemas
from photolith.errors import SourceError
from photolith.functions import dates, paths, text, values
from photolith.sources.scratch import settle
from photolith.sources.vault import dealt_out, with_sha256

MANIFEST_NAME = "manifest.csv"
#: The most rows of a manifest that are spelled at a time.
LINES = 4096


def _entries(folder: str, every: bool = False):
    """(path, is it a folder, bytes) of what a folder holds; what vanishes while it's read, or can't be read, isn't there. every: also what is no file."""
    try:
        with os.scandir(folder) as entries:
            for e in entries:
                try:
                    inner = e.is_dir(follow_symlinks=False)
                    if inner or every or e.is_file():
                        yield e.path, inner, 0 if inner else e.stat(follow_symlinks=not every).st_size
                except OSError:
                    continue
    except OSError:
        return


def levels(spark: SparkSession, folders: list[str], every: bool = False) -> Iterator[DataFrame]:
    """(path, is_folder, size_bytes) of what folders hold, one level of folders after the other, each a written table.

    Folders are read where tasks run, so neither names nor folders come to the driver.
    """

    def run(batches):
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = list(_entries(folder, every))
                names, dirs, sizes = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(names, type=pa.string()), pa.array(dirs, type=pa.bool_()), pa.array(sizes, type=pa.int64())], names=["path", "is_folder", "size_bytes"])

    level = spark.createDataFrame([(f,) for f in folders], "path string")
    while True:
        here = settle(level.mapInArrow(run, "path string, is_folder boolean, size_bytes bigint"), "listing")
        yield here
        level = here.filter("is_folder").select("path")
        if level.isEmpty():
            return
        level = level.repartition("path")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, rel_path, size_bytes) of all files below a local or mounted root, hidden and `_` names included."""
    base = os.path.abspath(os.path.expanduser(root))
    if not os.path.isdir(base):
        raise SourceError(f"not a folder: {root}")
    found = None
    for here in levels(spark, [base]):
        rows = here.filter("NOT is_folder").select("path", paths.relative_to(F.col("path"), base).alias("rel_path"), "size_bytes")
        found = rows if found is None else found.unionByName(rows)
    return dealt_out(found)  # few bytes, which would be one split, and names take longer to judge than to read


def _unlisted(relative: Column) -> Column:
    """Whether Spark's sources pass over a file for its name or that of a folder above it; they look into folders of summary files."""
    hidden = lambda n: n.startswith(".") | (n.startswith("_") & ~n.contains("=")) | n.endswith("._COPYING_")
    parts = F.split(relative, "/")
    above = F.slice(parts, 1, F.size(parts) - 1)
    return hidden(paths.name(relative)) | F.exists(above, lambda n: hidden(n) & ~n.startswith("_common_metadata") & ~n.startswith("_metadata"))


def list_store(spark: SparkSession, root: str) -> DataFrame:
    """As `list_files` for a store that Spark reads, with paths as it spells them; names that start with `_` or a dot aren't listed by Spark.

    Folders that are mounted are listed where tasks run, as Spark would list each file in its driver and then open it for its size; links to folders
    aren't followed there. Other stores are listed by Spark.
    """
    scheme = urlparse(root).scheme
    if scheme in ("", "file"):
        rows = list_files(spark, urlparse(root).path if scheme else root)
        return rows.filter(~_unlisted(F.col("rel_path"))).withColumn("path", F.concat(F.lit("file:"), "path"))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.select("path", paths.relative_to(F.col("path"), root).alias("rel_path"), F.col("length").alias("size_bytes"))


def scan(files: DataFrame, skip=()) -> DataFrame:
    """The media files of a listing that a scan keeps."""
    return files.filter(paths.is_content(F.col("rel_path"), skip))


def read_sidecars(spark: SparkSession, files: DataFrame, media: DataFrame) -> DataFrame:
    """(rel_path, date, albums, persons) of media with a JSON sidecar.

    `files` is the whole listing. Of a file's two possible names the first that exists counts, even if it can't be parsed;
    then all fields are empty, as they are where the JSON isn't an object. Of a list that isn't text, numbers and the like count as they
    are spelled, nulls not at all; a text in place of a list is its only entry.
    """
    wanted = media.select("rel_path", F.posexplode(paths.sidecars(F.col("rel_path"))).alias("nth", "sidecar")).filter(F.lower("sidecar").endswith(".json"))
    there = wanted.join(files.select(F.col("rel_path").alias("sidecar"), F.col("path").alias("at")), "sidecar")
    first = there.groupBy("rel_path").agg(F.min_by("at", "nth").alias("at"))

    def run(batches):
        for batch in batches:
            said = [_sidecar(at) for at in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, type=pa.string()) for x in (zip(*said, strict=True) if said else ([], [], [])))], names=["rel_path", "date", "albums", "persons"])

    return first.select("rel_path", "at").mapInArrow(run, "rel_path string, date string, albums string, persons string")


def _sidecar(path: str) -> tuple[str, str, str]:
    """Date, albums and persons of a JSON sidecar; empty where it can't be read or isn't one object."""
    try:
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
    except (OSError, ValueError, RecursionError):
        said = None
    if not isinstance(said, dict):
        return "", "", ""

    def listed(value) -> str:
        entries = value if isinstance(value, list) else [value or None]
        return "; ".join(str(x) for x in entries if x is not None)

    return str(said.get("date") or ""), listed(said.get("albums")), listed(said.get("persons"))


def build_manifest(spark: SparkSession, root: str, clean: bool = False) -> DataFrame:
    """The manifest rows of what is on a drive now. Nothing that was removed from it is counted or named.

    clean: first remove for good what was deleted in a review of the drive (`purge.clean`), as a drive that is handed over must be.
    """
    if clean:
        from photolith.sources import purge

        purge.clean(spark, root)
    files = list_files(spark, root)
    media = scan(files, (MANIFEST_NAME,))
    side = read_sidecars(spark, files, media)
    rows = with_sha256(media).join(side, "rel_path", "left")
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return rows.select(F.col("rel_path").alias("path"), empty("date"), empty("albums"), empty("persons"), "size_bytes", "sha256")


def write_manifest(manifest: DataFrame, root: str) -> Path:
    """One CSV file in path order, written where tasks run: each spells its part of the order, and then, when the parts' sizes are known, puts it in its place.

    Only names and sizes of parts come to the driver. The file appears under its name when it's whole.
    """
    target = Path(root).expanduser().absolute() / MANIFEST_NAME
    aside = target.parent / f".{uuid.uuid4().hex}.part"
    aside.mkdir()
    head, whole = _csv_lines([schemas.MANIFEST.names]), aside / "whole"

    def spelled(batches):
        name, size = uuid.uuid4().hex, 0
        with open(aside / name, "wb") as f:
            for batch in batches:
                for a in range(0, batch.num_rows, LINES):
                    size += f.write(_csv_lines(zip(*(c.to_pylist() for c in batch.slice(a, LINES).columns), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], type=pa.int32()), pa.array([name]), pa.array([size])], names=["part", "name", "size"])

    def placed(batches):
        for batch in batches:
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open(aside / name, "rb") as source, open(whole, "r+b") as out:
                    out.seek(at)
                    shutil.copyfileobj(source, out, 1 << 20)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    try:
        rows = settle(manifest.select(*schemas.MANIFEST.names), "manifest")  # a range is sampled first, and files should be read once
        ordered = rows.repartitionByRange("path").sortWithinPartitions("path")
        parts = sorted(tuple(r) for r in ordered.mapInArrow(spelled, "part int, name string, size bigint").collect())
        starts = list(accumulate((size for _, _, size in parts), initial=len(head)))
        whole.write_bytes(head)
        spark = manifest.sparkSession
        if parts:
            places = spark.createDataFrame([(name, at) for (_, name, _), at in zip(parts, starts, strict=False)], "name string, at bigint")
            places.repartition(len(parts)).mapInArrow(placed, "n bigint").agg(F.sum("n")).collect()
        if whole.stat().st_size != starts[-1]:
            raise SourceError(f"the parts of {target} don't make up the whole")
        whole.replace(target)
    finally:
        shutil.rmtree(aside, ignore_errors=True)
    return target


def _csv_lines(rows) -> bytes:
    text = io.StringIO(newline="")
    csv.writer(text).writerows(["" if v is None else v for v in row] for row in rows)
    return text.getvalue().encode()


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """A manifest's rows, empty fields as empty texts."""
    path = f"{root.rstrip('/')}/{MANIFEST_NAME}"
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs):
        raise SourceError(f"no {MANIFEST_NAME} in {root}")
    raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    has = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    fields = [F.coalesce(has(c), F.lit("")).alias(c) if c != "size_bytes" else F.coalesce(has(c).try_cast("bigint"), F.lit(0)).alias(c) for c in schemas.MANIFEST.names]
    return raw.select(*fields)


def manifest_tags(manifest: DataFrame) -> DataFrame:
    """(sha256, names) of the rows that have both."""
    rows = manifest.select(text.strip(F.col("sha256")).alias("sha256"), text.split_names(F.col("persons")).alias("names"))
    return rows.filter((F.col("sha256") != "") & (F.size("names") > 0))


def sidecar_tags(spark: SparkSession, root: str) -> DataFrame:
    """(sha256, names) of media with a sidecar that names people; only those are hashed."""
    files = list_files(spark, root)
    media = scan(files, (MANIFEST_NAME,))
    named = read_sidecars(spark, files, media).select("rel_path", text.split_names(F.col("persons")).alias("names")).filter(F.size("names") > 0)
    return with_sha256(media.join(named, "rel_path").select("path", "names")).select("sha256", "names")


def tags_from(spark: SparkSession, root: str) -> tuple[DataFrame, str]:
    """A drive's tags and their source: the manifest if there is one, else the sidecars."""
    if not os.path.isdir(os.path.expanduser(root)):
        raise SourceError(f"not a folder: {root}")
    if os.path.isfile(os.path.join(os.path.expanduser(root), MANIFEST_NAME)):
        return manifest_tags(read_manifest(spark, root)), "manifest"
    return sidecar_tags(spark, root), "sidecar"


#: Embedded tags; dates with the most trustworthy first.
DATE_TAGS = ("DateTimeOriginal", "CreateDate", "MediaCreateDate")
SIZE_TAGS = ("ImageWidth", "ImageHeight")
PLACE_TAGS = ("GPSLatitude", "GPSLongitude")


def read_embedded(files: DataFrame, reader: Callable[[list[str]], pd.DataFrame], batch: int = 200) -> DataFrame:
    """What a metadata reader says of each path: it gets up to `batch` paths and returns (path, the date tags, ImageWidth,
    ImageHeight, GPSLatitude, GPSLongitude) as texts; paths it leaves out have nothing."""
    names = ["path", *DATE_TAGS, *SIZE_TAGS, *PLACE_TAGS]

    def run(batches):
        for pdf in batches:
            for a in range(0, len(pdf), batch):
                said = reader(pdf["path"].iloc[a : a + batch].tolist()).reindex(columns=names).astype(object)
                yield pd.DataFrame({n: pd.Series([None if pd.isna(v) else str(v) for v in said[n]], dtype=object) for n in names})

    return dealt_out(files.select("path")).mapInPandas(run, ", ".join(f"{n} string" for n in names))


def metadata(embedded: DataFrame, side: DataFrame | None = None) -> DataFrame:
    """(path, taken_at, taken_at_source, width, height, gps_latitude, gps_longitude) from embedded values and sidecar dates (path, date); a file may have only one of them."""
    rows = embedded.join(side.select("path", F.col("date").alias("_date")), "path", "full_outer") if side is not None else embedded.withColumn("_date", F.lit(None).cast("string"))
    at, source = dates.taken_at(F.col("_date"), *[F.col(t) for t in DATE_TAGS])
    lat, lon = values.coordinates(F.col("GPSLatitude"), F.col("GPSLongitude"))
    return rows.select("path", at.alias("taken_at"), source.alias("taken_at_source"), values.positive_int(F.col("ImageWidth")).alias("width"), values.positive_int(F.col("ImageHeight")).alias("height"), lat.alias("gps_latitude"), lon.alias("gps_longitude"))


def identify(media: DataFrame, details: DataFrame, phashes: DataFrame | None = None) -> DataFrame:
    """Files with checksums, metadata and, where given as (path, phash), perceptual hashes."""
    rows = with_sha256(media).join(details, "path", "left")
    rows = rows.join(phashes, "path", "left") if phashes is not None else rows.withColumn("phash", F.lit(None).cast("string"))
    rows = rows.withColumn("taken_at_source", F.coalesce("taken_at_source", F.lit("unknown"))).withColumnRenamed("size_bytes", "filesize")
    return schemas.conform(rows, schemas.IDENTIFIED)


def write_lines(column: DataFrame, path: str, forbidden_root: str | None = None) -> int:
    """A column of texts as lines of one file; refuses to write inside `forbidden_root`."""
    target = Path(path).expanduser().resolve()
    if forbidden_root and target.is_relative_to(Path(forbidden_root).expanduser().resolve()):
        raise SourceError(f"{path} is inside {forbidden_root}")
    n = 0
    with target.open("w", encoding="utf-8") as f:
        for row in column.toLocalIterator():
            f.write(f"{row[0]}\n")
            n += 1
    return n


def write_report(one_row: DataFrame, path: str, **more) -> None:
    """A one-row table, and further values, as JSON."""
    said = {k: v.isoformat() if hasattr(v, "isoformat") else v for k, v in one_row.head().asDict().items()}
    Path(path).expanduser().write_text(json.dumps(said | more, indent=2, ensure_ascii=False, default=str), encoding="utf-8")
