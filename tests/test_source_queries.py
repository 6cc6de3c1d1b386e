"""How the queries over files do their work: nothing that grows with the tables is left to one task or to the driver."""

import csv
import errno
import io
import os
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from photolith import schemas
from photolith.functions import dates
from photolith.plans import catalogue_sources as Q
from photolith.plans.ingest import filed
from photolith.plans.made_files import picture
from photolith.sources import decoders, files, pixels, vault


def test_an_inbox_is_written_by_all_tasks(spark, tmp_path):
    rows = spark.range(40, numPartitions=4).select(F.concat(F.lit("/in/"), "id").alias("path"), F.col("id").cast("string").alias("rel_path"), F.lit("s").alias("sha256"), F.col("id").alias("filesize"), F.lit("unknown").alias("taken_at_source"))
    for n in (4, 8):
        Q.drop_in(rows, str(tmp_path / "inbox"))
        assert len(list(Path(tmp_path / "inbox").glob("part-*.parquet"))) == n
    assert spark.read.parquet(str(tmp_path / "inbox")).count() == 80


def test_a_mounted_store_is_listed_by_tasks_as_spark_lists_it(spark, tmp_path):
    names = ["a b.jpg", "100%.jpg", "x+y.jpg", "é.jpg", "a%20b.jpg", "_h.jpg", "_k=1.jpg", ".d.jpg", "q/_z/r.jpg", "q/.y/r.jpg", "q/_metadata/r.jpg", "q/_metadata_x.jpg", "w._COPYING_", "h#?.jpg", "[x]{y}.jpg", "_common_metadata", "q/r/s.jpg"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text(n)
    by_spark = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).select("path", "length")
    want = {(r.path, r.length) for r in by_spark.collect()}
    for root in (str(tmp_path), f"file://{tmp_path}"):
        listed = files.list_store(spark, root)
        assert {(r.path, r.size_bytes) for r in listed.collect()} == want
        assert {r.rel_path for r in listed.collect()} == {p.removeprefix(f"file:{tmp_path}/") for p, _ in want}
        assert "binaryFile" not in listed._jdf.queryExecution().toString()


def test_files_of_one_split_are_written_by_all_tasks(spark, tmp_path):
    n = 2 * spark.sparkContext.defaultParallelism
    one = spark.range(400, numPartitions=1).select(F.concat(F.lit("x/"), "id").alias("rel_path"), F.col("id").cast("string").alias("content"))
    assert vault.over_cores(one).rdd.getNumPartitions() == n
    many = one.repartition(n + 1)
    assert vault.over_cores(many) is many
    Q.put(vault.over_cores(one), str(tmp_path / "d"))
    assert {p.name: p.read_text() for p in (tmp_path / "d/x").iterdir()} == {str(i): str(i) for i in range(400)}


def test_a_linked_copy_is_read_once_and_a_filled_one_again(tmp_path, monkeypatch):
    (tmp_path / "a.jpg").write_bytes(b"A")
    read, own = [], vault.sha256_of
    monkeypatch.setattr(vault, "sha256_of", lambda path: read.append(path) or own(path))
    want = own(str(tmp_path / "a.jpg"))
    assert vault.file_one(str(tmp_path / "a.jpg"), str(tmp_path / "v"), ["x/a.jpg"], want) == ("x/a.jpg", None)
    assert len(read) == 1

    def none(*_):
        raise OSError(errno.EPERM, "no links here")

    monkeypatch.setattr(os, "link", none)
    assert vault.file_one(str(tmp_path / "a.jpg"), str(tmp_path / "v"), ["x/b.jpg"], want) == ("x/b.jpg", None)
    assert len(read) == 3 and read[-1].endswith("x/b.jpg")


def test_pictures_are_held_a_few_at_a_time(spark, tmp_path, monkeypatch):
    n = 2 * decoders.HELD + 3
    for i in range(n):
        (tmp_path / f"{i}.png").write_bytes(picture(np.full((32, 32), i % 256, dtype=np.uint8) ^ np.arange(32, dtype=np.uint8), "png"))
    seen, own = [], pixels.hashes
    monkeypatch.setattr(pixels, "hashes", lambda squares: seen.append(len(squares)) or own(squares))
    run = []

    class Rows:
        """Stands for the dealt-out listing, whose function on batches is called here."""

        def mapInArrow(self, fn, _):
            run.append(fn)

    rows = spark.createDataFrame([(str(tmp_path / f"{i}.png"),) for i in range(n)], "path string")
    monkeypatch.setattr(decoders, "dealt_out", lambda _: Rows())
    decoders.with_phash(rows)
    table = pa.table({"path": [str(tmp_path / f"{i}.png") for i in range(n)]})
    (batch,) = table.append_column("_wanted", table["path"]).to_batches()
    found = pa.Table.from_batches(run[0]([batch]))
    assert found.num_rows == n and max(seen) == decoders.HELD and sum(seen) == n
    assert found["phash"].to_pylist() == own(np.array([pixels.square(Path(p).read_bytes()) for p in table["path"].to_pylist()]))


def test_a_manifest_is_written_by_tasks_in_path_order(spark, tmp_path, monkeypatch):
    odd = ['"', "a,b", "two\nlines", "é", "", None]
    rows = [(f"p{i * 7919 % 1000:03}{odd[i % 4]}", "", odd[i % 6], "x; y", i, f"\ts{i}\n" if i % 3 else None) for i in range(1000)]
    made = spark.createDataFrame(rows, schemas.MANIFEST).repartition(7)
    monkeypatch.setattr(type(made), "toLocalIterator", None)
    files.write_manifest(made, str(tmp_path))
    out = io.StringIO(newline="")
    csv.writer(out).writerows([schemas.MANIFEST.names, *(["" if v is None else v for v in r] for r in sorted(rows, key=lambda r: r[0].encode()))])
    assert (tmp_path / "manifest.csv").read_bytes() == out.getvalue().encode()
    assert [p.name for p in tmp_path.iterdir()] == ["manifest.csv"]
    files.write_manifest(made.limit(0), str(tmp_path))
    assert (tmp_path / "manifest.csv").read_text().strip() == ",".join(schemas.MANIFEST.names)


def test_what_grows_with_a_run_is_not_broadcast(spark, tmp_path):
    new = spark.createDataFrame([("a", "s", None, 1, 1, 9, "a"), ("b", "s", None, 1, 1, 8, "b")], "path string, sha256 string, bits bigint, width int, height int, filesize bigint, rel_path string")
    new = new.withColumn("taken_at", F.lit(None).cast("timestamp_ntz"))
    taken = spark.createDataFrame([("undated/c", "t")], "vault_path string, sha256 string")
    both = [filed(new, taken), schemas.orphans(new, "path", taken.withColumnRenamed("vault_path", "id"))]
    for df in both:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_a_stamp_is_matched_once_not_for_each_of_its_parts(spark):
    at = dates.parse_embedded(F.col("v"))
    rows = spark.createDataFrame([(v,) for v in ("2016:01:02 03:04:05x", "2016:13:02 03:04:05", "x", None)], "v string").select(at.alias("t"))
    assert [str(r.t) for r in rows.collect()] == ["2016-01-02 03:04:05", "None", "None", "None"]
    assert "regexp_extract(" not in rows._jdf.queryExecution().analyzed().toString()
