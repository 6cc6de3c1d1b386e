import csv
import hashlib
import json
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from photolith import schemas
from photolith.config import Family, Subject
from photolith.errors import ConstraintError, SourceError
from photolith.operators import enrich, verify
from photolith.plans.ingest import apply_plan, plan_ingest
from photolith.sources import files as S
from photolith.sources import library
from photolith.sources.catalog import Catalog
from photolith.sources.vault import copy_into_vault, file_one
from photolith.streaming.inbox import take_in

NOW = datetime(2024, 5, 1, 10, 0, 0)


@pytest.fixture
def drive(tmp_path):
    root = tmp_path / "drive"
    for name, data in {"a.jpg": b"A", "sub/b.MOV": b"B" * 3_000_000, "sub/_c.heic": b"C", ".Trashes/501/gone.jpg": b"X", "$RECYCLE.BIN/g.jpg": b"X", ".hid.jpg": b"X", "note.txt": b"n", "sub/d, \"q\".png": b"D"}.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    (root / "a.jpg.json").write_text(json.dumps({"date": "2015-06-15T12:00:00-07:00", "albums": ["Trip"], "persons": ["Trey", "Bob"]}))
    (root / "a.json").write_text(json.dumps({"date": "1999-01-01"}))
    (root / "sub/b.json").write_text("{broken")
    (root / "sub/b.MOV.json").write_text("[1]")
    (root / "sub/orphan.jpg.json").write_text("{}")
    return root


def test_scan_and_manifest(spark, drive):
    made = S.build_manifest(spark, str(drive)).cache()
    rows = {r.path: r for r in made.collect()}
    assert set(rows) == {"a.jpg", "sub/b.MOV", "sub/_c.heic", 'sub/d, "q".png'}
    assert rows["a.jpg"].sha256 == hashlib.sha256(b"A").hexdigest() and rows["a.jpg"].persons == "Trey; Bob" and rows["a.jpg"].date.startswith("2015-06-15")
    assert rows["sub/b.MOV"].date == "" and rows["sub/b.MOV"].size_bytes == 3_000_000
    S.write_manifest(made, str(drive))
    with open(drive / S.MANIFEST_NAME, newline="") as f:
        assert [r["path"] for r in csv.DictReader(f)] == sorted(rows)
    again = S.read_manifest(spark, str(drive))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, made.select(*schemas.MANIFEST.names).collect()))
    assert {r.path for r in S.build_manifest(spark, str(drive)).collect()} == set(rows)
    tags, source = S.tags_from(spark, str(drive))
    assert source == "manifest" and [(r.sha256, r.names) for r in tags.collect()] == [(rows["a.jpg"].sha256, ["Trey", "Bob"])]
    (drive / S.MANIFEST_NAME).unlink()
    tags, source = S.tags_from(spark, str(drive))
    assert source == "sidecar" and [r.names for r in tags.collect()] == [["Trey", "Bob"]]
    with pytest.raises(SourceError):
        S.read_manifest(spark, str(drive))
    with pytest.raises(SourceError):
        S.list_files(spark, str(drive / "nowhere"))


def test_verify_a_drive(spark, drive):
    S.write_manifest(S.build_manifest(spark, str(drive)), str(drive))
    (drive / "a.jpg").write_bytes(b"Z")
    (drive / "sub/_c.heic").unlink()
    (drive / "new.png").write_bytes(b"N")
    there = S.with_sha256(S.scan(S.list_files(spark, str(drive)), (S.MANIFEST_NAME,))).select(F.col("rel_path").alias("path"), "sha256")
    got = {r.path: r.status for r in verify.verify_manifest(S.read_manifest(spark, str(drive)), there).collect()}
    assert got == {"a.jpg": "corrupted", "sub/_c.heic": "missing", "new.png": "unlisted", "sub/b.MOV": "ok", 'sub/d, "q".png': "ok"}


def test_decoders_degrade_to_unknown(spark, drive):
    import importlib.util
    import shutil

    from photolith.sources import decoders

    found = {r.rel_path: r.phash for r in decoders.with_phash(S.scan(S.list_files(spark, str(drive)))).collect()}
    assert len(found) == 4 and found["sub/b.MOV"] is None
    if importlib.util.find_spec("imagehash") is None:
        assert set(found.values()) == {None}
    if not shutil.which(decoders.PROGRAM):
        with pytest.raises(SourceError):
            decoders.embedded_reader([str(drive / "a.jpg")])


def test_orphans(spark, drive):
    from photolith.functions import paths

    listed = S.list_files(spark, str(drive))
    rows = listed.select(F.col("rel_path").alias("path"), paths.is_content(F.col("rel_path")).alias("is_media"), paths.extension(F.col("rel_path")).isin(*paths.SIDECAR).alias("is_sidecar"))
    assert [r.path for r in verify.orphan_sidecars(rows).collect()] == ["sub/orphan.jpg.json"]


def test_sinks(spark, tmp_path):
    one = spark.createDataFrame([("u1",), ("u2",)], "uuid string")
    assert S.write_lines(one.orderBy("uuid"), str(tmp_path / "ids.txt")) == 2 and (tmp_path / "ids.txt").read_text() == "u1\nu2\n"
    with pytest.raises(SourceError):
        S.write_lines(one, str(tmp_path / "out" / "ids.txt"), str(tmp_path / "out"))
    S.write_report(spark.createDataFrame([(1, NOW)], "n int, at timestamp"), str(tmp_path / "r.json"), library="demo")
    assert json.loads((tmp_path / "r.json").read_text())["library"] == "demo"


def test_metadata_and_vault(spark, drive, tmp_path):
    media = S.scan(S.list_files(spark, str(drive)))

    def reader(batch):
        return pd.DataFrame([{"path": p, "DateTimeOriginal": "0000:00:00 00:00:00", "CreateDate": "2016:01:02 03:04:05", "ImageWidth": "640", "ImageHeight": "0", "GPSLatitude": "0", "GPSLongitude": "0"} for p in batch if p.endswith(("jpg", "MOV"))])

    side = S.read_sidecars(spark, S.list_files(spark, str(drive)), media).join(media, "rel_path").select("path", "date")
    found = {r.path.rsplit("/", 1)[1]: r for r in S.metadata(S.read_embedded(media, reader, 2), side).collect()}
    assert found["a.jpg"].taken_at == datetime(2015, 6, 15, 12) and found["a.jpg"].taken_at_source == "sidecar"
    assert found["b.MOV"].taken_at == datetime(2016, 1, 2, 3, 4, 5) and found["b.MOV"].width == 640 and found["b.MOV"].height is None and found["b.MOV"].gps_latitude is None
    known = {r.rel_path: r for r in S.identify(media, S.metadata(S.read_embedded(media, reader), side)).collect()}
    assert known["sub/_c.heic"].taken_at_source == "unknown" and known["sub/_c.heic"].sha256 == hashlib.sha256(b"C").hexdigest()
    vault = tmp_path / "vault"
    plan = S.with_sha256(media).withColumn("vault_path", F.concat(F.lit("undated/"), F.regexp_extract("rel_path", "([^/]*)$", 1)))
    for _ in range(2):
        assert all(r.error is None for r in copy_into_vault(plan, str(vault)).collect())
    assert (vault / "undated/a.jpg").read_bytes() == b"A" and not list(vault.rglob("*.part"))
    (vault / "undated/a.jpg").write_bytes(b"other")
    assert [r.path.rsplit("/", 1)[1] for r in copy_into_vault(plan, str(vault)).collect() if r.error] == ["a.jpg"] and (vault / "undated/a.jpg").read_bytes() == b"other"


def identified(spark, rows):
    full = [tuple({"path": f"/in/{n}", "rel_path": n, "sha256": s, "filesize": z, "phash": p, "taken_at": t, "taken_at_source": "exif" if t else "unknown", "width": w, "height": h, "gps_latitude": g, "gps_longitude": g}[c] for c in schemas.IDENTIFIED.names) for n, s, p, w, h, z, t, g in rows]
    return spark.createDataFrame(full, schemas.IDENTIFIED)


INBOX = [
    ("one.jpg", "s1", "de8f2130da8607f9", 4000, 3000, 900, datetime(2015, 6, 15), 1.5), ("other.jpg", "s2", "0123456789abcdef", 4000, 3000, 900, datetime(2018, 3, 2), None), ("z/copy.jpg", "s1", "de8f2130da8607f9", 4000, 3000, 900, datetime(2015, 6, 15), 1.5),
    ("small.jpg", "s3", "de8f2130da8607f9", 1000, 750, 90, datetime(2015, 6, 15), None), ("undated.jpg", "s4", "fedcba9876543210", 10, 10, 5, None, None), ("undated.mp4", "s5", None, None, None, 70, None, None),
]


def snapshot(catalog):
    return {t: catalog.read(t).count() for t in ("assets", "linked_files", "review_queue", "sources")}


def run_once(spark, catalog, rows=INBOX):
    plan = plan_ingest(identified(spark, rows), catalog.read("assets"), catalog.read("linked_files"), catalog.read("review_queue"))
    one = plan.counts().head()
    apply_plan(plan, catalog, NOW, "phone")
    return one, {r.kind: r.n for r in plan.reasons().collect()}


def test_ingest_is_balanced_and_idempotent(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "index"))
    one, reasons = run_once(spark, catalog)
    assert (one.scanned, one.imported, one.linked, one.deferred, one.undated, one.balanced) == (6, 4, 2, 0, 2, True)
    assert reasons == {"exact_duplicate": 1, "low_res_twin": 1, "unknown_date": 2}
    assert snapshot(catalog) == {"assets": 4, "linked_files": 2, "review_queue": 2, "sources": 1}
    paths = {r.vault_path: r for r in catalog.read("assets").collect()}
    assert set(paths) == {"2015/06/one.jpg", "2018/03/other.jpg", "undated/undated.jpg", "undated/undated.mp4"}
    assert paths["2015/06/one.jpg"].gps_source == "exif" and paths["undated/undated.mp4"].media_type == "video" and paths["undated/undated.mp4"].source_id == 1
    one, _ = run_once(spark, catalog)
    assert (one.imported, one.linked) == (0, 6) and snapshot(catalog) == {"assets": 4, "linked_files": 6, "review_queue": 2, "sources": 1}
    one, _ = run_once(spark, catalog)
    assert snapshot(catalog) == {"assets": 4, "linked_files": 6, "review_queue": 2, "sources": 1}
    late = [("big.jpg", "s9", "de8f2130da8607f9", 8000, 6000, 9000, datetime(2015, 6, 15), None), ("odd.jpg", "s8", "de8f2130da8607f9", 4000, 3000, 901, None, None)]
    one, reasons = run_once(spark, catalog, late)
    assert one.deferred == 1 and one.imported == 0 and one.linked == 1 or one.deferred == 2
    assert catalog.read("assets").select("id").distinct().count() == catalog.read("assets").count()


def test_catalog_rules(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "index"))
    people = spark.createDataFrame([(1, "a"), (2, "b")], schemas.PERSONS)
    catalog.append("persons", people)
    with pytest.raises(ConstraintError):
        catalog.append("persons", spark.createDataFrame([(3, "a")], schemas.PERSONS))
    with pytest.raises(ConstraintError):
        catalog.append("asset_persons", spark.createDataFrame([(1, 1, "manifest")], schemas.ASSET_PERSONS))
    assert catalog.read("persons").count() == 2
    catalog.replace("persons", catalog.read("persons").filter("id = 2"))
    assert [r.name for r in catalog.read("persons").collect()] == ["b"]
    again = Catalog(spark, str(tmp_path / "index"), create=False)
    assert again.version == schemas.VERSION and again.read("persons").count() == 1
    again._put("_version", {"version": 99})
    with pytest.raises(SourceError):
        Catalog(spark, str(tmp_path / "index"))
    with pytest.raises(SourceError):
        Catalog(spark, str(tmp_path / "none"), create=False)


def test_a_commit_is_whole(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "index"))
    people = spark.createDataFrame([(1, "a")], schemas.PERSONS)
    links = spark.createDataFrame([(1, "s", "p", 99, "exact_duplicate", 1, NOW)], schemas.LINKED_FILES)
    with pytest.raises(ConstraintError):
        catalog.commit({"persons": people, "linked_files": links})
    assert catalog.read("persons").count() == 0 and catalog.read("linked_files").count() == 0
    tags = spark.createDataFrame([(1, 1, "manifest")], schemas.ASSET_PERSONS)
    catalog.commit({"persons": people, "asset_persons": tags}, checked=False)
    assert catalog.read("persons").count() == catalog.read("asset_persons").count() == 1


def test_listing_of_nested_and_empty_folders(spark, tmp_path):
    (tmp_path / "a/b/c/d").mkdir(parents=True)
    (tmp_path / "a/b/c/d/x.jpg").write_bytes(b"12")
    (tmp_path / "empty").mkdir()
    (tmp_path / "a/link").symlink_to(tmp_path / "a/b")
    (tmp_path / "a/y").symlink_to(tmp_path / "a/b/c/d/x.jpg")
    assert sorted(map(tuple, S.list_files(spark, str(tmp_path)).select("rel_path", "size_bytes").collect())) == [("a/b/c/d/x.jpg", 2), ("a/y", 2)]
    assert S.list_files(spark, str(tmp_path / "empty")).count() == 0


def test_a_sidecar_dates_files_that_the_reader_leaves_out(spark):
    side = spark.createDataFrame([("p", "2015-06-15T12:00:00")], "path string, date string")
    none = pd.DataFrame({c: pd.Series([], dtype=object) for c in ["path", *S.DATE_TAGS, *S.SIZE_TAGS, *S.PLACE_TAGS]})
    embedded = S.read_embedded(spark.createDataFrame([("p",)], "path string"), lambda batch: none)
    assert [(r.path, r.taken_at_source) for r in S.metadata(embedded, side).collect()] == [("p", "sidecar")]


def test_stream(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "index"))
    inbox = str(tmp_path / "inbox")
    identified(spark, INBOX[:3]).write.parquet(inbox)
    take_in(spark, inbox, catalog, str(tmp_path / "state"), NOW).awaitTermination()
    identified(spark, INBOX[3:]).write.mode("append").parquet(inbox)
    take_in(spark, inbox, catalog, str(tmp_path / "state"), NOW).awaitTermination()
    assert snapshot(catalog) == {"assets": 4, "linked_files": 2, "review_queue": 2, "sources": 0}


def test_library(spark):
    photos = spark.createDataFrame([("u", "Screenshot 2014.png", datetime(2014, 1, 1), [" ", "Trey"], None)], "uuid string, original_filename string, date timestamp_ntz, persons array<string>, albums array<string>")
    with pytest.raises(SourceError):
        library.to_items(photos)
    r = library.to_items(photos, strict=False).head()
    assert r.is_shared and r.is_screenshot and r.persons == ["Trey"] and r.filesize == 0 and not r.is_movie
    items = library.demo(spark, Family((Subject("A"),)), NOW.date())
    assert items.schema.names == schemas.LIBRARY_ITEMS.names
    both = library.all_items(items.filter("original_filename LIKE 'nothing-before%'"), items.withColumn("in_trash", F.lit(True)))
    assert both.count() == items.count() == 56 and both.filter("in_trash").count() == 52


def test_backfill(spark):
    a = spark.createDataFrame([(1, "p1", NOW, None), (2, "p2", None, None), (3, "p3", None, 1.0), (4, "p4", NOW, None), (5, "p5", NOW, None)], "id bigint, vault_path string, taken_at timestamp_ntz, gps_latitude double")
    read = spark.createDataFrame([("p1", "1.5", "2.5"), ("p2", "0", "0"), ("p4", None, None)], "vault_path string, latitude string, longitude string")
    updates, counts = enrich.backfill(a, read)
    assert [r.id for r in updates.collect()] == [1] and tuple(counts.head()) == (3, 1, 2, 1)


def test_files_are_placed_without_hard_links(tmp_path, monkeypatch):
    import errno
    import os

    def none(*_):
        raise OSError(errno.EPERM, "no links here")

    monkeypatch.setattr(os, "link", none)
    (tmp_path / "a.jpg").write_bytes(b"A")
    want, vault = hashlib.sha256(b"A").hexdigest(), str(tmp_path / "vault")
    source = str(tmp_path / "a.jpg")
    assert file_one(source, vault, ["undated/a.jpg"], want) == ("undated/a.jpg", None) == file_one(source, vault, ["undated/a.jpg"], want)
    (tmp_path / "vault/undated/b.jpg").write_bytes(b"other")
    assert file_one(source, vault, ["undated/b.jpg", "undated/b-1.jpg"], want) == ("undated/b-1.jpg", None)
    assert file_one(source, vault, ["undated/b.jpg"], want) == (None, "other content is there")
    assert file_one(source, vault, ["x/c.jpg"], "0" * 64)[1] == "the copy differs from its checksum" and not os.path.exists(f"{vault}/x/c.jpg")
    assert file_one(str(tmp_path / "gone.jpg"), vault, ["x/d.jpg"], want)[1].startswith("FileNotFoundError")
    assert file_one(source, vault, ["x/e.jpg"], None) == (None, "no checksum")
    assert sorted(p.name for p in (tmp_path / "vault").rglob("*") if p.is_file()) == ["a.jpg", "b-1.jpg", "b.jpg"]
