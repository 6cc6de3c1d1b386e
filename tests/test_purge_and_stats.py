import os
import shutil
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from photolith import schemas
from photolith.errors import SourceError
from photolith.operators import stats
from photolith.sources import files, purge
from photolith.sources.catalog import Catalog

NOW = datetime(2024, 5, 1, 10)


def tree(root):
    return sorted(str(p.relative_to(root)) for p in root.rglob("*"))


@pytest.fixture
def drive(tmp_path):
    root = tmp_path / "drive"
    for name in ("a.jpg", "a.jpg.json", "b.json", "B.MOV", "sub/c.heic.xmp", "sub/d.png", "sub/d.aae", "sub/note.txt", ".Trashes/501/x.jpg", ".Trashes/501/deep/er/y.jpg", ".TRASHES2/z.jpg", "$RECYCLE.BIN/r.jpg", "sub/.Trashes/kept.jpg", "__MACOSX/._a.jpg"):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    os.symlink("/nowhere", root / ".Trashes/501/broken")
    os.symlink(root / "sub", root / ".Trashes/501/elsewhere")
    return root


def test_trash_and_orphans_go_and_nothing_else(spark, drive):
    assert purge.clean(spark, str(drive)) is None
    left = [".TRASHES2", ".TRASHES2/z.jpg", "B.MOV", "a.jpg", "a.jpg.json", "sub", "sub/.Trashes", "sub/.Trashes/kept.jpg", "sub/d.aae", "sub/d.png", "sub/note.txt"]
    assert tree(drive) == left
    assert purge.clean(spark, str(drive)) is None and tree(drive) == left
    with pytest.raises(SourceError):
        purge.clean(spark, str(drive / "missing"))


def test_the_manifest_of_a_cleaned_drive(spark, drive):
    files.build_manifest(spark, str(drive)).collect()
    assert (drive / "b.json").exists()
    found = sorted(r.path for r in files.build_manifest(spark, str(drive), clean=True).collect())
    assert found == ["B.MOV", "a.jpg", "sub/d.png"] and not (drive / "b.json").exists()


def test_a_sidecar_whose_media_came_back_stays(spark, drive, monkeypatch):
    mark = purge.settle

    def slow(df, name):
        out = mark(df, name)
        (drive / "b.jpg").write_bytes(b"x")  # after the sidecars are marked
        return out

    monkeypatch.setattr(purge, "settle", slow)
    purge.orphaned_sidecars(spark, str(drive))
    assert (drive / "b.json").exists() and not (drive / "sub/c.heic.xmp").exists()


def assets(spark, ids, **more):
    base = spark.createDataFrame([(i,) for i in ids], "id bigint")
    own = {"sha256": F.col("id").cast("string"), "vault_path": F.col("id").cast("string"), "original_filename": F.lit("x"), "taken_at": F.when(F.col("id") % 4 > 0, F.lit("2015-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("id").cast("int"))), "taken_at_source": F.lit("exif"), "media_type": F.when(F.col("id") % 3 == 0, "video").otherwise("photo"), "filesize": F.col("id") * 10, "imported_at": F.lit(NOW).cast("timestamp"), "gps_latitude": F.when(F.col("id") % 2 == 0, 1.5), "gps_source": F.when(F.col("id") % 4 == 0, "inferred")}
    return base.withColumns(own | more)


def scanned(catalog):
    return stats.index_stats({t: catalog.read(t) for t in ("assets", "linked_files", "review_queue", "sources", "asset_persons")}).head()


def test_kept_statistics_equal_those_of_a_scan(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "index"))
    assert catalog.stats().head().asDict() == scanned(catalog).asDict()
    catalog.append("sources", spark.createDataFrame([(1, "phone", "other", NOW)], schemas.SOURCES))
    catalog.append("assets", assets(spark, range(1, 60)))
    catalog.append("assets", assets(spark, [100_000, 40_000, 70_000]))
    links = spark.createDataFrame([(i, "s", f"/{i}", 1, "exact_duplicate" if i % 2 else "low_res_twin") for i in range(5)], "id bigint, sha256 string, original_path string, master_asset_id bigint, reason string")
    catalog.append("linked_files", links)
    reviews = spark.createDataFrame([(i, f"/{i}", "unknown_date" if i % 2 else "ambiguous_match", "open" if i < 6 else "resolved") for i in range(8)], "id bigint, original_path string, kind string, status string")
    catalog.append("review_queue", reviews)
    catalog.append("persons", spark.createDataFrame([(1, "a"), (2, "b")], schemas.PERSONS))
    for person, ids in ((1, (1, 2, 3, 40_000)), (2, (2, 3, 4, 100_000, 59))):
        catalog.append("asset_persons", spark.createDataFrame([(i, person, "m") for i in ids], schemas.ASSET_PERSONS))
    one = catalog.stats()
    assert one.head().asDict() == scanned(catalog).asDict() and one.head().tagged_people == 7 and one.columns == stats.index_stats({t: catalog.read(t) for t in ("assets", "linked_files", "review_queue", "sources", "asset_persons")}).columns
    assert catalog.links_by_reason() == {"exact_duplicate": 2, "low_res_twin": 3} and catalog.open_reviews_by_kind() == {"unknown_date": 3, "ambiguous_match": 3}
    catalog.replace("review_queue", catalog.read("review_queue").withColumn("status", F.when(F.col("id") < 2, "resolved").otherwise(F.col("status"))))
    catalog.replace("asset_persons", catalog.read("asset_persons").filter("asset_id > 2"))
    catalog.replace("assets", catalog.read("assets").withColumn("taken_at", F.lit(None).cast("timestamp_ntz")))
    want = scanned(catalog).asDict()
    assert catalog.stats().head().asDict() == want and want["undated"] == 62 and want["tagged_people"] == 5 and want["open_reviews"] == 4 and want["earliest"] is None
    # No row is read: the tables may even be gone.
    for table in ("assets", "linked_files", "review_queue", "sources", "asset_persons"):
        for part in os.listdir(tmp_path / "index" / table):
            if not part.endswith(".ids"):
                shutil.rmtree(tmp_path / "index" / table / part)
    assert Catalog(spark, str(tmp_path / "index")).stats().head().asDict() == want


def test_parts_of_before_are_read(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "index"))
    catalog.append("assets", assets(spark, range(1, 9)))
    catalog.append("asset_persons", spark.createDataFrame([(1, 1, "m"), (1, 2, "m"), (5, 1, "m")], schemas.ASSET_PERSONS), checked=False)
    state = catalog._get("_state")
    for table in ("assets", "asset_persons"):
        for part in state[table]:
            part.pop("summary")
    catalog._put("_state", state)
    assert catalog.stats().head().asDict() == scanned(catalog).asDict() and catalog.stats().head().tagged_people == 2
