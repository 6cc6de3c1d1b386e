import hashlib
import os
from datetime import datetime

import pytest

from photolith import schemas
from photolith.errors import ConflictError, ConstraintError, SourceError
from photolith.plans import filing
from photolith.sources.catalog import Catalog

NOW = datetime(2024, 5, 1, 10)


class Inbox:
    """Files of an inbox, and the rows that identify them."""

    def __init__(self, root):
        self.root, self.rows = root, []

    def add(self, name, content, taken_at=None, phash=None, width=None, height=None):
        path = self.root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
        own = {"path": str(path), "rel_path": name, "sha256": hashlib.sha256(content).hexdigest(), "filesize": len(content), "phash": phash, "taken_at": taken_at, "taken_at_source": "exif" if taken_at else "unknown", "width": width, "height": height, "gps_latitude": None, "gps_longitude": None}
        self.rows.append(tuple(own[c] for c in schemas.IDENTIFIED.names))
        return path

    def identified(self, spark):
        return spark.createDataFrame(self.rows, schemas.IDENTIFIED)


def by_name(found):
    return {r.path.rsplit("/in/", 1)[1]: r for r in found.collect()}


@pytest.fixture
def inbox(tmp_path):
    return Inbox(tmp_path / "in")


@pytest.fixture
def places(spark, tmp_path):
    return Catalog(spark, str(tmp_path / "index")), str(tmp_path / "vault")


def test_every_file_lands_is_linked_or_fails(spark, inbox, places, tmp_path):
    catalog, vault = places
    inbox.add("a.jpg", b"AAAA", datetime(2015, 6, 1))
    inbox.add("z/a.jpg", b"BBBB", datetime(2015, 6, 2))  # the name is taken by another file of the run
    inbox.add("copy.jpg", b"AAAA", datetime(2015, 6, 1))
    inbox.add("undated.jpg", b"CCCC")
    changed = inbox.add("changed.jpg", b"DDDD")
    inbox.add("changed-copy.jpg", b"DDDD")  # its best copy is read first by path
    gone = inbox.add("gone.jpg", b"EEEE")
    taken = inbox.add("taken.jpg", b"FFFF")
    spare = f"taken-{hashlib.sha256(b'FFFF').hexdigest()[:8]}.jpg"
    inbox.add("half.jpg", b"GGGG")
    (tmp_path / "in/changed-copy.jpg").write_bytes(b"XXXX")
    gone.unlink()
    os.makedirs(f"{vault}/undated")
    for name in ("taken.jpg", spare, "half.jpg"):
        (tmp_path / "vault/undated" / name).write_bytes(b"other")
    found = filing.ingest(inbox.identified(spark), catalog, vault, "one", NOW, "phone", chunk=3)
    got = by_name(found)
    outcome = {k: r.outcome for k, r in got.items()}
    assert outcome == {"a.jpg": "imported", "z/a.jpg": "imported", "copy.jpg": "linked", "undated.jpg": "imported", "changed-copy.jpg": "failed", "changed.jpg": "imported", "gone.jpg": "failed", "taken.jpg": "failed", "half.jpg": "imported"}
    assert got["changed-copy.jpg"].error == "the copy differs from its checksum" and got["gone.jpg"].error.startswith("FileNotFoundError") and got["taken.jpg"].error == "other content is there"
    assert got["z/a.jpg"].vault_path.startswith("2015/06/a-") and got["half.jpg"].vault_path.startswith("undated/half-")
    one = filing.counts(found).head()
    assert (one.scanned, one.imported, one.linked, one.deferred, one.failed, one.undated, one.renamed, one.imported_bytes, one.balanced) == (9, 5, 1, 0, 3, 3, 2, 20, True)
    assets = {r.vault_path: r for r in catalog.read("assets").collect()}
    assert len(assets) == 5 and all(hashlib.sha256(open(f"{vault}/{p}", "rb").read()).hexdigest() == r.sha256 for p, r in assets.items())
    assert [os.path.basename(r.original_path) for r in catalog.read("linked_files").collect()] == ["copy.jpg"]
    reviews = {os.path.basename(r.original_path): r for r in catalog.read("review_queue").collect()}
    assert set(reviews) == {"undated.jpg", "changed.jpg", "half.jpg"} and all(r.asset_id is not None for r in reviews.values())
    # A later run takes up what failed.
    changed.write_bytes(b"DDDD"), taken.write_bytes(b"FFFF"), gone.write_bytes(b"EEEE")
    os.unlink(f"{vault}/undated/{spare}")
    later = by_name(filing.ingest(inbox.identified(spark), catalog, vault, "two", NOW, "phone"))
    assert {k: r.outcome for k, r in later.items() if r.outcome != "linked"} == {"gone.jpg": "imported", "taken.jpg": "imported"}
    assert catalog.read("sources").count() == 1 and catalog.read("assets").select("id").distinct().count() == 7


class Killed(Exception):
    pass


def test_a_run_killed_between_chunks_goes_on(spark, inbox, places, tmp_path):
    catalog, vault = places
    for k in range(20):
        inbox.add(f"{k:02}.jpg", f"content {k % 17}".encode(), datetime(2016, 1 + k % 3, 1) if k % 4 else None)

    def kill(nth, number):
        if number == 1:
            raise Killed

    with pytest.raises(Killed):
        filing.ingest(inbox.identified(spark), catalog, vault, "r", NOW, chunk=5, after_chunk=kill)
    assert catalog.read("assets").count() == 10 and catalog.read("linked_files").count() == 0
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "vault").rglob("*.jpg")}
    inode = {p: p.stat().st_ino for p in before}
    seen = []
    found = filing.ingest(spark.createDataFrame([], schemas.IDENTIFIED), catalog, vault, "r", NOW, chunk=5, after_chunk=lambda *x: seen.append(x))
    assert seen == [(0, 2), (0, 3)]  # only what was left
    assert all(p.stat().st_ino == i and p.stat().st_mtime_ns == before[p] for p, i in inode.items())
    one = filing.counts(found).head()
    assert (one.scanned, one.imported, one.linked, one.failed, one.balanced) == (20, 17, 3, 0, True)
    assert catalog.read("assets").count() == 17 and catalog.read("linked_files").count() == 3
    assert catalog.read("review_queue").count() == one.undated
    again = filing.ingest(inbox.identified(spark), catalog, vault, "r", NOW, after_chunk=lambda *x: seen.append(x))
    assert len(seen) == 2 and filing.counts(again).head() == one and catalog.read("assets").count() == 17


def test_copies_that_were_made_but_not_recorded_are_found_in_place(spark, inbox, places, monkeypatch):
    catalog, vault = places
    for k in range(4):
        inbox.add(f"{k}.jpg", f"content {k}".encode())
    put = Catalog.commit

    def broken(self, appended=None, **more):
        if appended and "assets" in appended:
            raise Killed
        return put(self, appended, **more)

    monkeypatch.setattr(Catalog, "commit", broken)
    with pytest.raises(Killed):
        filing.ingest(inbox.identified(spark), catalog, vault, "r", NOW)
    assert len(os.listdir(f"{vault}/undated")) == 4 and catalog.read("assets").count() == 0
    monkeypatch.setattr(Catalog, "commit", put)
    one = filing.counts(filing.ingest(inbox.identified(spark), catalog, vault, "r", NOW)).head()
    assert (one.imported, one.renamed) == (4, 0) and len(os.listdir(f"{vault}/undated")) == 4


def test_what_was_near_a_failed_file_is_decided_anew(spark, inbox, places, tmp_path):
    catalog, vault = places
    best = inbox.add("best.jpg", b"b" * 900, datetime(2015, 6, 1), "de8f2130da8607f9", 4000, 3000)
    second = inbox.add("second.jpg", b"s" * 500, datetime(2015, 6, 1), "de8f2130da8607f9", 2000, 1500)
    inbox.add("third.jpg", b"t" * 100, datetime(2015, 6, 1), "de8f2130da8607f8", 1000, 750)
    inbox.add("odd.jpg", b"o" * 501, datetime(2015, 6, 1), "de8f2130da8607f9", 2000, 1500)
    best.write_bytes(b"changed")
    second.unlink()
    got = by_name(filing.ingest(inbox.identified(spark), catalog, vault, "r", NOW))
    assert {k: r.outcome for k, r in got.items()} == {"best.jpg": "failed", "odd.jpg": "imported", "second.jpg": "deferred", "third.jpg": "linked"}
    link = catalog.read("linked_files").head()
    asset = catalog.read("assets").head()
    assert link.master_asset_id == asset.id and asset.original_filename == "odd.jpg" and catalog.read("review_queue").head().kind == "ambiguous_match"


def test_runs_without_files_and_with_odd_names(spark, places):
    catalog, vault = places
    found = filing.ingest(spark.createDataFrame([], schemas.IDENTIFIED), catalog, vault, "none", NOW)
    one = filing.counts(found).head()
    assert (one.scanned, one.failed, one.balanced) == (0, 0, True)
    with pytest.raises(SourceError):
        filing.ingest(spark.createDataFrame([], schemas.IDENTIFIED), catalog, vault, "../x", NOW)


def test_a_commit_checks_new_rows_against_old_keys_and_refuses_a_changed_state(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "index"))
    people = lambda *rows: spark.createDataFrame(list(rows), schemas.PERSONS)
    catalog.append("persons", people((1, "a"), (2, "b")))
    for wrong in (((1, "c"),), ((3, "a"),), ((3, "c"), (4, "c"))):
        with pytest.raises(ConstraintError):
            catalog.append("persons", people(*wrong))
    assert catalog.read("persons").count() == 2
    other, write = Catalog(spark, str(tmp_path / "index")), Catalog._write

    def slow(self, table, rows):
        if self is catalog:
            other.append("persons", people((7, "meanwhile")))
        return write(self, table, rows)

    Catalog._write = slow
    try:
        with pytest.raises(ConflictError):
            catalog.append("persons", people((3, "c")))
    finally:
        Catalog._write = write
    assert sorted(r.name for r in catalog.read("persons").collect()) == ["a", "b", "meanwhile"]
    catalog.commit(notes={"x": 1})
    catalog.commit(notes={"y": [2]})
    assert (catalog.note("x"), catalog.note("y"), catalog.note("z")) == (1, [2], None)
