import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from photolith import schemas
from photolith.config import Contract, Family, Subject
from photolith.operators import contract, dedupe, enrich, inventory, similarity, stats, upsert, verify
from photolith.operators.nearest_time import nearest
from photolith.plans.ingest import filed
from photolith.sources import library

FAMILY = Family((Subject("Subject One", ("Subject 1", "Sub One"), 3), Subject("Subject Two", (), 3), Subject("Subject Three", ("Trey",), 2)))
CUTOFF = date(2015, 1, 1)
RULES = Contract(CUTOFF)


def ruled(spark, rows, rules=RULES):
    base = {"uuid": "u", "original_filename": "f", "date": datetime(2014, 6, 1), "persons": [], "albums": [], "is_screenshot": False, "is_hidden": False, "in_trash": False, "is_shared": False, "is_photo": True, "is_movie": False, "is_live_photo": False, "is_missing": False, "filesize": 1, "path": None}
    made = [base | {"uuid": str(i)} | r for i, r in enumerate(rows)]
    df = spark.createDataFrame([tuple(r[n] for n in schemas.LIBRARY_ITEMS.names) for r in made], schemas.LIBRARY_ITEMS)
    found = {int(r.uuid): r for r in contract.decide(df, rules, FAMILY).collect()}
    return [found[i] for i in range(len(rows))]


def test_contract_rules_and_boundaries(spark):
    after = datetime(2016, 1, 1)
    rows = [
        ({"date": datetime(2014, 12, 31, 23, 59)}, "INCLUDE_PRE_CUTOFF"), ({"date": datetime(2015, 1, 1)}, "EXCLUDE_UNTAGGED"), ({"date": datetime(2015, 1, 1), "persons": [" TREY "]}, "INCLUDE_TAGGED"),
        ({"date": after, "is_screenshot": True, "persons": ["Sub One"]}, "EXCLUDE_SCREENSHOT"), ({"is_screenshot": True}, "INCLUDE_PRE_CUTOFF"), ({"is_shared": True}, "EXCLUDE_NOT_OWNED"), ({"is_shared": None}, "EXCLUDE_NOT_OWNED"),
        ({"is_hidden": True, "date": None}, "EXCLUDE_ALBUM"), ({"in_trash": True}, "EXCLUDE_ALBUM"), ({"albums": ["x", "recently   DELETED"]}, "EXCLUDE_ALBUM"), ({"date": None, "persons": ["Trey"]}, "REVIEW_UNKNOWN_DATE"),
        ({"is_shared": True, "is_hidden": True}, "EXCLUDE_NOT_OWNED"), ({"date": after, "persons": None, "albums": None}, "EXCLUDE_UNTAGGED"),
    ]
    assert [r.disposition for r in ruled(spark, [r for r, _ in rows])] == [w for _, w in rows]
    edge = ruled(spark, [{"date": datetime(2016, 6, 30, 23)}, {"date": datetime(2016, 7, 1)}, {"date": datetime(2016, 6, 30), "persons": ["Trey"]}])
    assert [r.in_untagged_window for r in edge] == [True, False, False]
    loose = Contract(CUTOFF, exclude_screenshots=False, exclude_not_owned=False, exclude_albums=())
    assert [r.disposition for r in ruled(spark, [{"is_shared": True}, {"date": after, "is_screenshot": True, "persons": ["trey"]}, {"albums": ["Hidden"]}], loose)] == ["INCLUDE_PRE_CUTOFF", "INCLUDE_TAGGED", "INCLUDE_PRE_CUTOFF"]
    assert ruled(spark, [{"persons": ["Trey", "sub one", "Trey", "Nobody"]}])[0].matched_subjects == ["Subject One", "Subject Three"]


RULED = {"shared": "EXCLUDE_NOT_OWNED", "hidden": "EXCLUDE_ALBUM", "intrash": "EXCLUDE_ALBUM", "album": "EXCLUDE_ALBUM", "undated": "REVIEW_UNKNOWN_DATE"}


def demo_ruling(name):
    """What the name of an item of the demo says of it."""
    why, side, who, _ = name.rsplit(".", 1)[0].split("-")
    late = "EXCLUDE_SCREENSHOT" if why == "screenshot" else "EXCLUDE_UNTAGGED" if who == "nobody" else "INCLUDE_TAGGED"
    return RULED.get(why, "INCLUDE_PRE_CUTOFF" if side == "before" else late)


def test_inventory_of_the_demo(spark):
    made = contract.decide(library.demo(spark, FAMILY, CUTOFF), RULES, FAMILY).cache()
    rows = made.collect()
    assert len(rows) == 7 * 4 * 2 * 2 == len({r.uuid for r in rows})
    assert [r.disposition for r in rows] == [demo_ruling(r.original_filename) for r in rows]
    one = inventory.summary(made).head()
    kept = [r for r in rows if r.disposition.startswith("INCLUDE")]
    assert (one.scanned, one.included_count, one.review_count) == (112, len(kept), 16) and one.excluded_count == 96 - len(kept)
    assert (one.included_movies, one.included_live_photos, one.cloud_only_count) == tuple(sum(getattr(r, c) for r in kept) for c in ("is_movie", "is_live_photo", "is_missing")) and one.included_movies
    assert one.window_count == sum(r.in_untagged_window for r in rows) and one.included_bytes == sum(r.filesize for r in kept)
    found = {r.disposition: r.n for r in inventory.by_disposition(made).collect()}
    assert len(found) == 7 and all(found.values()) and sum(found.values()) == 112
    assert {r.subject: r.n for r in inventory.by_subject(made).collect()} == {s.name: sum(s.name in r.matched_subjects for r in kept) for s in FAMILY.subjects}
    assert contract.selected(made).count() == len(kept) and inventory.unknown_dates(made).count() == 16
    empty = inventory.summary(made.limit(0)).head()
    assert empty.scanned == 0 and empty.included_bytes == 0 and empty.earliest is None
    assert inventory.by_disposition(made.limit(0)).count() == 7


def test_bands_miss_no_pair(spark):
    rng = random.Random(1)
    hashes = [rng.getrandbits(64) for _ in range(40)]
    for h in list(hashes):
        for _ in range(4):
            x = h
            for _ in range(rng.randrange(12)):
                x ^= 1 << rng.randrange(64)
            hashes.append(x)
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    df = spark.createDataFrame([*enumerate(signed), (9999, None)], "i int, bits bigint")
    for t in (0, 3, 8, 11):
        got = {(r.l.i, r.r.i, r.distance) for r in similarity.pairs_within(df, df, t, keep=F.col("l.i") < F.col("r.i")).collect()}
        want = {(i, j, (hashes[i] ^ hashes[j]).bit_count()) for i in range(len(hashes)) for j in range(i + 1, len(hashes)) if (hashes[i] ^ hashes[j]).bit_count() <= t}
        assert got == want
        assert similarity.pairs_within(df, df, t, keep=F.col("l.i") < F.col("r.i")).count() == len(want)


@pytest.mark.parametrize("width, threshold", [(64, 8), (64, 20), (64, 0), (64, 63), (16, 5)])
def test_bands_cover_every_distance(width, threshold):
    for count in range(1, min(threshold + 1, width) + 1):
        cut = similarity.bands(width, threshold, count)
        assert cut[0][0] == 0 and cut[-1][1] == width and all(x[1] == y[0] for x, y in zip(cut, cut[1:], strict=False))
        assert sum(r + 1 for _, _, r in cut) > threshold or any(r == high - low for low, high, r in cut)


def test_chance_meetings_stay_far_below_all_pairs():
    n = 10**6
    cut = similarity.cheapest(64, 8, n, n)
    met = sum(similarity._volume(*b) / 2 ** (b[1] - b[0]) for b in cut)
    assert met < 0.001 and sum(similarity._volume(*b) for b in cut) <= similarity.MOST_MASKS
    assert similarity.cheapest(64, 20, 2000, 2000) is None  # by cells: no more than all pairs


@pytest.mark.parametrize("plan", ["bands", "cells"])
def test_hashes_of_all_lengths(spark, monkeypatch, plan):
    from photolith.functions import values

    if plan == "cells":
        monkeypatch.setattr(similarity, "cheapest", lambda *_: None)
        monkeypatch.setattr(similarity, "CELL", 7)
    else:
        monkeypatch.setattr(similarity, "cheapest", lambda width, t, *_: similarity.bands(width, t, min(t + 1, 3)))
    rng = random.Random(5)
    made = ["ff", "00ff", "0" * 16, "f" * 16, None, "zz", "", "0ff"]
    for digits in (2, 4, 16, 32, 40):
        base = rng.getrandbits(4 * digits)
        for _ in range(12):
            x = base
            for _ in range(rng.randrange(7)):
                x ^= 1 << rng.randrange(4 * digits)
            made.append(f"{x:0{digits}x}")
    df = spark.createDataFrame(list(enumerate(made)), "i int, phash string").withColumn("bits", values.hash_words(F.col("phash")))
    fine = [(i, h) for i, h in enumerate(made) if h and all(c in "0123456789abcdef" for c in h)]
    for t in (0, 3, 6):
        got = {(r.l.i, r.r.i, r.distance) for r in similarity.pairs_within(df, df, t, keep=F.col("l.i") < F.col("r.i")).collect()}
        assert got == {(i, j, (int(x, 16) ^ int(y, 16)).bit_count()) for i, x in fine for j, y in fine if i < j and len(x) == len(y) and (int(x, 16) ^ int(y, 16)).bit_count() <= t}


def test_links_name_copies_once(spark):
    df = spark.createDataFrame([(3, 0), (1, 0), (2, 0), (9, 1), (8, 1), (7, None), (6, 255)], "i long, bits long")
    assert sorted(map(tuple, similarity.links(df, "i", 2).collect())) == [(1, 2, 0), (1, 3, 0), (1, 8, 1), (8, 9, 0)]


MASTER = (7, "m" * 64, 0xDE8F2130DA8607F9 - (1 << 64), 4000, 3000, 5_000_000)


@pytest.mark.parametrize("row, threshold, want", [
    (("m" * 64, 0, 1, 1, 1), 8, ("exact_duplicate", 7, 0)), (("a", ~MASTER[2], 1, 1, 1), 8, ("new", None, None)), (("a", None, 1, 1, 1), 8, ("new", None, None)), (("a", MASTER[2], 1000, 750, 100_000), 8, ("low_res_twin", 7, 0)),
    (("a", MASTER[2], 4000, 3000, 5_100_000), 8, ("ambiguous_match", 7, 0)), (("a", MASTER[2], 6000, 4000, 9_000_000), 8, ("higher_res_arrived", 7, 0)), (("a", MASTER[2] ^ 1, 1000, 750, 1), 0, ("new", None, None)),
    (("a", MASTER[2] ^ 1, 1000, 750, 1), 8, ("low_res_twin", 7, 1)), (("a", MASTER[2], None, 750, 1), 8, ("ambiguous_match", 7, 0)),
])
def test_classify(spark, row, threshold, want):
    archive = spark.createDataFrame([MASTER, (9, "n" * 64, MASTER[2] ^ 0b111, 10, 10, 10)], "id bigint, sha256 string, bits bigint, width int, height int, filesize bigint")
    df = spark.createDataFrame([("p", *row)], "path string, sha256 string, bits bigint, width int, height int, filesize bigint")
    r = dedupe.classify(df, archive, threshold).head()
    assert (r.verdict, r.master_id, r.distance) == want


def sequential(files, archive, threshold):
    """The rules one file at a time."""
    def key(f):
        return (-((f["width"] or 0) * (f["height"] or 0)), -f["filesize"], f["rel_path"])

    view = [dict(a, order=(0, a["id"])) for a in sorted(archive, key=lambda a: a["id"])]
    out = {}
    for n, f in enumerate(sorted(files, key=key)):
        same = [m for m in view if m["sha256"] == f["sha256"]]
        if same:
            m = min(same, key=lambda m: m["order"])
            out[f["path"]] = ("exact_duplicate", m.get("id"), m.get("path"), 0)
            continue
        near = [((m["bits"] ^ f["bits"]) & (2**64 - 1)).bit_count() for m in view if m["bits"] is not None] if f["bits"] is not None else []
        hashed = [m for m in view if m["bits"] is not None]
        best = min(zip(near, hashed, strict=True), key=lambda x: (x[0], x[1]["order"]), default=None) if near else None
        if best is None or best[0] > threshold:
            out[f["path"]] = ("new", None, None, None)
            view.append({k: f[k] for k in ("sha256", "bits", "width", "height", "filesize", "path")} | {"order": (1, n)})
            continue
        d, m = best
        known = all((f["width"], f["height"], m["width"], m["height"]))
        if known and f["width"] < m["width"] and f["height"] < m["height"] and f["filesize"] < m["filesize"]:
            verdict = "low_res_twin"
        elif known and f["width"] > m["width"] and f["height"] > m["height"]:
            verdict = "higher_res_arrived"
        else:
            verdict = "ambiguous_match"
        out[f["path"]] = (verdict, m.get("id"), m.get("path"), d)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_greedy_equals_the_sequential_rules(spark, seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(63) for _ in range(5)]

    def bits():
        x = rng.choice(centres)
        for _ in range(rng.randrange(9)):
            x ^= 1 << rng.randrange(63)
        return x if rng.random() < 0.9 else None

    files = []
    for i in range(90):
        files.append({"path": f"/in/{i}", "rel_path": f"{i:03}", "sha256": f"s{rng.randrange(70)}", "bits": bits(), "width": rng.choice([None, 0, 100, 200, 300]), "height": rng.choice([100, 200, 300]), "filesize": rng.randrange(1, 6)})
    by_sha = {}
    for f in files:  # the same bytes have the same picture
        first = by_sha.setdefault(f["sha256"], f)
        f.update({k: first[k] for k in ("bits", "width", "height", "filesize")})
    archive = [{"id": i, "sha256": f"s{60 + i}", "bits": bits(), "width": 200, "height": 200, "filesize": 3} for i in range(8)]
    f = spark.createDataFrame([tuple(x.values()) for x in files], "path string, rel_path string, sha256 string, bits bigint, width int, height int, filesize bigint")
    a = spark.createDataFrame([tuple(x.values()) for x in archive], "id bigint, sha256 string, bits bigint, width int, height int, filesize bigint")
    got = {r.path: (r.verdict, r.master_id, r.master_path, r.distance) for r in dedupe.greedy(f, a, 5).collect()}
    assert got == sequential(files, archive, 5)
    assert len({v[0] for v in got.values()}) >= 3


def test_file_names(spark):
    rows = [("/i/a/x.jpg", "a/x.jpg", "1" * 64, None, None, 5, datetime(2020, 2, 3)), ("/i/b/x.jpg", "b/x.jpg", "2" * 64, None, None, 9, datetime(2020, 2, 9)), ("/i/y", "y", "3" * 64, None, None, 1, None), ("/i/z.jpg", "z.jpg", "4" * 64, None, None, 1, None)]
    df = spark.createDataFrame(rows, "path string, rel_path string, sha256 string, width int, height int, filesize bigint, taken_at timestamp_ntz")
    taken = spark.createDataFrame([("undated/z.jpg", "5" * 64), ("undated/y", "3" * 64)], "vault_path string, sha256 string")
    got = {r.path: (r.vault_path, r.renamed) for r in filed(df, taken).collect()}
    assert got == {"/i/b/x.jpg": ("2020/02/x.jpg", False), "/i/a/x.jpg": ("2020/02/x-11111111.jpg", True), "/i/y": ("undated/y", False), "/i/z.jpg": ("undated/z-44444444.jpg", True)}


T0 = datetime(2015, 6, 15, 12)


def assets(spark, rows):
    return spark.createDataFrame([(i, t, lat, lon, s) for i, t, lat, lon, s in rows], "id bigint, taken_at timestamp_ntz, gps_latitude double, gps_longitude double, gps_source string")


@pytest.mark.parametrize("anchors, target, want", [
    ([(0, 1.0)], 20, 1.0), ([(0, 1.0)], 9 * 60, None), ([(-120, 1.0), (30, 2.0)], 20, 2.0), ([(690, 1.0)], 750, None), ([(-30, 1.0), (30, 2.0)], 0, 1.0), ([(0, 1.0)], 0, 1.0), ([], 0, None),
])
def test_inference(spark, anchors, target, want):
    rows = [(i, T0 + timedelta(minutes=m), lat, 5.0, "exif") for i, (m, lat) in enumerate(anchors)] + [(99, T0 + timedelta(minutes=target), None, None, None), (100, None, None, None, None)]
    got = enrich.infer_locations(assets(spark, rows)).collect()
    assert [r.latitude for r in got] == ([] if want is None else [want])


def test_inferences_never_chain_and_never_replace_records(spark):
    rows = [(1, T0, 1.0, 2.0, "exif"), (2, T0 + timedelta(minutes=30), None, None, None), (3, T0 + timedelta(hours=7), None, None, None), (4, T0 + timedelta(hours=4), None, None, None), (5, T0 + timedelta(hours=7), 9.0, 9.0, "inferred")]
    a = assets(spark, rows)
    updates = enrich.infer_locations(a)
    assert {r.id: r.band for r in updates.collect()} == {2: "high", 4: "low"}
    one = enrich.location_counts(a, updates).head()
    assert (one.considered, one.inferred, one.high, one.low, one.skipped) == (3, 2, 1, 1, 1)
    forced = updates.select("id", "latitude", "longitude", "source").unionByName(spark.createDataFrame([(1, 0.5, 0.5, "inferred"), (5, 0.5, 0.5, "exif")], "id bigint, latitude double, longitude double, source string"))
    done = {r.id: (r.gps_latitude, r.gps_source) for r in enrich.set_locations(a, forced).collect()}
    assert done == {1: (1.0, "exif"), 2: (1.0, "inferred"), 3: (None, None), 4: (1.0, "inferred"), 5: (0.5, "exif")}


@pytest.mark.parametrize("seed", range(3))
def test_nearest_equals_trying_all(spark, seed):
    rng = random.Random(seed)
    at = lambda: T0.replace(hour=0) + timedelta(seconds=rng.randrange(0, 3 * 86400, rng.choice([1, 300, 3600])))
    anchors = [(i, at()) for i in range(120)]
    targets = [(1000 + i, at()) for i in range(200)] + [(5, None)]
    t = spark.createDataFrame(targets, "id bigint, taken_at timestamp_ntz")
    a = spark.createDataFrame(anchors, "id bigint, taken_at timestamp_ntz").withColumn("x", F.col("id") * 2)
    got = {r.id: (r.anchor_taken_at, r.gap_s) for r in nearest(t, a, "taken_at", "id", ["x"], 4).collect()}
    want = {}
    for i, when in targets:
        near = [(abs((w - when).total_seconds()), w) for _, w in anchors if when and w.date() == when.date() and abs((w - when).total_seconds()) <= 4 * 3600]
        if near:
            gap, w = min(near)
            want[i] = (w, gap)
    assert got == want


def test_nearest_with_a_clock_never_set(spark):
    zero, later = T0.replace(hour=0), T0.replace(hour=0) + timedelta(minutes=3)
    t = spark.createDataFrame([(i, zero, "x") for i in range(3000)] + [(5, zero, "x"), (9000, later, "x"), (9001, None, "x")], "id bigint, taken_at timestamp_ntz, _best string")
    a = spark.createDataFrame([(i, zero) for i in (7, 3, 900, None)] + [(1, later)], "id bigint, taken_at timestamp_ntz")
    got = nearest(t, a, "taken_at", "id", [], 1)
    assert got.columns == ["id", "taken_at", "_best", "anchor_id", "anchor_taken_at", "gap_s"]
    assert [tuple(r) for r in got.groupBy("anchor_id", "gap_s").count().orderBy("count").collect()] == [(1, 0.0, 1), (None, 0.0, 3001)]
    assert nearest(t, a.filter("id > 3"), "taken_at", "id", [], 1).filter("id = 9000").head().anchor_id == 900
    assert nearest(t.limit(0), a, "taken_at", "id", [], 1).count() == nearest(t, a.limit(0), "taken_at", "id", [], 1).count() == 0


def test_person_tags(spark):
    a = spark.createDataFrame([("s1", 1), ("s2", 2)], "sha256 string, id bigint")
    pairs = spark.createDataFrame([("s1", ["Trey", "Subject Three", "Bob"]), ("s2", []), ("s9", ["Trey"]), (None, ["x"]), ("", ["x"])], "sha256 string, names array<string>")
    tags = enrich.person_tags(pairs, a, FAMILY)
    assert {r.person: (r.n, r.n_unknown) for r in enrich.tally(tags).collect()} == {"Subject Three": (2, 0), "Bob": (1, 1)}
    one = enrich.person_counts(pairs, a).head()
    assert (one.files_read, one.matched, one.unmatched, one.coverage) == (2, 1, 1, 0.5)
    assert enrich.person_counts(pairs.limit(0), a).head().coverage == 0.0


def test_verify(spark):
    listed = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z"), ("d", 4, "w")], "vault_path string, filesize bigint, sha256 string")
    files = spark.createDataFrame([("a", 1, "x"), ("b", 9, "y"), ("d", 4, "q"), ("e", 1, "e")], "path string, size_bytes bigint, sha256 string")
    deep = {r.path: r.status for r in verify.verify_vault(listed, files).collect()}
    assert deep == {"a": "ok", "b": "corrupted", "c": "missing", "d": "corrupted", "e": "untracked"}
    quick = {r.path: r.status for r in verify.verify_vault(listed, files, deep=False).collect()}
    assert quick["d"] == "ok"
    manifest = {r.path: r.status for r in verify.verify_manifest(listed.withColumnRenamed("vault_path", "path"), files).collect()}
    assert manifest == {"a": "ok", "b": "ok", "c": "missing", "d": "corrupted", "e": "unlisted"}
    one = verify.counts(verify.verify_vault(listed, files)).head()
    assert (one.checked, one.ok, one.corrupted, one.missing, one.extra, one.passed) == (4, 1, 2, 1, 1, False)


def test_stats_and_upserts(spark):
    a = spark.createDataFrame([(100, "photo", datetime(2010, 1, 1), 1.0, "exif"), (200, "photo", datetime(2020, 5, 5), 2.0, "inferred"), (50, "video", None, None, None)], "filesize bigint, media_type string, taken_at timestamp_ntz, gps_latitude double, gps_source string")
    none = spark.createDataFrame([], schemas.LINKED_FILES)
    one = stats.index_stats({"assets": a, "linked_files": none, "review_queue": spark.createDataFrame([], schemas.REVIEW_QUEUE), "sources": spark.createDataFrame([], schemas.SOURCES), "asset_persons": spark.createDataFrame([(1, 1, "m"), (1, 2, "m")], schemas.ASSET_PERSONS)}).head()
    assert (one.total_bytes, one.photos, one.videos, one.undated, one.located_inferred, one.tagged_people, one.earliest) == (350, 2, 1, 1, 1, 1, datetime(2010, 1, 1))
    people = spark.createDataFrame([(3, "b")], "id bigint, name string")
    names = spark.createDataFrame([("c",), ("a",), ("b",), ("a",), (None,)], "name string")
    both, fresh = upsert.get_or_create(people, names, "name")
    assert sorted(map(tuple, both.collect())) == [(3, "b"), (4, "a"), (5, "c")] and fresh.count() == 2
    assert [r.id for r in upsert.numbered(spark.range(1000).select(F.col("id").alias("k")), ["k"], 7).orderBy("k").collect()] == list(range(7, 1007))
    reviews = spark.createDataFrame([(1, None, "p", "k", "{}", "open", None, None, None), (2, None, "q", "k", "{}", "open", None, None, None)], schemas.REVIEW_QUEUE)
    done = upsert.resolve_review(reviews, [2, 77], "kept", datetime(2024, 1, 1))
    assert [r.status for r in stats.listed(done).collect()] == ["open", "resolved"] and stats.listed(done, 1, status="open").count() == 1


def test_helper_columns_keep_clear_of_a_callers_own(spark):
    df = spark.createDataFrame([(1, 5, 7, "x"), (1, 4, 8, "y"), (None, 1, 9, "z"), (None, 1, 9, "z")], "k int, _nth int, _at int, _ID string")
    assert sorted(map(tuple, upsert.first_of_each(df, ["k"], ["_nth"]).collect()), key=str) == [(1, 4, 8, "y"), (None, 1, 9, "z")]
    assert upsert.numbered(df, ["_nth"], 3).columns == [*df.columns, "id"]
    a = spark.createDataFrame([(1, None, None, None, "own", 2.5)], "id bigint, gps_latitude double, gps_longitude double, gps_source string, _source string, _lat double")
    new = spark.createDataFrame([(1, 0.5, 0.25, "inferred")], "id bigint, latitude double, longitude double, source string")
    assert [tuple(r) for r in enrich.set_locations(a, new).collect()] == [(1, 0.5, 0.25, "inferred", "own", 2.5)]
    files = spark.createDataFrame([("/i/a.jpg", "a.jpg", "1" * 64, None, None, 5, None, "mine", "old")], "path string, rel_path string, sha256 string, width int, height int, filesize int, taken_at timestamp_ntz, _wish string, _old string")
    r = filed(files, spark.createDataFrame([], "vault_path string, sha256 string")).head()
    assert (r["_wish"], r["_old"], r.vault_path) == ("mine", "old", "undated/a.jpg")
    incoming = spark.createDataFrame([("p", "p", "s", 5, 1, 1, 1, "k", "r", "n", "f")], "path string, rel_path string, sha256 string, bits bigint, width int, height int, filesize bigint, rank string, n string, same_id string, f string")
    archive = spark.createDataFrame([(7, "s", 5, 1, 1, 1)], "id bigint, sha256 string, bits bigint, width int, height int, filesize bigint")
    for found in (dedupe.classify(incoming, archive), dedupe.greedy(incoming, archive)):
        r = found.head()
        assert (r["rank"], r["n"], r["same_id"], r["f"], r.verdict, r.master_id) == ("k", "r", "n", "f", "exact_duplicate", 7)
