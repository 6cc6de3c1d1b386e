import random

import pytest

from photolith.operators import digest_tree as D
from photolith.operators import verify


def listing(spark, rows):
    return spark.createDataFrame(rows, "path string, sha256 string")


def statuses(df):
    return sorted((r.path or "", r.status) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_statuses_equal_those_of_a_full_comparison(spark, seed):
    rng = random.Random(seed)
    folders = ["", "a", "a/b", "a/b/c", "d", "d/e f", "a-b", "x/y/z"]
    rows = {f"{rng.choice(folders)}/{k}.jpg".lstrip("/"): f"s{k}" for k in range(200)}
    other = dict(rows)
    for path in rng.sample(sorted(rows), 6):
        kind = rng.randrange(3)
        if kind == 0:
            other[path] = "changed"
        else:
            del other[path]
            if kind == 2:
                other[path + ".new/x.jpg"] = "n"
    listed, there = listing(spark, sorted(rows.items())), listing(spark, sorted(other.items()))
    full = verify.verify_manifest(listed, there)
    part = D.verify_changes(listed, there)
    assert [s for s in statuses(part) if s[1] != "ok"] == [s for s in statuses(full) if s[1] != "ok"]
    assert D.counts(D.tree(listed), part).head().asDict() == verify.counts(full).head().asDict()


def test_only_changed_folders_are_read(spark):
    rows = [(f"{y}/{m:02}/{k}.jpg", f"{y}{m}{k}") for y in (2014, 2015) for m in range(1, 13) for k in range(5)]
    other = [(p, "changed" if p == "2015/07/3.jpg" else s) for p, s in rows]
    listed, there = listing(spark, rows), listing(spark, other)
    before, after = D.tree(listed).cache(), D.tree(there).cache()
    assert [r.folder for r in D.changed_folders(before, after).collect()] == ["2015/07"]
    found = D.verify_changes(listed, there, before, after)
    assert {p.rsplit("/", 1)[0] for p, _ in statuses(found)} == {"2015/07"} and found.count() == 5
    assert D.counts(before, found).head().asDict() == {"checked": 120, "ok": 119, "corrupted": 1, "missing": 0, "extra": 0, "passed": False}
    same = D.verify_changes(listed, there.limit(0).unionByName(listed))
    assert same.count() == 0 and D.counts(before, same).head().passed


def test_trees_do_not_depend_on_order_and_know_their_files(spark):
    rows = [("a/b/1.jpg", "x"), ("a/2.jpg", "y"), ("3.jpg", None), ("a/b/1.jpg", "x"), (None, "z")]
    one = {r.folder: r for r in D.tree(listing(spark, rows)).collect()}
    two = {r.folder: r for r in D.tree(listing(spark, rows[::-1]).repartition(3)).collect()}
    assert one == two and {k: (r.above, r.depth, r.n_own, r.n_all) for k, r in one.items()} == {"": (None, 0, 1, 4), "a": ("", 1, 1, 3), "a/b": ("a", 2, 2, 2)}
    moved = {r.folder: r.whole for r in D.tree(listing(spark, [("a/b/1.jpg", "y"), ("a/2.jpg", "x")])).collect()}
    assert moved["a"] != {r.folder: r.whole for r in D.tree(listing(spark, [("a/b/1.jpg", "x"), ("a/2.jpg", "y")])).collect()}["a"]


def test_empty_listings(spark):
    none, some = listing(spark, []), listing(spark, [("a/1.jpg", "x"), ("2.jpg", "y")])
    assert D.verify_changes(none, none).count() == 0
    assert statuses(D.verify_changes(some, none)) == [("2.jpg", "missing"), ("a/1.jpg", "missing")]
    assert statuses(D.verify_changes(none, some)) == [("2.jpg", "unlisted"), ("a/1.jpg", "unlisted")]
    assert D.counts(D.tree(none), D.verify_changes(none, some)).head().asDict() == {"checked": 0, "ok": 0, "corrupted": 0, "missing": 0, "extra": 2, "passed": False}
