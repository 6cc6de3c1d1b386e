"""A tree of digests over folders: what is kept with a listing so that the next comparison looks only where something changed.

A folder has two digests, of the files in it and of all files below it. A digest is the sum of two 64-bit hashes of every file's path
and checksum, so it needs no order and no level by level building: each file adds to its folders, partial sums travel, and digests of parts of a
listing can be added. Two trees are compared from the root down: a folder is only looked at if the one above it differs, and files only if
those of their own folder do. Equal subtrees are neither joined nor listed. Digests tell apart what differs by accident; against somebody
who looks for collisions there are the checksums themselves.

Defined cases: files in no folder are in the root, whose name is empty; a null path belongs to no folder; a null checksum is one of its own;
repeated rows count as often as they're there; trees without files are equal; a folder that only one tree has differs in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photolith.operators.verify import verify_manifest
from photolith.sources.scratch import settle

TREE = "folder string, above string, depth int, n_own bigint, n_all bigint, own string, whole string"


def folder_of(path: Column) -> Column:
    """The folder of a relative path; of a file without one the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def tree(files: DataFrame) -> DataFrame:
    """(folder, above, depth, n_own, n_all, own, whole) of all folders of files (path, sha256): how many files each has and their digests."""
    rows = files.filter(F.col("path").isNotNull()).select(folder_of(F.col("path")).alias("at"), F.xxhash64("path", "sha256").alias("x"), F.xxhash64(F.lit(1), "sha256", "path").alias("y"))
    # Files of a folder are added up before they go to the folders above it.
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    each = rows.groupBy("at").agg(F.count(F.lit(1)).alias("n"), wide("x"), wide("y"))
    names = F.split("at", "/")
    ups = F.transform(F.sequence(F.lit(0), F.when(F.col("at") == "", 0).otherwise(F.size(names))), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(names, 1, k), "/").alias("folder")))
    spread = each.withColumn("up", F.explode(ups))
    mine = F.col("up.folder") == F.col("at")
    total = lambda c, where: F.coalesce(F.sum(F.when(where, F.col(c))), F.lit(0))
    sums = spread.groupBy(F.col("up.folder").alias("folder"), F.col("up.depth").alias("depth")).agg(
        *[total(c, where).alias(f"{c}_{kind}") for kind, where in (("own", mine), ("all", F.lit(True))) for c in ("n", "x", "y")]
    )
    digest = lambda kind: F.concat_ws(":", f"n_{kind}", f"x_{kind}", f"y_{kind}")
    above = F.when(F.col("depth") > 0, folder_of(F.col("folder")))
    return sums.select("folder", above.alias("above"), F.col("depth").cast("int").alias("depth"), F.col("n_own").cast("bigint").alias("n_own"), F.col("n_all").cast("bigint").alias("n_all"), digest("own").alias("own"), digest("all").alias("whole"))


def changed_folders(before: DataFrame, after: DataFrame) -> DataFrame:
    """(folder) of the folders whose own files differ between two trees; a written table. One step a level, as far down as anything differs."""
    found, level, depth = None, None, 0
    while True:
        sides = []
        for name, side in (("b", before), ("a", after)):
            rows = side.filter(F.col("depth") == depth)
            rows = rows if level is None else rows.join(level.select(F.col("folder").alias("above")), "above", "left_semi")
            sides.append(rows.select("folder", F.col("own").alias(f"own_{name}"), F.col("whole").alias(f"whole_{name}")))
        both = sides[0].join(sides[1], "folder", "full_outer").filter("NOT whole_b <=> whole_a")
        level = settle(both.select("folder", (~F.col("own_b").eqNullSafe(F.col("own_a"))).alias("here")), "changed")
        if level.isEmpty():
            return level.select("folder") if found is None else settle(found, "changed-folders")
        here = level.filter("here").select("folder")
        found = here if found is None else found.unionByName(here)
        depth += 1


def verify_changes(listed: DataFrame, there: DataFrame, before: DataFrame | None = None, after: DataFrame | None = None) -> DataFrame:
    """(path, status) as `verify.verify_manifest` gives, of the files in folders that differ; all others are ok, as `changed_folders` has found.

    before, after: the trees of the two listings, where they are kept.
    """
    before = settle(tree(listed), "tree") if before is None else before
    after = settle(tree(there), "tree") if after is None else after
    changed = changed_folders(before, after)
    near = lambda rows: rows.select("path", "sha256", folder_of(F.col("path")).alias("folder")).join(changed, "folder", "left_semi").select("path", "sha256")
    return verify_manifest(near(listed), near(there))


def counts(listed_tree: DataFrame, statuses: DataFrame) -> DataFrame:
    """checked, ok, corrupted, missing, extra and passed, of all files: what `verify_changes` left out is ok, and its number is the tree's."""
    of = lambda *names: F.count_if(F.col("status").isin(*names))
    seen = statuses.agg(of("corrupted").alias("corrupted"), of("missing").alias("missing"), of("unlisted", "untracked").alias("extra"))
    checked = listed_tree.agg(F.coalesce(F.max(F.when(F.col("depth") == 0, F.col("n_all"))), F.lit(0)).alias("checked"))
    one = checked.join(F.broadcast(seen))  # one row each
    one = one.select("checked", (F.col("checked") - F.col("corrupted") - F.col("missing")).alias("ok"), "corrupted", "missing", "extra")
    return one.withColumn("passed", (F.col("corrupted") + F.col("missing") + F.col("extra")) == 0)
