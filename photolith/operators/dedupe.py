"""Which incoming files are new, and what the others are copies of.

Files are taken best first: most pixels, then most bytes, then by path. A file is new unless a file taken as new before it, or one in
the archive, has its checksum or a perceptual hash within the threshold. That is the first maximal independent set of the
conflict graph in this order: a file is new once all its better conflicts are known not to be new, and isn't as soon as one
of them is. The graph falls apart into components, most of them small, which are decided on inside tasks. Only the best file of each checksum and of each hash can be new, so only
those are in the graph, and masters are found for hashes, not for files: a large group of copies adds no edges and no pairs.

`bits` is a 64-bit hash or an array as `values.hash_words` makes it. Defined cases: a file without a hash is compared by its checksum alone;
rows of one checksum should have one picture, and the best of them stands for all; a null checksum is equal to no other, so such files
are never duplicates and, without a hash, always new; repeated paths are one file each to the rules and should not occur; an empty archive makes the best of each group
new; an empty batch gives no rows; further columns are passed on, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photolith.functions import values
from photolith.functions.keys import dealt_anew, merged
from photolith.operators.graph import components
from photolith.operators.similarity import near_hashes
from photolith.sources.scratch import discard, settle

#: The most edges of a component that one task decides on.
EDGES = 200_000

NEW, EXACT, TWIN, AMBIGUOUS, HIGHER = "new", "exact_duplicate", "low_res_twin", "ambiguous_match", "higher_res_arrived"


def order_key() -> Column:
    """Sorts the best copy first."""
    area = F.coalesce(F.col("width"), F.lit(0)).cast("bigint") * F.coalesce(F.col("height"), F.lit(0))
    return F.struct((-area).alias("area"), (-F.col("filesize")).alias("size"), F.col("rel_path").alias("path"))


def verdict_of(width, height, size, master_width, master_height, master_size) -> Column:
    """What a file near a master is."""
    known = (width != 0) & (height != 0) & (master_width != 0) & (master_height != 0)
    larger = F.coalesce(known & (width > master_width) & (height > master_height), F.lit(False))
    return F.when(values.strictly_smaller(width, height, size, master_width, master_height, master_size), TWIN).when(larger, HIGHER).otherwise(AMBIGUOUS)


def _rows_of_hashes(files: DataFrame, near: DataFrame) -> DataFrame:
    """`files` with what `near` (h, n) says of their hashes; both sides are dealt anew, so that AQE can split a hot hash."""
    key = lambda c: F.to_json(F.struct(F.col(c).alias("h")))
    hashes = near.select(key("h").alias("_hash_key"), "n")
    return files.withColumn("_bits_key", key("bits")).join(merged(hashes), F.col("_bits_key") == F.col("_hash_key"), "left").drop("_bits_key", "_hash_key")


def _nearest_archived(files: DataFrame, archive: DataFrame, threshold: int) -> DataFrame:
    """(h, n): of each hash of the files the nearest archived file n (id, width, height, filesize, distance), of equally near ones the smallest id."""
    kept = archive.filter("bits IS NOT NULL").groupBy(F.col("bits").alias("r")).agg(F.min_by(F.struct("id", "width", "height", "filesize"), "id").alias("m"))
    near = near_hashes(files, archive, threshold).join(kept, "r")
    best = F.min_by(F.struct("m.*", "distance"), F.struct("distance", "m.id"))
    return near.groupBy(F.col("l").alias("h")).agg(best.alias("n"))


def classify(incoming: DataFrame, archive: DataFrame, threshold: int = 8) -> DataFrame:
    """Verdict, master_id and distance of each incoming file (path, sha256, bits, width, height, filesize) against a fixed archive.

    Of the archive's files within the threshold only the nearest counts, of equally near ones that with the smallest id.
    """
    same = archive.groupBy("sha256").agg(F.min("id").alias("same_id"))
    files = incoming.select(F.struct("*").alias("f"), "sha256", "bits", "width", "height", "filesize").join(dealt_anew(same, "sha256"), "sha256", "left")
    joined = _rows_of_hashes(files, _nearest_archived(files.filter("same_id IS NULL"), archive, threshold))
    near = verdict_of(F.col("width"), F.col("height"), F.col("filesize"), F.col("n.width"), F.col("n.height"), F.col("n.filesize"))
    is_same = F.col("same_id").isNotNull()
    return joined.select(
        "f.*", F.when(is_same, EXACT).when(F.col("n").isNull(), NEW).otherwise(near).alias("verdict"),
        F.coalesce("same_id", "n.id").alias("master_id"), F.when(is_same, 0).otherwise(F.col("n.distance")).alias("distance"),
    )


def _first_set(batches):
    """The chosen nodes of groups (grp, better, worse), whose rows lie together: a node is decided once all better ones are."""

    def chosen(better: list, worse: list) -> list:
        after, open_, out = defaultdict(list), defaultdict(int), set()
        for x, y in zip(better, worse, strict=True):
            after[x].append(y)
            open_[y] += 1
        ready = [x for x in after if x not in open_]
        found = []
        while ready:
            node = ready.pop()
            free = node not in out
            if free:
                found.append(node)
            for y in after.get(node, ()):
                if free:
                    out.add(y)
                open_[y] -= 1
                if not open_[y]:
                    ready.append(y)
        return found

    group, better, worse = None, [], []
    for batch in batches:
        groups = batch.column(0)
        edges = [0, *(i for i in range(1, len(groups)) if groups[i] != groups[i - 1]), len(groups)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            own = groups[a].as_py()
            if own != group and better:
                yield pa.RecordBatch.from_arrays([pa.array(chosen(better, worse), type=pa.string())], names=["node"])
                better, worse = [], []
            group = own
            better += batch.column(1)[a:b].to_pylist()
            worse += batch.column(2)[a:b].to_pylist()
    if better:
        yield pa.RecordBatch.from_arrays([pa.array(chosen(better, worse), type=pa.string())], names=["node"])


def independent(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes (node) of the first maximal independent set, given edges (better, worse) between texts; a written table.

    Components of the graph are decided apart from each other: those of up to EDGES edges in order inside a task, one after the other as they
    stream through it, so the length of their chains doesn't matter; only larger ones by rounds. A graph of up to EDGES edges
    needs no components. The result is the same any way.
    """
    edges = settle(edges.select("better", "worse").distinct(), "conflicts")
    free = nodes.select("node").join(edges.select(F.col("better").alias("node")).unionByName(edges.select(F.col("worse").alias("node"))).distinct(), "node", "left_anti")
    large = None
    if edges.count() <= EDGES:
        small = edges.select(F.lit("").alias("grp"), "better", "worse")
    else:
        roots, _ = components(edges.select(F.col("better").alias("a"), F.col("worse").alias("b")))
        placed = settle(edges.join(roots.select(F.col("node").alias("better"), F.col("root").alias("grp")), "better").select("grp", "better", "worse"), "conflicts")
        sizes = placed.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > EDGES).select("grp")
        small = placed.join(sizes, "grp", "left_anti")
        large = settle(placed.join(dealt_anew(sizes, "grp"), "grp", "left_semi").select("better", "worse"), "conflicts")
    inside = small.select("grp", "better", "worse").repartition("grp").sortWithinPartitions("grp").mapInArrow(_first_set, "node string")
    chosen = free.unionByName(inside)
    if large is not None and not large.isEmpty():
        both = large.select(F.col("better").alias("node")).unionByName(large.select(F.col("worse").alias("node"))).distinct()
        chosen = chosen.unionByName(_by_rounds(both, large))
    return settle(chosen, "independent")


def _by_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """As `independent`, by as many rounds as the longest chain of decisions needs; each is written and the one before it deleted."""
    undecided = settle(nodes.select("node"), "undecided")
    edges = settle(edges.select("better", "worse"), "conflicts")
    rounds: list[DataFrame] = []
    while True:
        now = settle(undecided.join(edges.select(F.col("worse").alias("node")).distinct(), "node", "left_anti"), "chosen")
        rounds.append(now)
        if now.isEmpty():
            break
        out = edges.join(now.select(F.col("node").alias("better")), "better", "left_semi").select(F.col("worse").alias("node")).distinct()
        gone = settle(now.select("node").unionByName(out).distinct(), "decided")
        left = settle(undecided.join(gone, "node", "left_anti"), "undecided")
        kept = settle(edges.join(gone.select(F.col("node").alias("better")), "better", "left_anti").join(gone.select(F.col("node").alias("worse")), "worse", "left_anti"), "conflicts")
        discard(gone, undecided, edges)
        undecided, edges = left, kept
    chosen = settle(undecided.sparkSession.read.schema(now.schema).parquet(*[r.stored_at for r in rounds]), "independent")
    discard(undecided, edges, *rounds)
    return chosen


def greedy(incoming: DataFrame, archive: DataFrame, threshold: int = 8) -> DataFrame:
    """Verdicts of a batch in which imports count against the files after them.

    incoming: path, rel_path, sha256, bits, width, height, filesize. Adds verdict, master_id (archive), master_path (this batch)
    and distance. The nearest master counts; of equally near ones the archive's first, then the better one. At a
    threshold of 64 and more all hashes of equal length match.
    """
    files = incoming.select(F.struct("*").alias("f"), "path", "sha256", "bits", "width", "height", "filesize", order_key().alias("rank"))
    best = F.min_by(F.struct("path", "bits", "rank"), "rank").alias("b")
    fresh = files.join(merged(dealt_anew(archive.select("sha256").distinct(), "sha256")), "sha256", "left_anti")
    firsts = fresh.filter("sha256 IS NOT NULL").groupBy("sha256").agg(best).select("b.*").unionByName(fresh.filter("sha256 IS NULL").select("path", "bits", "rank"))
    plain = firsts.filter("bits IS NULL")
    hashed = settle(firsts.filter("bits IS NOT NULL").groupBy("bits").agg(F.min_by(F.struct("path", "rank"), "rank").alias("b")).select("bits", "b.*"), "hashed")

    taken = near_hashes(hashed, archive, threshold).select(F.col("l").alias("bits")).distinct()
    open_ = settle(hashed.join(merged(taken), "bits", "left_anti"), "open")
    named = lambda side: open_.select(F.col("bits").alias(side), F.col("path").alias(f"{side}_path"), F.col("rank").alias(f"{side}_rank"))
    near = near_hashes(open_, open_, threshold).join(named("l"), "l").join(named("r"), "r").filter("l_rank < r_rank")
    new = independent(open_.select(F.col("path").alias("node")), near.select(F.col("l_path").alias("better"), F.col("r_path").alias("worse")))
    new = settle(files.join(merged(new.select(F.col("node").alias("path")).unionByName(plain.select("path"))), "path", "left_semi"), "new-files")

    # Masters by checksum: the archive's, else this batch's.
    own = new.filter("sha256 IS NOT NULL").groupBy("sha256").agg(F.min_by("path", "rank").alias("same_path"))
    same = archive.groupBy("sha256").agg(F.min("id").alias("same_id")).join(merged(own), "sha256", "full_outer")
    rest = files.join(merged(new.select("path")), "path", "left_anti").join(merged(dealt_anew(same, "sha256")), "sha256", "left")
    is_same = F.col("same_id").isNotNull() | F.col("same_path").isNotNull()
    asked = rest.filter(~is_same)

    # Masters by hash: the archive's nearest, and those of this batch that come before the file; the latter lie further apart than the threshold, so they are few.
    rest = _rows_of_hashes(rest, _nearest_archived(asked, archive, threshold)).withColumnRenamed("n", "archived")
    leads = new.filter("bits IS NOT NULL").select(F.col("bits").alias("r"), F.struct("path", "rank", "width", "height", "filesize").alias("m"))
    batch = near_hashes(asked, new, threshold).join(leads, "r").groupBy(F.col("l").alias("h")).agg(F.collect_list(F.struct("distance", "m")).alias("n"))
    rest = _rows_of_hashes(rest, batch)
    earlier = F.filter("n", lambda x: x["m"]["rank"] < F.col("rank"))
    first = F.array_min(F.transform(earlier, lambda x: F.struct(x["distance"].alias("distance"), x["m"]["rank"].alias("rank"), x["m"].alias("m"))))
    rest = rest.withColumn("batch", first)
    here = F.col("archived").isNull() | (F.col("batch.distance") < F.col("archived.distance"))
    pick = lambda c: F.when(F.coalesce(here, F.lit(False)) & F.col("batch").isNotNull(), F.col(f"batch.m.{c}")).otherwise(F.col(f"archived.{c}"))
    other = verdict_of(F.col("width"), F.col("height"), F.col("filesize"), pick("width"), pick("height"), pick("filesize"))
    used_batch = F.coalesce(here, F.lit(False)) & F.col("batch").isNotNull()
    judged = rest.select(
        "f.*", F.when(is_same, EXACT).otherwise(other).alias("verdict"), F.when(is_same, F.col("same_id")).when(~used_batch, F.col("archived.id")).alias("master_id"),
        F.when(is_same & F.col("same_id").isNotNull(), F.lit(None)).when(is_same, F.col("same_path")).when(used_batch, F.col("batch.m.path")).alias("master_path"),
        F.when(is_same, 0).when(used_batch, F.col("batch.distance")).otherwise(F.col("archived.distance")).cast("int").alias("distance"),
    )
    none = {"master_id": archive.schema["id"].dataType, "master_path": "string", "distance": "int"}
    return judged.unionByName(new.select("f.*", F.lit(NEW).alias("verdict"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()]))
