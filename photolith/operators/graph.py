"""Connected components by contraction.

Each round every node takes the label of the first node, in an order by a hash that changes from round to round, among itself and its
neighbours; edges are then drawn between labels. What was connected stays connected, and about half of the nodes of any graph are left
after a round, of dense ones far fewer, so a chain of n takes about log2(n) rounds on tables that shrink by half. The labels are put
together from the last, smallest round to the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolith.sources.scratch import discard, settle


def _labelled(edges: DataFrame, nth: int) -> DataFrame:
    """(node, label) of the nodes of the edges (a, b)."""
    key = lambda c: F.struct(F.xxhash64(F.lit(nth), c).alias("h"), F.col(c).alias("n"))
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = both.groupBy("a").agg(F.min(key("b")).alias("near"))
    return first.select(F.col("a").alias("node"), F.least("near", key("a"))["n"].alias("label"))


def components(edges: DataFrame) -> tuple[DataFrame, int]:
    """(node, root) of the nodes of the edges (a, b), a written table, and the number of rounds it took. Loops join nothing."""
    now = settle(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    labels: list[DataFrame] = []
    while not now.isEmpty():
        own = settle(_labelled(now, len(labels)), "labels")
        labels.append(own)
        x, y = own.select(F.col("node").alias("a"), F.col("label").alias("x")), own.select(F.col("node").alias("b"), F.col("label").alias("y"))
        drawn = now.join(x, "a").join(y, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        last, now = now, settle(drawn, "edges")
        discard(last)
    discard(now)
    if not labels:
        return settle(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0), "components"), 0
    found = settle(labels[-1].withColumnRenamed("label", "root"), "components")
    for own in labels[-2::-1]:
        above = found.select(F.col("node").alias("label"), "root")
        last, found = found, settle(own.join(above, "label", "left").select("node", F.coalesce("root", "label").alias("root")), "components")
        discard(last)
    discard(*labels)
    return found, len(labels)
