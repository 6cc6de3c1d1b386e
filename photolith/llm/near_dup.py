"""Near-duplicate classes by improved consistent weighted sampling.

Texts are lower-cased (A-Z) and cut into words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`; a text is the weighted set of its 5-word
shingles (all its words, if fewer) with weights (1 + ln tf) * idf. idf = 1 + IDF_SHARE * ln(min((1+N)/(1+df), CLIP)) / ln(CLIP): gentle, so that
the members of a huge group of copies, whose shingles are all common, keep the similarity they have by themselves, and clipped, so
that what is in fewer than one of CLIP texts has full weight at every size of the corpus. df is exact: texts are counted in a table of hash cells
first, which bounds every shingle's df from above, and then exactly for the shingles of the cells that reach N / CLIP. At most CLIP times the
mean number of shingles of a text can reach it, so what is broadcast doesn't grow with the number of texts; where texts are so long
that it would be more than `MOST_COMMON`, CLIP is lowered to what is.

1. Texts with equal words are one node (a 64-bit hash of them); everything below is about nodes.
2. Each node has consistent weighted samples in bands; how many of either follows from the threshold (`Sampling`). Texts of a weight of
   FULL or less, and those with so few shingles that they may be links of such, have every sample look at every
   shingle; texts of a weight above FULL deal their shingles out to the samples, one each, with empty ones filled from others. Texts
   of similarity t differ in weight by a factor of 1/t at most, and no shingle weighs less than 1: if the lighter one weighs at most
   FULL, both have at most FULL / t shingles, and else both are above FULL, so they always share a kind.
3. Of each bucket of a band the smallest node is the pivot; the others are verified against it by weighted Jaccard
   similarity, texts meeting in groups of bounded size that stream through a task.
4. Connected components of the links are found by alternating large-star and small-star steps.
5. The other pairs of a bucket matter only where their nodes are in different components. For the nodes of such buckets it's
   counted how much of their weight is in shingles that no other of them has: that part can't be shared, which bounds the similarity
   of any pair from above, and so do the two distances to the pivot, distance being a metric. The node with the least such
   part is each bucket's next pivot; after its links are in the components, all pairs that are still apart and
   that the bounds allow are verified, so no pair that shares a bucket is lost.

A pair at the threshold shares no bucket with a probability of about 0.00007 whatever the threshold is; at 0.8, one of 0.85 with less
than 0.000001. Thresholds below LEAST are refused.

Defined cases: null and empty texts, and texts without words, are classes of their own; repeated rows are copies of each
other; a null id never names a class that has another; ties can't matter, classes being components; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photolith.llm._bytes import ALNUM, LOWER, Shared, Words, bound_batches, columns, fresh, map_texts, mix, slices, windows
from photolith.llm._store import drop, stored, stored_compact

SHINGLE = 5
THRESHOLD = 0.8
IDF_SHARE = 0.25
CLIP = 256
MOST_COMMON = 1 << 21
CELL_BITS = 19
CELL_COLUMNS = 64
COUNTED = 1 << 20
LEAST = 0.3
ROWS, SAMPLES = 5, 120
MISSED = 7.5e-5
FULL = 256
GROUP = 256
BLOCK = 1024
BROADCAST_IDS = 500_000

_rng = np.random.Generator(np.random.PCG64(5))
_ODD = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPREAD = np.uint64(0xC2B2AE3D27D4EB4F)
# Gamma(2, 1) variates at evenly spaced quantiles, dealt at random.
_GAMMA = np.sort(_rng.gamma(2.0, 1.0, 1 << 16)).astype(np.float32)[_rng.permutation(1 << 16)]
_LOG_GAMMA = np.log(_GAMMA[_rng.permutation(1 << 16)])
_ODD = np.concatenate([_ODD, _rng.integers(0, 2**63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)])


class Sampling:
    """How texts are sampled for a threshold: `rows` samples make a band, of which a pair at the threshold shares none with a probability of MISSED."""

    def __init__(self, threshold: float = THRESHOLD):
        if not LEAST <= threshold <= 1:
            raise ValueError(f"a threshold of {threshold}; it must be from {LEAST} to 1")
        self.rows = ROWS if threshold >= THRESHOLD else max(1, round(ROWS * math.log(THRESHOLD) / math.log(threshold)))
        self.bands = math.ceil(math.log(MISSED) / math.log(max(1 - threshold**self.rows, MISSED)))
        self.samples = self.rows * self.bands
        self.overlap = math.floor(FULL / threshold) + 16  # 16 to spare for rounding


def shingles(words: Words, i: int, keys: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of the i-th text, sorted, and how often each occurs."""
    own = keys[cut[i] : cut[i + 1]]
    if not len(own):
        own = words.hash[words.bounds[i] : words.bounds[i + 1]]
        if len(own):
            own = np.array([text_key(own)], dtype=np.uint64)
    if len(own) < 2:
        return own, np.ones(len(own), dtype=np.int64)
    own = np.sort(own)
    edge = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    return own[edge], np.diff(np.append(edge, len(own)))


def text_key(hashes: np.ndarray) -> np.uint64:
    """A hash of a sequence of words."""
    n = len(hashes)
    at = mix(np.arange(n, dtype=np.uint64) + np.uint64(n))
    return mix(np.array([np.sum(mix(hashes ^ at), dtype=np.uint64)], dtype=np.uint64))[0]


class Shingled:
    """The shingles of the texts of a column."""

    def __init__(self, column: pa.Array):
        self.words = Words(column, ALNUM, LOWER)
        first, self.keys = windows(self.words.hash, self.words.bounds, SHINGLE)
        self.cut = np.searchsorted(first, self.words.bounds)

    def __len__(self) -> int:
        return len(self.words.bounds) - 1

    def node(self, i: int) -> int | None:
        own = self.words.hash[self.words.bounds[i] : self.words.bounds[i + 1]]
        return int(text_key(own).view(np.int64)) if len(own) else None

    def set(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return shingles(self.words, i, self.keys, self.cut)

    def weighted(self, i: int, idf: Idf) -> tuple[np.ndarray, np.ndarray]:
        keys, times = self.set(i)
        weight = idf.of(keys)
        return keys, np.where(times > 1, weight * (1 + np.log(times)), weight)


class Idf:
    """The idf weights of the shingles that are common enough to have less than the full one."""

    def __init__(self, keys: np.ndarray, df: np.ndarray, n: int, clip: float):
        order = np.argsort(keys)
        self.keys, self.full = keys[order], 1 + IDF_SHARE * (1.0 if n else 0.0)
        self.weight = 1 + IDF_SHARE * np.log(np.minimum((1 + n) / (1 + df[order]), clip)) / math.log(clip)

    def of(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), self.full)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            found = self.keys[at] == keys
            out[found] = self.weight[at[found]]
        return out


def _cells(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def cell_counts(rows: DataFrame) -> tuple[np.ndarray, int, int]:
    """How many texts have a shingle of each cell, how many texts there are, and how many shingles they have."""
    names = [f"c{k}" for k in range(CELL_COLUMNS)]
    size = 1 << CELL_BITS

    def run(batches):
        counts, n, total = np.zeros(size, dtype=np.int64), 0, 0
        for batch in batches:
            for part in slices(batch, "text"):
                texts = Shingled(part.column(0))
                n += len(texts)
                for i in range(len(texts)):
                    keys = texts.set(i)[0]
                    total += len(keys)
                    counts[np.unique(_cells(keys))] += 1
        if n:
            table = np.zeros((size // CELL_COLUMNS + 1, CELL_COLUMNS), dtype=np.int64)
            table[:-1], table[-1, :2] = counts.reshape(-1, CELL_COLUMNS), (n, total)
            used = np.flatnonzero(table.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(table[used, k]) for k in range(CELL_COLUMNS))], names=["row", *names])

    parts = rows.select("text").mapInArrow(run, "row int, " + ", ".join(f"{c} long" for c in names))
    found = parts.groupBy("row").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    table = np.zeros((size // CELL_COLUMNS + 1, CELL_COLUMNS), dtype=np.int64)
    if found.num_rows:
        table[found.column("row").to_numpy()] = np.stack([found.column(c).to_numpy() for c in names], axis=1)
    return table[:-1].reshape(-1), int(table[-1, 0]), int(table[-1, 1])


def document_frequencies(rows: DataFrame, wanted) -> DataFrame:
    """(s, n): the exact number of texts that have each shingle of the wanted cells; counts of a task are merged before they leave it."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(at, weights=np.concatenate([c for _, c in held])).astype(np.int64)

        def out(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["s", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                texts = Shingled(part.column(0))
                found = [k[wanted.value[_cells(k)]] for k in (texts.set(i)[0] for i in range(len(texts)))]
                held.append(np.unique(np.concatenate(found), return_counts=True))
                size += len(held[-1][0])
                if size > COUNTED:
                    held[:] = [merged()]
                    size = len(held[0][0])
                    if size > COUNTED // 2:
                        yield out(*held.pop())
                        size = 0
        if held:
            yield out(*merged())

    return rows.select("text").mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))


def idf_of(rows: DataFrame) -> Idf:
    """The weights of all shingles of the texts."""
    counts, n, total = cell_counts(rows)
    if not n:
        return Idf(np.zeros(0, dtype=np.uint64), np.zeros(0), 0, CLIP)
    clip = max(2.0, min(CLIP, MOST_COMMON * n / max(total, 1)))
    least = (1 + n) / clip - 1  # a shingle of more texts has less than the full weight
    wanted = rows.sparkSession.sparkContext.broadcast(counts > least)
    common = document_frequencies(rows, wanted).filter(F.col("n") > least).toArrow()
    return Idf(common.column("s").to_numpy().view(np.uint64), common.column("n").to_numpy(), n, clip)


def _draws(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and beta of improved consistent weighted sampling from hashed bits."""
    x ^= x >> np.uint64(29)
    x *= _SPREAD
    return _GAMMA[(x >> np.uint64(48)).astype(np.int64)], _LOG_GAMMA[((x >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int64)], ((x >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(2.0**-16)


def _cost(r, log_c, beta, log_w):
    level = np.floor(log_w / r + beta)
    return log_c - r * (level - beta) - r, level


def full_samples(keys: np.ndarray, log_w: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """Every sample over all shingles."""
    cost, level = _cost(*_draws(keys[None, :] * _ODD[:samples, None]), log_w[None, :])
    best = cost.argmin(axis=1)
    return mix(keys[best] ^ (level[np.arange(samples), best].astype(np.int64).view(np.uint64) * _SPREAD))


def dealt_samples(keys: np.ndarray, log_w: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """Each shingle in one sample; empty samples are filled from others by a fixed sequence."""
    bin_of = ((mix(keys ^ _SPREAD) >> np.uint64(32)) % np.uint64(samples)).astype(np.int64)
    cost, level = _cost(*_draws(keys * _ODD[bin_of]), log_w)
    order = np.lexsort((cost, bin_of))
    filled, first = np.unique(bin_of[order], return_index=True)
    best = order[first]
    out, has = np.zeros(samples, dtype=np.uint64), np.zeros(samples, dtype=bool)
    out[filled] = mix(keys[best] ^ (level[best].astype(np.int64).view(np.uint64) * _SPREAD))
    has[filled] = True
    for j in np.flatnonzero(~has):
        x, attempt = int(_ODD[j]), 0
        while True:
            attempt += 1
            at = int(mix(np.array([x ^ attempt], dtype=np.uint64))[0] % np.uint64(samples))
            if has[at]:
                out[j] = mix(np.array([int(out[at]) ^ x], dtype=np.uint64))[0]
                break
    return out


def bands(keys: np.ndarray, weights: np.ndarray, plan: Sampling | None = None) -> np.ndarray:
    plan = plan or Sampling()
    log_w = np.log(weights).astype(np.float32)
    found = []
    if len(keys) <= plan.overlap:
        found.append((full_samples(keys, log_w, plan.samples), 1))
    if float(weights.sum()) > FULL:
        found.append((dealt_samples(keys, log_w, plan.samples), 1001))
    out = []
    for samples, first in found:
        h = np.arange(first, first + plan.bands, dtype=np.uint64) * _SPREAD
        for row in samples.reshape(plan.bands, plan.rows).T:
            h = mix(h ^ row)
        out.append(h)
    return np.concatenate(out)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets with sorted keys."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    both = b[0][at] == a[0]
    shared = float(np.minimum(a[1][both], b[1][at[both]]).sum())
    total = float(a[1].sum() + b[1].sum()) - shared
    return shared / total if total else 0.0


def signatures(rows: DataFrame, shared, plan: Sampling) -> DataFrame:
    """(doc_id, node, weight, bands) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = Shingled(batch.column(1))
        node, weight, keys = [], [], []
        for i in range(len(texts)):
            own, w = texts.weighted(i, shared.value)
            node.append(texts.node(i))
            weight.append(float(w.sum()))
            keys.append(bands(own, w, plan).view(np.int64) if len(own) else np.zeros(0, dtype=np.int64))
        offsets = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
        flat = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, type=pa.int64()), pa.array(weight), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "node", "weight", "bands"])

    return map_texts(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, node long, weight double, bands array<long>")


def candidate_texts(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, text) of nodes (node, name), where name is the id of a row with the node's text."""
    ids = nodes.select("node", F.col("name").alias("doc_id"))
    if nodes.count() <= BROADCAST_IDS:  # 16 bytes each
        ids = F.broadcast(ids)

    def checked(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Only texts that are their node's; an id may have other texts too."""
        found = Shingled(batch.column(1))
        return batch.filter(pa.array([n == found.node(i) for i, n in enumerate(batch.column(0).to_pylist())], type=pa.bool_()))

    found = ids.join(rows, ids.doc_id.eqNullSafe(rows.doc_id)).select("node", "text")
    return map_texts(found, checked, "node long, text string").dropDuplicates(["node"])


def verified(pairs: DataFrame, texts: DataFrame, shared) -> DataFrame:
    """(a, b, sim) of pairs of nodes; a's pairs are dealt to groups of bounded size, each led by a's text."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("groups"))
    dealt = loose(pairs, "a").join(sizes.withColumnRenamed("a", "_a"), F.col("a") == F.col("_a")).withColumn("part", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int")).select("a", "b", "part")
    leads = sizes.select("a", F.explode(F.sequence(F.lit(0), (F.col("groups") - 1).cast("int"))).alias("part"))
    first = leads.join(texts, leads.a == texts.node).select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    rest = dealt.join(texts, dealt.b == texts.node).select("a", "part", "b", "text")

    def run(batches):
        lead, own = None, None
        for batch in batches:
            for part in slices(batch, "text"):
                found, out = Shingled(part.column(3)), []
                for i, (a, b) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    if b is None:
                        lead, own = a, found.weighted(i, shared.value)
                    elif a == lead:
                        out.append((a, b, similarity(own, found.weighted(i, shared.value))))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["a", "b", "sim"])

    # The lead of a group comes first: nulls sort before other values.
    return first.unionByName(rest).repartition("a", "part").sortWithinPartitions("a", "part", "b").mapInArrow(run, "a long, b long, sim double")


def own_weights(texts: DataFrame, shared) -> DataFrame:
    """(node, own): the weight of the shingles that no other of the texts has."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                found = Shingled(part.column(1))
                sets = [found.weighted(i, shared.value) for i in range(len(found))]
                node = np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(k) for k, _ in sets])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([k for k, _ in sets]).view(np.int64)), pa.array(node), pa.array(np.concatenate([w for _, w in sets]))], names=["s", "node", "w"])

    each = texts.mapInArrow(run, "s long, node long, w double")
    return each.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"), F.min("w").alias("w")).filter("n = 1").groupBy("node").agg(F.sum("w").alias("own"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); the root is its component's smallest node.

    Each round ends in a written table, which cuts the lineage.
    """

    def settled(e: DataFrame) -> tuple[DataFrame, tuple]:
        out = stored_compact(e, "component-edges")
        return out, tuple(out.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).head())

    now, before = settled(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(loose(least, "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = loose(large, "u").join(loose(least, "u"), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last = now
        now, after = settled(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        drop(last)
        if after == before:
            break
        before = after
    star = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return star.unionByName(star.select(F.col("root").alias("node"), "root").distinct())


def loose(df: DataFrame, key: str) -> DataFrame:
    """`df` with its partitioning by an integer key forgotten, so that both sides of a join are dealt anew and AQE can split a hot key."""
    return df.withColumn(key, F.col(key) + F.lit(0).cast("long"))


def classes(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, class_size) for each row; the class is named by its smallest id, its size counts rows."""
    signed, named = _solved(df, threshold, id_col, text_col)
    joined = signed.join(named, "node", "left")
    return joined.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def _solved(df: DataFrame, threshold: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of each row, and (node, root, class_id, class_size) of the nodes of classes of two rows and more."""
    spark, plan = df.sparkSession, Sampling(threshold)
    bound_batches(df)
    rows = columns(df, doc_id=id_col, text=text_col)
    made: list[DataFrame] = []

    def kept(x: DataFrame) -> DataFrame:
        made.append(stored_compact(x, "near-dup"))
        return made[-1]

    shared = Shared(spark, idf_of(rows))
    signed = stored(signatures(rows, shared, plan), "signatures")
    worded = signed.filter("node IS NOT NULL")
    nodes = worded.groupBy("node").agg(F.min("doc_id").alias("name"), F.count(F.lit(1)).alias("copies"), F.first("weight").alias("weight"), F.first("bands").alias("bands"))
    placed = nodes.select(F.explode("bands").alias("bucket"), "node")
    slim = kept(worded.groupBy("node").agg(F.min("doc_id").alias("name"), F.count(F.lit(1)).alias("copies"), F.first("weight").alias("weight")))

    pivots = placed.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").drop("z")
    members = kept(placed.join(loose(pivots, "bucket"), "bucket").filter("node <> a").select("bucket", "a", F.col("node").alias("b")))
    pairs = kept(members.select("a", "b").distinct())
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    texts = kept(candidate_texts(kept(wanted.join(slim.select("node", "name"), "node")), rows))
    tested = kept(verified(pairs, texts, shared))
    links = tested.filter(F.col("sim") >= threshold).select("a", "b")
    found = components(links)

    apart = kept(_open_members(members, tested, found))
    if not apart.isEmpty():
        own = own_weights(texts.join(apart.select(F.col("b").alias("node")).distinct(), "node", "left_semi"), shared)
        weights = kept(slim.select("node", "weight").join(own, "node", "left").select(F.col("node").alias("b"), "weight", (F.col("weight") - F.coalesce("own", F.lit(0.0))).alias("common")))
        apart = kept(apart.join(weights, "b"))
        led = kept(_with_cleanest(apart))
        met = _ordered(led.filter("b <> p"), "b", "p")
        second = kept(verified(kept(met.join(tested.select("a", "b"), ["a", "b"], "left_anti")), texts, shared))
        known = tested.unionByName(second)
        links = known.filter(F.col("sim") >= threshold).select("a", "b")
        found = components(links)
        more = kept(_further_pairs(_placed_by(led, known, found), threshold).join(known.select("a", "b"), ["a", "b"], "left_anti"))
        if not more.isEmpty():
            found = components(links.unionByName(verified(more, texts, shared).filter(F.col("sim") >= threshold).select("a", "b")))

    grouped = slim.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = grouped.groupBy("root").agg(F.min("name").alias("class_id"), F.sum("copies").alias("class_size")).filter("class_size > 1")
    named = kept(loose(grouped.select("node", "root"), "root").join(loose(named, "root"), "root").select("node", "root", "class_id", "class_size"))
    drop(*made[:-1])
    return signed.select("doc_id", "node"), named


def _open_members(members: DataFrame, tested: DataFrame, found: DataFrame) -> DataFrame:
    """(bucket, b, d, root) of the members of buckets whose members other than the pivot are in several components."""
    rows = members.join(tested, ["a", "b"]).join(found.withColumnRenamed("node", "b"), "b", "left").select("bucket", "b", (1 - F.col("sim")).alias("d"), F.coalesce("root", "b").alias("root"))
    several = rows.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select("bucket")
    return loose(rows, "bucket").join(loose(several, "bucket"), "bucket")


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _with_cleanest(rows: DataFrame) -> DataFrame:
    """The rows with p, their bucket's member with the smallest share of weight of its own, and p's weight."""
    share = F.struct((1 - F.col("common") / F.col("weight")).alias("share"), "b")
    best = rows.groupBy("bucket").agg(F.min_by(F.struct(F.col("b").alias("p"), F.col("weight").alias("p_weight")), share).alias("p")).select("bucket", "p.*")
    return rows.drop("root").join(loose(best, "bucket"), "bucket")


def _placed_by(rows: DataFrame, known: DataFrame, found: DataFrame) -> DataFrame:
    """The rows with their root, distance to p, weight shared with p, and common weight that isn't shared with p."""
    key = ("a", "b_")
    rows = rows.withColumns({"a": F.least("b", "p"), "b_": F.greatest("b", "p")}).join(known.select("a", F.col("b").alias("b_"), "sim"), list(key), "left").drop(*key)
    sim = F.when(F.col("b") == F.col("p"), 1.0).otherwise(F.col("sim"))
    rows = rows.withColumn("sim", sim).withColumn("inside", F.col("sim") * (F.col("weight") + F.col("p_weight")) / (1 + F.col("sim")))
    rows = rows.join(found.withColumnRenamed("node", "b"), "b", "left")
    outside = F.greatest(F.col("common") - F.col("inside"), F.lit(0.0))
    return rows.select("bucket", "b", F.coalesce("root", "b").alias("root"), "d", (1 - F.col("sim")).alias("e"), "inside", outside.alias("outside"), "weight")


def _further_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs of members of a bucket that are in different components and, as far as the bounds tell, may be links.

    Of each bucket only the members outside its largest component meet the others, so a huge group of copies meets few rows; both
    are dealt to blocks of bounded size, every block of the one meeting every block of the other.
    """
    far, low = 1 - threshold + 1e-9, threshold - 1e-9
    shared = "(least(x.inside, y.inside) + least(x.outside, y.outside))"
    may = f"x.root <> y.root AND abs(x.d - y.d) <= {far} AND abs(x.e - y.e) <= {far} AND {shared} >= {low} * (x.weight + y.weight - {shared})"
    roots = rows.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    sizes = roots.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("major"), F.sum("n").alias("all"), F.max("n").alias("most"))
    sizes = sizes.select("bucket", "major", F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("minor_blocks")).filter("minor_blocks > 0")
    rows = loose(rows, "bucket").join(loose(sizes, "bucket"), "bucket")
    deal = lambda n: F.pmod(F.xxhash64("b", F.lit(3)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = rows.filter("root <> major").withColumn("minor_block", deal("minor_blocks")).withColumn("block", every("blocks")).alias("x")
    y = rows.withColumn("block", deal("blocks")).withColumn("minor_block", every("minor_blocks")).alias("y")
    once = "(y.root = y.major OR x.b < y.b)"
    return _ordered(x.join(y, F.expr(f"x.bucket = y.bucket AND x.block = y.block AND x.minor_block = y.minor_block AND {once} AND {may}")), "x.b", "y.b")


def keep_one(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of `df` for each class, with all its columns: that with the smallest id, of equal ids that with the smallest text."""
    signed, named = _solved(df, threshold, id_col, text_col)
    signed = signed.join(named, "node", "left")
    other, node, root, lead, nth = fresh(df, "other_id", "node", "root", "lead_id", "nth")
    gone = stored_compact(signed.filter("doc_id <> class_id").select(F.col("doc_id").alias(other)).distinct(), "gone-ids")
    # Ids that don't name one row, if there are any: their rows are decided on by their texts.
    vague = stored_compact(signed.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").select(F.col("doc_id").alias(other)), "vague-ids")

    def sent(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids  # 16 bytes each

    own = F.col(f"`{id_col}`")
    if vague.isEmpty():
        return df.join(sent(gone), own == F.col(other), "left_anti")
    is_vague = own.eqNullSafe(F.col(other))
    plain = df.join(sent(vague), is_vague, "left_anti").join(sent(gone), own == F.col(other), "left_anti")
    rest = df.join(sent(vague), is_vague, "left_semi")
    schema, at = T.StructType([*rest.schema.fields, T.StructField(node, T.LongType())]), df.columns.index(text_col)

    def with_node(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = Shingled(batch.column(at))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([found.node(i) for i in range(len(found))], type=pa.int64())], names=[*batch.schema.names, node])

    leads = named.select(F.col("node").alias(node), F.col("root").alias(root), F.col("class_id").alias(lead))
    rest = map_texts(rest, with_node, schema, text=text_col).join(leads, node, "left")
    first = F.row_number().over(Window.partitionBy(root).orderBy(own.asc_nulls_last(), F.col(f"`{text_col}`")))
    named_rows = rest.filter(F.col(root).isNotNull() & own.eqNullSafe(F.col(lead))).withColumn(nth, first).filter(F.col(nth) == 1)
    kept = [F.col(f"`{c}`") for c in df.columns]
    return plain.unionByName(rest.filter(F.col(root).isNull()).select(*kept)).unionByName(named_rows.select(*kept))
