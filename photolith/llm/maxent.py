"""Language-model scoring with a hashed maximum-entropy model.

Tokens are words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, and one end token a text. Every token has a class:
the most frequent ones a class each, the other head tokens one by group and frequency, and all others, seen or not, the last class. A
token's group comes from the texts it's in: each text has the mean of fixed random vectors of its tokens, each token the mean over
its occurrences, and k-means over the head tokens' means finds GROUPS groups (in effect, languages or topics). The classes of several tokens are
cut into leaves of about equal mass, so that frequent tokens have a leaf of their own. The model is

    P(token | history) = P(class | history) * P(leaf | class, history) * P(token | leaf)

P(class | history) is a softmax over the classes of bias + weights of the hashed features previous token, previous two tokens, and the skip
over the previous one; P(leaf | class, history) one over the class's leaves, with the hashed features (previous token, class) and (token before it, class).
P(token | leaf) is the maximum-likelihood unigram, add-one in the last class.

* Counts: exact, over all training texts: partial counts per task, one shuffle by token hash, stored as a table.
* The head is what has at least a threshold count, read off a histogram of counts so that it has at most `HEAD`
  tokens; only it, and the weights, are sent to tasks. The weight table has a row for each `TOKENS_PER_ROW` training tokens, from 2^LEAST_BITS to
  2^MOST_BITS of them, so it grows with the corpus up to what a worker can hold.
* Training: ROUNDS rounds, each over its own part of the training texts (dealt by a hash of the text), so all are used once. In a round each task sums
  the gradients of its tokens at the round's weights, Spark sums those of all tasks (one shuffle of the rows that had tokens), and every weight
  makes one step, which shrinks with the squares of its gradients so far. So it doesn't matter how many tasks there are, or which texts
  they have, but for the rounding of mean gradients to half precision.
* Scoring: head tokens in the task; the other tokens of a text leave it as (hash, times) and meet the
  table of counts in a join whose keys are all below the threshold, so no key is hot.

Defined cases: a null or empty text is one end token; a null id counts as not held out; repeated rows count and are
scored each on its own; without training texts all counts are zero; other columns are ignored; an empty table gives
no rows. Tokens are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolith.llm._bytes import LOWER, SPACED, Shared, Words, bound_batches, columns, map_texts, mix, segment_sum, slices
from photolith.llm._store import stored

HEAD = 300_000
SLOT_BITS = 20
SINGLE = 15
GROUPS, BINS = 8, 2
CLASSES = SINGLE + GROUPS * BINS + 1
LEAVES = CLASSES
DIMENSIONS = 4
TOKENS_PER_ROW, LEAST_BITS, MOST_BITS = 2048, 15, 17
BLOCK_ROWS = 512
ROUNDS = 8
TOKENS_PER_TASK, LEAST_TOKENS = 16_000_000, 500_000
BATCH = 32768
RATE, EASE = 0.7, 4.0
NEVER = -60.0
END = np.uint64(0x5851F42D4C957F2D)
START = np.uint64(0x14057B7EF767814F)
PARTIAL_ENTRIES = 1 << 20

SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, an end token after each, and the len + 1 bounds."""
    words = Words(column, SPACED, LOWER)
    texts = len(words.bounds) - 1
    bounds = words.bounds + np.arange(texts + 1)
    out = np.empty(len(words.hash) + texts, dtype=np.uint64)
    last = bounds[1:] - 1
    out[last] = END
    inner = np.ones(len(out), dtype=bool)
    inner[last] = False
    out[inner] = words.hash
    return out, bounds


def text_vectors(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each dimension the mean, over a text's tokens, of values in [-1, 1) that the token's hash fixes."""
    size = np.maximum(np.diff(bounds), 1)
    return np.stack([segment_sum(mix(h ^ np.uint64(0xA24BAED4963EE407 + k)).view(np.int64).astype(np.float64) * 2.0**-63, bounds) / size for k in range(DIMENSIONS)])


def _summed(h: np.ndarray, columns_: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    keys, at = np.unique(h, return_inverse=True)
    return keys, [np.bincount(at, weights=c) for c in columns_]


def partial_counts(rows: DataFrame) -> DataFrame:
    """(h, n, v0, ...) of the tokens of each partition, once or a few times each: counts and sums of their texts' vectors."""
    names = [f"v{k}" for k in range(DIMENSIONS)]

    def run(batches):
        held: list[tuple[np.ndarray, list[np.ndarray]]] = []
        size = 0

        def merged():
            return _summed(np.concatenate([x for x, _ in held]), [np.concatenate(c) for c in zip(*(c for _, c in held), strict=True)])

        def out(keys, sums):
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sums[0].astype(np.int64)), *map(pa.array, sums[1:])], names=["h", "n", *names])

        for batch in batches:
            for part in slices(batch, "text"):
                h, bounds = tokens(part.column(0))
                of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                held.append(_summed(h, [np.ones(len(h)), *(v[of] for v in text_vectors(h, bounds))]))
                size += len(held[-1][0])
                if size > PARTIAL_ENTRIES:
                    held[:] = [merged()]
                    size = len(held[0][0])
                    if size > PARTIAL_ENTRIES // 2:
                        yield out(*held.pop())
                        size = 0
        if held:
            yield out(*merged())

    return rows.select("text").mapInArrow(run, "h long, n long, " + ", ".join(f"{v} double" for v in names))


def groups_of(vectors: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """k-means (rows: tokens) weighted by the square root of the counts, from centres that are far apart."""
    if not len(vectors):
        return np.zeros(0, dtype=np.int64)
    weight = np.sqrt(weight)
    centres = [np.average(vectors, axis=0, weights=weight)]
    nearest = np.full(len(vectors), np.inf)
    for _ in range(GROUPS):
        nearest = np.minimum(nearest, ((vectors - centres[-1]) ** 2).sum(axis=1))
        centres.append(vectors[np.argmax(nearest * weight)])
    centre = np.array(centres[1:])
    for _ in range(20):
        of = np.argmin(((vectors[:, None, :] - centre[None]) ** 2).sum(axis=2), axis=1)
        mass = np.bincount(of, weights=weight, minlength=GROUPS)
        moved = np.stack([np.bincount(of, weights=weight * vectors[:, k], minlength=GROUPS) for k in range(vectors.shape[1])], axis=1)
        centre = np.where(mass[:, None] > 0, moved / np.maximum(mass, 1e-12)[:, None], centre)
    return of


@dataclass
class Head:
    """The frequent tokens in a table with one slot for each hash prefix, and the classes."""

    keys: np.ndarray
    count: np.ndarray
    cls: np.ndarray
    leaf: np.ndarray
    logp: np.ndarray  # of a head token given its leaf, log10
    bias: np.ndarray
    leaf_bias: np.ndarray  # by class and leaf; a class of one leaf has it at 0
    total: int
    kinds: int
    tail_total: int
    tail_kinds: int

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        return slot, self.keys[slot] == h


def make_head(h: np.ndarray, n: np.ndarray, total: int, kinds: int, vectors: np.ndarray | None = None) -> Head:
    """Of tokens that share a slot the most frequent one is in the head; the others are treated like the rest."""
    order = np.lexsort((h, -n))
    h, n = h[order], n[order]
    slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    _, first = np.unique(slot, return_index=True)
    first.sort()
    h, n, slot = h[first], n[first], slot[first]
    group = groups_of(vectors[order][first] / n[:, None], n) if vectors is not None else np.zeros(len(h), dtype=np.int64)
    rank = np.arange(len(h))
    spread = np.log((rank + 1) / SINGLE) / max(np.log(max(len(h), SINGLE + 2) / SINGLE), 1e-9)
    cls = np.where(rank < SINGLE, rank, SINGLE + group * BINS + np.clip((spread * BINS).astype(np.int64), 0, BINS - 1))
    mass = np.bincount(cls, weights=n, minlength=CLASSES).astype(np.float64)
    # Leaves: by the share of the class's mass that comes before a token, the most frequent first.
    order = np.argsort(cls, kind="stable")
    before = np.cumsum(n[order]) - n[order]
    before = before - before[np.searchsorted(cls[order], cls[order])] if len(order) else before
    leaf = np.zeros(len(h), dtype=np.int64)
    leaf[order] = np.where(cls[order] < SINGLE, 0, np.minimum(before * LEAVES // np.maximum(mass[cls[order]], 1), LEAVES - 1))
    leaf_mass = np.bincount(cls * LEAVES + leaf, weights=n, minlength=CLASSES * LEAVES).astype(np.float64)
    mass[CLASSES - 1] = total - n.sum()
    size = 1 << SLOT_BITS
    keys, count, classes, logp = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.int64), np.full(size, CLASSES - 1, dtype=np.int8), np.zeros(size, dtype=np.float32)
    leaves = np.zeros(size, dtype=np.int8)
    keys[slot], count[slot], classes[slot], leaves[slot] = h, n, cls, leaf
    logp[slot] = np.log10(n / leaf_mass[cls * LEAVES + leaf])
    leaf_mass = leaf_mass.reshape(CLASSES, LEAVES)
    with np.errstate(divide="ignore"):
        leaf_bias = np.where(leaf_mass > 0, np.log(leaf_mass / np.maximum(leaf_mass.sum(axis=1, keepdims=True), 1)), NEVER).astype(np.float32)
    leaf_bias[:SINGLE] = leaf_bias[CLASSES - 1] = np.where(np.arange(LEAVES) == 0, 0, NEVER)
    return Head(keys, count, classes, leaves, logp, np.log((mass + 1) / (mass.sum() + CLASSES)).astype(np.float32), leaf_bias, int(total), int(kinds), int(total - n.sum()), int(kinds - len(h)))


def history(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token the one before it and the one before that, in its own text."""
    one = np.concatenate(([START], h[:-1]))
    two = np.concatenate(([START], one[:-1]))
    starts = bounds[:-1]
    one[starts] = START
    two[starts] = START
    second = starts + 1
    two[second[second < bounds[1:]]] = START
    return one, two


def features(one: np.ndarray, two: np.ndarray, bits: int) -> list[np.ndarray]:
    """Rows of the weight table for each token's history: half of them for the previous token, a quarter each for the pair and the skip."""
    shift, quarter = np.uint64(64 - bits), np.uint64(1 << bits) // np.uint64(4)
    pair = mix(one ^ (two * np.uint64(0x9E3779B97F4A7C15))) >> shift
    return [((mix(one) >> shift) >> np.uint64(1)).astype(np.int64), (quarter * np.uint64(2) + (pair >> np.uint64(2))).astype(np.int64), (quarter * np.uint64(3) + (mix(two ^ START) >> shift >> np.uint64(2))).astype(np.int64)]


def leaf_features(one: np.ndarray, two: np.ndarray, cls: np.ndarray, bits: int) -> list[np.ndarray]:
    """Rows, after those of the classes, for the leaf in a class: half for the previous token, half for the one before it."""
    shift, rows = np.uint64(64 - bits + 1), 1 << bits
    salt = mix(cls.astype(np.uint64) + np.uint64(0xD1B54A32D192ED03))
    return [rows + (mix(one ^ salt) >> shift).astype(np.int64), rows + rows // 2 + (mix(two ^ ~salt) >> shift).astype(np.int64)]


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    x -= np.log(np.exp(x).sum(axis=1, keepdims=True))
    return x


def logits(bias: np.ndarray, weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    out = bias + weights[rows[0]]
    for r in rows[1:]:
        out += weights[r]
    return out


class Gradient:
    """The sum of the losses' gradients over tokens at fixed weights, and how many tokens each row of the weight table had."""

    def __init__(self, head: Head, weights: np.ndarray):
        self.head, self.weights, self.bits = head, weights.astype(np.float32), (len(weights) // 2).bit_length() - 1
        self.total = np.zeros(weights.shape, dtype=np.float32)
        self.times = np.zeros(len(weights), dtype=np.float32)

    def add(self, h: np.ndarray, bounds: np.ndarray) -> None:
        slot, found = self.head.find(h)
        target = np.where(found, self.head.cls[slot], CLASSES - 1).astype(np.int64)
        leaf = self.head.leaf[slot].astype(np.int64)
        one, two = history(h, bounds)
        for a in range(0, len(h), BATCH):
            at = slice(a, min(len(h), a + BATCH))
            self._add(self.head.bias, features(one[at], two[at], self.bits), target[at])
            many = a + np.flatnonzero((target[at] >= SINGLE) & (target[at] < CLASSES - 1))
            if len(many):
                self._add(self.head.leaf_bias[target[many]], leaf_features(one[many], two[many], target[many], self.bits), leaf[many])

    def _add(self, bias: np.ndarray, rows: list[np.ndarray], target: np.ndarray) -> None:
        p = logits(bias, self.weights, rows)
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(p)), target] -= 1
        for r in rows:
            order = np.argsort(r)
            ordered = r[order]
            edge = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
            own = ordered[edge]
            self.total[own] += np.add.reduceat(p[order], edge, axis=0)
            self.times[own] += np.diff(np.append(edge, len(r)))


def gradients(rows: DataFrame, shared, weights) -> DataFrame:
    """(block, rows, times, means) by task: of each block of `BLOCK_ROWS` rows of the table those that had tokens, with the mean gradient of a token in half precision."""

    def run(batches):
        own = None
        for batch in batches:
            for part in slices(batch, "text"):
                own = own or Gradient(shared.value, weights.value)
                own.add(*tokens(part.column(0)))
        used = np.flatnonzero(own.times) if own is not None else np.zeros(0, dtype=np.int64)
        for k in np.unique(used // BLOCK_ROWS).tolist():
            at = used[np.searchsorted(used, k * BLOCK_ROWS) : np.searchsorted(used, (k + 1) * BLOCK_ROWS)]
            mean = (own.total[at] / own.times[at, None]).astype(np.float16)
            yield pa.RecordBatch.from_arrays([pa.array([k], type=pa.int32()), *(pa.array([x.tobytes()]) for x in ((at % BLOCK_ROWS).astype(np.uint16), own.times[at], mean))], names=["block", "rows", "times", "means"])

    return rows.select("text").mapInArrow(run, "block int, rows binary, times binary, means binary")


def summed(parts: DataFrame) -> DataFrame:
    """(block, total) of what `gradients` gives: the gradient of each of a block's rows, summed over all tasks."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, rows, times, means in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total = sums.setdefault(k, np.zeros((BLOCK_ROWS, CLASSES)))
                at, n = np.frombuffer(rows, dtype=np.uint16), np.frombuffer(times, dtype=np.float32)
                total[at] += n[:, None] * np.frombuffer(means, dtype=np.float16).reshape(len(at), CLASSES)
        for k, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], type=pa.int32()), pa.array([total.astype(np.float32).tobytes()])], names=["block", "total"])

    return parts.repartition("block").mapInArrow(run, "block int, total binary")


@dataclass
class Model:
    """What is learned: the head, the weights (of classes, then of leaves), and the table of all counts (h, n)."""

    head: Head
    weights: np.ndarray
    counts: DataFrame


def table_bits(tokens_seen: int) -> int:
    """The weight table's rows, as a power of two: they grow with the number of training tokens."""
    return int(min(max(math.ceil(math.log2(max(tokens_seen, 1) / TOKENS_PER_ROW)), LEAST_BITS), MOST_BITS))


def stepped(weights: np.ndarray, squares: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weights after a round's gradient, and the sums of squared gradients, by which each weight's steps shrink."""
    squares = squares + np.square(total)
    return weights - RATE * total / np.sqrt(squares + EASE), squares


def learned_weights(training: DataFrame, shared, total: int) -> np.ndarray:
    """The weights after all rounds of summed gradients.

    A task goes through about TOKENS_PER_TASK tokens, so that the rows it shuffles are fewer than its texts, or fewer where cores would idle.
    How the texts are dealt to tasks changes nothing but the order of sums.
    """
    context, bits = training.sparkSession.sparkContext, table_bits(total)
    training = training.coalesce(max(-(-total // TOKENS_PER_TASK), min(context.defaultParallelism, -(-total // LEAST_TOKENS)), 1))
    weights, squares = (np.zeros((2 << bits, CLASSES), dtype=np.float32) for _ in range(2))
    turn = F.pmod(F.xxhash64("text", F.lit(29)), F.lit(ROUNDS))
    for k in range(ROUNDS):
        sent = context.broadcast(weights.astype(np.float16))  # enough to take gradients at; a round's copies stay on executors' disks for a while
        found = summed(gradients(training.filter(turn == k), shared, sent)).toArrow()
        for block, part in zip(*(c.to_pylist() for c in found.columns), strict=True):
            at = slice(block * BLOCK_ROWS, (block + 1) * BLOCK_ROWS)
            weights[at], squares[at] = stepped(weights[at], squares[at], np.frombuffer(part, dtype=np.float32).reshape(BLOCK_ROWS, CLASSES))
        sent.destroy()
    return weights


def fit(training: DataFrame, head_size: int = HEAD) -> Model:
    """The model of the texts of `training` (text)."""
    counts = stored(partial_counts(training).groupBy("h").agg(F.sum("n").alias("n"), *[F.sum(f"v{k}").alias(f"v{k}") for k in range(DIMENSIONS)]), "token-counts")
    # Counts below 64 stand for themselves in the histogram, larger ones go by eighths of a power of two.
    bin_of = F.when(F.col("n") < 64, F.col("n")).otherwise((F.log2("n") * 8).cast("long") + 16)
    histogram = counts.groupBy(bin_of.alias("bin")).agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("total")).orderBy(F.desc("bin")).collect()
    total, kinds = sum(r["total"] for r in histogram), sum(r["kinds"] for r in histogram)
    threshold, size = None, 0
    for r in histogram:
        size += r["kinds"]
        if size > head_size:
            break
        threshold = r["least"]
    frequent = (counts.filter(F.col("n") >= threshold) if threshold is not None else counts.limit(0)).toArrow()
    vectors = np.stack([frequent.column(f"v{k}").to_numpy() for k in range(DIMENSIONS)], axis=1)
    head = make_head(frequent.column("h").to_numpy().view(np.uint64), frequent.column("n").to_numpy(), total, kinds, vectors)
    return Model(head, learned_weights(training, Shared(training.sparkSession, head), total), counts.select("h", "n"))


def score_part(column: pa.Array, head: Head, weights: np.ndarray) -> tuple:
    """Of each text: tokens, known head tokens, sum of log10(count + 1) of head tokens, log10 probability without the tail's
    own part, and its tail tokens (hash, times) with their bounds."""
    h, bounds = tokens(column)
    bits = (len(weights) // 2).bit_length() - 1
    slot, found = head.find(h)
    cls = np.where(found, head.cls[slot], CLASSES - 1).astype(np.int64)
    leaf = head.leaf[slot].astype(np.int64)
    each = np.where(found, head.logp[slot], -np.log10(head.tail_total + head.tail_kinds + 1.0)).astype(np.float64)
    one, two = history(h, bounds)
    for a in range(0, len(h), BATCH):
        at = slice(a, min(len(h), a + BATCH))
        p = log_softmax(logits(head.bias, weights, features(one[at], two[at], bits)))
        each[at] += p[np.arange(len(p)), cls[at]] / np.log(10)
        many = a + np.flatnonzero((cls[at] >= SINGLE) & (cls[at] < CLASSES - 1))
        if len(many):
            p = log_softmax(logits(head.leaf_bias[cls[many]], weights, leaf_features(one[many], two[many], cls[many], bits)))
            each[many] += p[np.arange(len(p)), leaf[many]] / np.log(10)
    base = np.where(found, np.log10(head.count[slot] + 1.0), 0.0)
    texts = len(bounds) - 1
    tail = np.flatnonzero(~found)
    of = np.searchsorted(bounds, tail, side="right") - 1
    order = np.lexsort((h[tail], of))
    of, key = of[order], h[tail][order]
    edge = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (key[1:] != key[:-1])))) if len(of) else np.zeros(0, dtype=np.int64)
    times = np.diff(np.append(edge, len(of)))
    tail_bounds = np.searchsorted(of[edge], np.arange(texts + 1))
    return np.diff(bounds), segment_sum(found, bounds), segment_sum(base, bounds), segment_sum(each, bounds), key[edge], times, tail_bounds


def score(df: DataFrame, parts: int = 7, part: int = 2, id_col: str = "doc_id", text_col: str = "text", head_size: int = HEAD) -> DataFrame:
    """Scores of all rows under the model learned from those whose crc32(id) modulo `parts` isn't `part`."""
    bound_batches(df)
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == part, F.lit(False))
    rows = columns(df, doc_id=id_col, text=text_col).withColumn("held_out", out)
    return apply(fit(rows.filter(~F.col("held_out")), head_size), rows)


def apply(model: Model, rows: DataFrame) -> DataFrame:
    """The scores of rows (doc_id, text, held_out) under a model."""
    head, counts = model.head, model.counts
    shared, weights = Shared(rows.sparkSession, head), rows.sparkSession.sparkContext.broadcast(model.weights)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_tokens, known, base, own, keys, times, bounds = score_part(batch.column(1), shared.value, weights.value)
        tail = pa.ListArray.from_arrays(pa.array(bounds, type=pa.int32()), pa.StructArray.from_arrays([pa.array(keys.view(np.int64)), pa.array(times, type=pa.int32())], names=["h", "times"]))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n_tokens), pa.array(known), pa.array(base), pa.array(own), tail], names=["doc_id", "held_out", "n_tokens", "n_known", "base", "own", "tail"])

    kept = rows.schema["doc_id"].dataType.simpleString()
    scored = map_texts(rows, run, f"doc_id {kept}, held_out boolean, n_tokens long, n_known long, base double, own double, tail array<struct<h:long,times:int>>")
    scored = stored(scored.withColumn("row_id", F.monotonically_increasing_id()), "scored-texts")
    tails = scored.select("row_id", F.inline("tail"))
    found = tails.join(counts.select("h", "n"), "h").groupBy("row_id").agg(F.sum("times").alias("tail_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("tail_log"))
    seen = F.coalesce(F.col("tail_known"), F.lit(0))
    more = F.coalesce(F.col("tail_log"), F.lit(0.0))
    floor = float(np.log10(head.total + head.kinds + 1.0))
    return scored.drop("tail").join(found, "row_id", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + seen).cast("long").alias("n_known"), F.lit(head.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(floor)).alias("base_score"), (F.col("own") + more).alias("score"),
    )
