"""Benchmark decontamination by winnowing.

Texts are lower-cased (A-Z) and split into words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. Of each run of `WINDOW`
consecutive k-grams (k = `GRAM` words) the one with the smallest hash is kept as a fingerprint, so any span of
GRAM + WINDOW - 1 = 13 words shared by a document and a benchmark item shares a fingerprint. Fingerprints
that meet are extended word by word to the longest common span; spans of 13 words or more mark all their
words. An item of 1 to 12 words counts as a whole: its fingerprint is its only n-gram and documents are
looked up with every n-gram of that length.

Document fingerprints probe an index of the benchmark's fingerprints, which is broadcast. The benchmark is
taken in blocks of at most `BLOCK_WORDS` words, each with its own pass, so the size of what is broadcast
is bounded whatever the benchmark's size; the spans found per block are merged by document row.

Defined cases: null and empty texts have no words, no hits and aren't contaminated; an item without words
never occurs; equal items each count; repeated documents are judged each on its own; an empty benchmark
hits nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolith.llm._bytes import ALNUM, LOWER, Shared, Words, columns, fresh, map_texts, owner, segment_sum, windows, with_own_id
from photolith.llm._store import stored

SPAN = 13
GRAM = 7
WINDOW = SPAN - GRAM + 1
BLOCK_WORDS = 1 << 21
PAIRS = 1 << 20
BITS = 22

RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def winnow(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which k-grams are the smallest (or tie with it) of some run of WINDOW consecutive ones in a text."""
    n = len(keys)
    if n < WINDOW:
        return np.zeros(n, dtype=bool)
    low = keys[: n - WINDOW + 1].copy()
    for i in range(1, WINDOW):
        np.minimum(low, keys[i : n - WINDOW + 1 + i], out=low)
    whole = first[WINDOW - 1 :] - first[: n - WINDOW + 1] == WINDOW - 1
    low[~whole] = 0
    best = np.zeros(n, dtype=np.uint64)
    for i in range(WINDOW):
        np.maximum(best[i : n - WINDOW + 1 + i], low, out=best[i : n - WINDOW + 1 + i])
    return (best == keys) & (best > 0)


class Index:
    """Fingerprints of a block of benchmark items: sorted arrays, a bitmap before them, and the items' words."""

    def __init__(self, items: list[tuple[str, str | None]]):
        self.ids = [i for i, _ in items]
        words = Words(pa.array([t for _, t in items], type=pa.string()), ALNUM, LOWER)
        self.hash, self.bounds = words.hash, words.bounds
        self.length = np.diff(self.bounds)
        item_of = owner(self.bounds)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        first, keys = windows(self.hash, self.bounds, GRAM)
        kept = winnow(keys, first) & (self.length[item_of[first]] >= SPAN) if len(first) else np.zeros(0, dtype=bool)
        self._add(0, keys[kept], first[kept])
        for size in sorted({int(n) for n in self.length if 0 < n < SPAN}):
            first, keys = windows(self.hash, self.bounds, size)
            kept = self.length[item_of[first]] == size
            self._add(size, keys[kept], first[kept])

    def _add(self, size: int, keys: np.ndarray, first: np.ndarray) -> None:
        if len(keys):
            order = np.argsort(keys, kind="stable")
            bits = np.zeros(1 << BITS, dtype=bool)
            bits[keys >> np.uint64(64 - BITS)] = True
            self.tables[size] = (keys[order], first[order], np.packbits(bits))

    def meet(self, size: int, keys: np.ndarray, first: np.ndarray):
        """Pairs (document word, item word) at which equal fingerprints start, about `PAIRS` at a time, however many items share a passage."""
        ours, at, bits = self.tables[size]
        slot = (keys >> np.uint64(64 - BITS)).astype(np.int64)
        maybe = (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 > 0
        keys, first = keys[maybe], first[maybe]
        low, high = np.searchsorted(ours, keys, side="left"), np.searchsorted(ours, keys, side="right")
        times = high - low
        first, low, times = first[times > 0], low[times > 0], times[times > 0]
        total, start = np.cumsum(times), 0
        while start < len(times):
            stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + PAIRS, side="right")))
            n, one = times[start:stop], low[start:stop]
            before = np.cumsum(n) - n
            yield np.repeat(first[start:stop], n), at[np.repeat(one - before, n) + np.arange(int(n.sum()))]
            start = stop


def common_spans(words: Words, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (in document words) of the spans shared with items, and the items."""
    item_of, doc_of = owner(index.bounds), owner(words.bounds)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for size in index.tables:
        first, keys = windows(words.hash, words.bounds, size or GRAM)
        if not size:
            kept = winnow(keys, first)
            first, keys = first[kept], keys[kept]
        for ours, theirs in index.meet(size, keys, first):
            found.append(_extended(words, index, size, ours, theirs, doc_of, item_of))
    if not found:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _extended(words: Words, index: Index, size: int, ours: np.ndarray, theirs: np.ndarray, doc_of: np.ndarray, item_of: np.ndarray) -> tuple:
    """The distinct spans around pairs of equal fingerprints, and their items."""
    item = item_of[theirs]
    left, right = ours.copy(), ours + (size or GRAM)
    if not size:
        # Step by step, vectorised over the pairs that still agree.
        shift = theirs - ours
        go = np.arange(len(ours))
        low = np.maximum(words.bounds[doc_of[ours]], index.bounds[item] - shift)
        high = np.minimum(words.bounds[doc_of[ours] + 1], index.bounds[item + 1] - shift)
        while len(go):
            go = go[left[go] > low[go]]
            go = go[words.hash[left[go] - 1] == index.hash[left[go] - 1 + shift[go]]]
            left[go] -= 1
        go = np.arange(len(ours))
        while len(go):
            go = go[right[go] < high[go]]
            go = go[words.hash[right[go]] == index.hash[right[go] + shift[go]]]
            right[go] += 1
        whole = right - left >= SPAN
        left, right, item = left[whole], right[whole], item[whole]
    return tuple(np.unique(np.stack([left, right, item]), axis=1))


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(set(ids))).encode()).hexdigest()


def blocks(benchmark: DataFrame, id_col: str, text_col: str, most_words: int):
    """Runs of benchmark items with about `most_words` words, in the order of a streaming read on the driver."""
    rows, size = [], 0
    for i, text in columns(benchmark, i=id_col, t=text_col).toLocalIterator():
        rows.append((str(i), text))
        size += len(text or "") // 2
        if size >= most_words:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def find(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row of hit counts for each row of `df`: one pass without a shuffle for each block of the benchmark."""
    spark = df.sparkSession
    rows = columns(df, doc_id=id_col, text=text_col)
    parts = (Shared(spark, Index(x)) for x in blocks(benchmark, item_id_col, item_text_col, block_words))
    first, second = next(parts, None), next(parts, None)
    if second is None:
        return _pass(rows, first or Shared(spark, Index([])), merged=False)
    # Rows are told apart by numbers that are written once: numbers made anew in every pass need not be the same.
    keyed = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "decontamination-rows")
    hits = None
    for shared in itertools.chain((first, second), parts):
        one = _pass(keyed, shared, merged=True)
        hits = one if hits is None else hits.unionByName(one)
    merged = hits.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    return merged.drop("_row").mapInArrow(_merge, with_own_id(RESULT, df, id_col))


def _pass(rows: DataFrame, shared, merged: bool) -> DataFrame:
    keyed = "_row" in rows.columns

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        index = shared.value
        words = Words(batch.column(1), ALNUM, LOWER)
        left, right, item = common_spans(words, index)
        texts = batch.num_rows
        doc = np.searchsorted(words.bounds, left, side="right") - 1
        pairs = np.unique(np.stack([doc, item]), axis=1) if len(doc) else np.zeros((2, 0), dtype=np.int64)
        cut = np.searchsorted(pairs[0], np.arange(texts + 1))
        names = [[index.ids[j] for j in pairs[1][cut[k] : cut[k + 1]]] if cut[k + 1] > cut[k] else [] for k in range(texts)]
        n = words.counts()
        if merged:
            change = np.zeros(len(words.hash) + 1, dtype=np.int64)
            np.add.at(change, left, 1)
            np.add.at(change, right, -1)
            covered = np.cumsum(change[:-1]) > 0
            spans = [np.flatnonzero(covered[a:b]).tolist() for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, type=pa.int64()), pa.array(spans, type=pa.list_(pa.int64())), pa.array(names, type=pa.list_(pa.string()))], names=["doc_id", "_row", "n_words", "spans", "items"])
        change = np.zeros(len(words.hash) + 1, dtype=np.int64)
        np.add.at(change, left, 1)
        np.add.at(change, right, -1)
        hit = segment_sum(np.cumsum(change[:-1]) > 0, words.bounds)
        return _result(batch.column(0), n, hit, names)

    schema = "doc_id long, _row long, n_words long, spans array<long>, items array<string>" if keyed else RESULT
    return map_texts(rows, part, with_own_id(schema, rows, "doc_id"))


def _result(ids: pa.Array, n: np.ndarray, hit: np.ndarray, names: list[list[str]]) -> pa.RecordBatch:
    empty = digest([])
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(n, type=pa.int64()), pa.array(hit, type=pa.int64()), pa.array([len(set(x)) if x else 0 for x in names], type=pa.int64()), pa.array([digest(x) if x else empty for x in names], type=pa.string()), pa.array((hit > 0) & (20 * hit >= n))],
        names=[x.split()[0] for x in RESULT.split(", ")],
    )


def _merge(batches):
    for batch in batches:
        hit = np.array([len(set(x)) for x in batch.column(2).to_pylist()], dtype=np.int64)
        yield _result(batch.column(0), batch.column(1).to_numpy(zero_copy_only=False), hit, batch.column(3).to_pylist())


def keep_clean(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of `df` that aren't contaminated, with all their columns.

    With a benchmark of one block this is one pass without a shuffle; with more, rows are written with numbers, by which those
    found contaminated are taken out.
    """
    spark = df.sparkSession
    parts = (Shared(spark, Index(x)) for x in blocks(benchmark, item_id_col, item_text_col, block_words))
    first, second = next(parts, None), next(parts, None)
    if first is None:
        return df
    if second is not None:
        own, other = fresh(df, "row_number", "other_number")
        keyed = stored(df.withColumn(own, F.monotonically_increasing_id()), "decontamination-rows")
        marked = find(keyed, benchmark, id_col=own, text_col=text_col, item_id_col=item_id_col, item_text_col=item_text_col, block_words=block_words)
        bad = marked.filter("contaminated").select(F.col("doc_id").alias(other))
        return keyed.join(bad, F.col(own) == F.col(other), "left_anti").drop(own)
    at = df.columns.index(text_col)

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column(at), ALNUM, LOWER)
        left, right, _ = common_spans(words, first.value)
        change = np.zeros(len(words.hash) + 1, dtype=np.int64)
        np.add.at(change, left, 1)
        np.add.at(change, right, -1)
        hit, n = segment_sum(np.cumsum(change[:-1]) > 0, words.bounds), words.counts()
        return batch.filter(pa.array(~((hit > 0) & (20 * hit >= n))))

    return map_texts(df, part, df.schema, text=text_col)
