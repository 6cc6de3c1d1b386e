"""Ranked lexical search by windowed bucket scoring.

Terms are the matches of `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`, A-Z lower-cased. N counts the documents with a term, L all
their terms, n those of one document, df the documents that hold a term, tf its occurrences in one. A term weighs
w = floor(1000 ln((2N+2) / (2df+1))), in doubles; the rest is integer arithmetic: m = 100 - 25 + (25 n N) div L, and a document's score sums
w * ((10^9 tf) div (1000 tf + 12 m)) over the item's terms, repeats included.

Two passes without a shuffle of texts. The first counts N, L and the df of the items' terms; each task adds up its counts before they
leave it. In the second each task makes an index segment of its rows: documents are numbered in the order of
their ids, and the postings of the items' terms, with their contributions, are sorted by window (`WINDOW` document numbers), term and
number. Window by window, an item's postings are scattered and added into an array that fits a core's first cache, the bitsets of its
terms' documents are joined by OR, and what they mark is harvested into the item's heap, after which the marked cells are zero again. So a
document costs an item only if it holds one of its terms, and memory follows the segment (`POSTINGS` postings), not the
partition. A task passes on its best `k` documents for each item, and Spark ranks those.

Items are taken in blocks of at most `BLOCK_WORDS` words, each with its own two passes, so what goes out with the tasks is bounded
however many items there are. Terms are told apart by 64-bit hashes.

Defined cases: null and empty texts have no terms: such documents aren't counted in N and such items get no rows; repeated documents are
ranked each on its own; equal scores are in the order of ids, a null id last; items that repeat an id are each ranked on
their own; scores of zero aren't returned; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photolith.llm._bytes import ALNUM, LOWER, Shared, Words, bound_batches, columns, owner, slices

K = 20
WINDOW = 4096
POSTINGS = 1 << 21
BLOCK_WORDS = 1 << 20
DOCUMENTS, TERMS = -1, -2


class Items:
    """The terms of a block of items: all of them, sorted, and of each item its terms and how often it has them."""

    def __init__(self, texts: list[str | None]):
        words = Words(pa.array(texts, type=pa.string()), ALNUM, LOWER)
        self.terms, at = np.unique(words.hash, return_inverse=True)
        pairs, self.times = np.unique(owner(words.bounds) * max(len(self.terms), 1) + at, return_counts=True)
        self.term = pairs % max(len(self.terms), 1)
        self.cut = np.searchsorted(pairs // max(len(self.terms), 1), np.arange(len(texts) + 1))

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct (text, term) pairs of the texts, as far as an item has the term, and how often each occurs."""
        if not len(self.terms) or not len(words.hash):
            z = np.zeros(0, dtype=np.int64)
            return z, z, z
        at = np.minimum(np.searchsorted(self.terms, words.hash), len(self.terms) - 1)
        found = self.terms[at] == words.hash
        pairs, times = np.unique(owner(words.bounds)[found] * len(self.terms) + at[found], return_counts=True)
        return pairs // len(self.terms), pairs % len(self.terms), times


def counted(rows: DataFrame, shared: Shared) -> tuple[int, int, np.ndarray]:
    """N, L, and the df of each of the items' terms."""

    def run(batches):
        items = shared.value
        df, n, total = np.zeros(len(items.terms), dtype=np.int64), 0, 0
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column(0), ALNUM, LOWER)
                n += int((words.counts() > 0).sum())
                total += len(words.hash)
                df += np.bincount(items.find(words)[1], minlength=len(df))
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, (DOCUMENTS, TERMS)).astype(np.int32)), pa.array(np.append(df[used], (n, total)))], names=["term", "n"])

    parts = rows.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    found = dict(zip(parts.column("term").to_pylist(), parts.column("n").to_pylist(), strict=True))
    df = np.zeros(len(shared.value.terms), dtype=np.int64)
    for term, n in found.items():
        if term >= 0:
            df[term] = n
    return found.get(DOCUMENTS, 0), found.get(TERMS, 0), df


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)


def lengths(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """m of documents with n terms."""
    if 25 * int(n.max(initial=0)) * documents < 1 << 63:
        return 75 + 25 * n * documents // terms
    return np.array([75 + 25 * x * documents // terms for x in n.tolist()], dtype=np.int64)


class Segment:
    """Postings of a run of documents, and the traversal of its windows."""

    def __init__(self):
        self.ids: list[pa.Array] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.documents = self.postings = 0

    def add(self, ids: pa.Array, doc: np.ndarray, term: np.ndarray, gain: np.ndarray) -> None:
        """Documents, and of each posting the document's place among them, the term, and what it adds to a score."""
        held, doc = np.unique(doc, return_inverse=True)  # those without postings need no number
        self.ids.append(ids.take(pa.array(held)))
        self.parts.append((doc + self.documents, term, gain))
        self.documents += len(held)
        self.postings += len(doc)

    def harvest(self, items: Items, tops: list[list], k: int) -> None:
        """Bring the items' best documents up to date with the segment's."""
        if not self.postings:
            return
        ids = pa.concat_arrays(self.ids)
        order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.arange(len(order))
        doc, term, gain = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        place = number[doc]
        by = np.argsort((place // WINDOW * len(items.terms) + term) * WINDOW + place % WINDOW)
        place, term, gain = place[by], term[by], gain[by]
        cuts = np.searchsorted(place // WINDOW, np.arange(int(place[-1]) // WINDOW + 2))
        bucket = np.zeros(WINDOW, dtype=np.int64)
        for w in range(len(cuts) - 1):
            own = slice(cuts[w], cuts[w + 1])
            if own.stop > own.start:
                _window(items, place[own] - w * WINDOW, term[own], gain[own], bucket, tops, lambda cell, base=w * WINDOW: ids[int(order[base + cell])].as_py(), k)


def _window(items: Items, cell: np.ndarray, term: np.ndarray, gain: np.ndarray, bucket: np.ndarray, tops: list[list], name, k: int) -> None:
    here, first = np.unique(term, return_index=True)
    ends = np.append(first[1:], len(term))
    where = np.full(len(items.terms), -1, dtype=np.int64)
    where[here] = np.arange(len(here))
    # The occupancy bitset of each term: its words of 64 cells, from postings that are sorted by term and cell.
    word = where[term] * (WINDOW // 64) + (cell >> 6)
    start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    bits = np.zeros(len(here) * (WINDOW // 64), dtype=np.uint64)
    bits[word[start]] = np.bitwise_or.reduceat(np.uint64(1) << (cell & 63).astype(np.uint64), start)
    bits = bits.reshape(len(here), WINDOW // 64)
    for i, top in enumerate(tops):
        mine = slice(items.cut[i], items.cut[i + 1])
        rows = where[items.term[mine]]
        held = rows >= 0
        if not held.any():
            continue
        for row, times in zip(rows[held].tolist(), items.times[mine][held].tolist(), strict=True):
            own = slice(first[row], ends[row])
            bucket[cell[own]] += gain[own] if times == 1 else times * gain[own]
        marked = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bits[rows[held]], axis=0).view(np.uint8), bitorder="little"))
        scores = bucket[marked]
        bucket[marked] = 0
        least = top[0][0] if len(top) == k else 1
        good = np.flatnonzero(scores >= least)
        if len(good) > k:  # cells ascend as ids do
            good = good[np.argsort(-scores[good], kind="stable")[:k]]
        for j in good.tolist():
            entry = (int(scores[j]), _Last(name(int(marked[j]))))
            if len(top) < k:
                heapq.heappush(top, entry)
            elif entry > top[0]:
                heapq.heapreplace(top, entry)


class _Last:
    """An id whose order is turned round, so that of equal scores a heap lets the largest id go first, a null before all."""

    __slots__ = ("id",)

    def __init__(self, id_):
        self.id = id_

    def __lt__(self, other) -> bool:
        if self.id is None or other.id is None:
            return self.id is None and other.id is not None
        return self.id > other.id

    def __eq__(self, other) -> bool:
        return self.id == other.id


def scored(rows: DataFrame, shared: Shared, documents: int, terms: int, df: np.ndarray, k: int) -> DataFrame:
    """(item, doc_id, score): each task's k best documents for each item."""
    sent = Shared(rows.sparkSession, weights(df, documents))
    kind = rows.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("doc_id", kind), T.StructField("score", T.LongType())])

    def run(batches):
        items, w, as_ids = shared.value, sent.value, None
        tops, segment = [[] for _ in range(len(items.cut) - 1)], Segment()
        for batch in batches:
            as_ids = batch.column(0).type
            for part in slices(batch, "text"):
                words = Words(part.column(1), ALNUM, LOWER)
                doc, term, tf = items.find(words)
                worth = w[term] > 0
                doc, term, tf = doc[worth], term[worth], tf[worth].astype(np.int64)
                gain = w[term] * (1_000_000_000 * tf // (1000 * tf + 12 * lengths(words.counts(), documents, max(terms, 1))[doc]))
                segment.add(part.column(0), doc, term, gain)
                if segment.postings >= POSTINGS:
                    segment.harvest(items, tops, k)
                    segment = Segment()
        segment.harvest(items, tops, k)
        found = [(i, key.id, score) for i, top in enumerate(tops) for score, key in top if score > 0]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], type=pa.int32()), pa.array([f[1] for f in found], type=as_ids), pa.array([f[2] for f in found], type=pa.int64())], names=["item", "doc_id", "score"])

    return rows.mapInArrow(run, schema)


def blocks(items: DataFrame, id_col: str, text_col: str, most_words: int):
    """Runs of items with about `most_words` words, in the order of a streaming read on the driver."""
    rows, size = [], 0
    for i, text in columns(items, i=id_col, t=text_col).toLocalIterator():
        rows.append((i, text))
        size += len(text or "") // 2
        if size >= most_words:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def search(df: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item."""
    spark = df.sparkSession
    bound_batches(df)
    rows = columns(df, doc_id=id_col, text=text_col)
    item_kind = items.schema[item_id_col].dataType
    named = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", item_kind)])
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    out = None
    for block in blocks(items, item_id_col, item_text_col, block_words):
        shared = Shared(spark, Items([text for _, text in block]))
        best = scored(rows, shared, *counted(rows, shared), k).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], named)
        one = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # a block's items
        out = one if out is None else out.unionByName(one)
    if out is None:
        kind = rows.schema["doc_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {item_kind.simpleString()}, rank int, doc_id {kind}, score long")
    return out
