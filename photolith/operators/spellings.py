"""The nearest spellings of names among those there are.

Nearness is the share of characters in longest matching blocks, 2 M / T: the longest block that both texts have, then the longest ones to its left and to
its right, and so on (`difflib.SequenceMatcher`). It can't be found by an index: at a share of 0.6 two names needn't have two letters in a row
in common. What bounds it from above is the letters that both have, each as often as both have it. So names and options are dealt to a
grid of cells of bounded size; in a cell the bound is taken for a name and all options at once, from arrays of letter counts, and only
options whose bound reaches the cutoff, and the worst of the best found so far, are compared, the most promising ones first. Cells pass on
their best, of which the best are kept.

Defined cases: null names and options take no part; names and options count once each; equally near options are in descending order; an empty name is near an
empty option only; a name near to nothing has no rows.
"""

from __future__ import annotations

import heapq
from difflib import SequenceMatcher
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTOFF, BEST = 0.6, 3
CELL = 4096
#: Letters are counted in so many columns, by code point; letters that share one only make the bound weaker.
LETTERS = 64
MOST_TASKS = 10_000


def options_in(text: Column) -> Column:
    """The long options that a program's help names, each once, in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("(--[a-zA-Z0-9][a-zA-Z0-9-]*)"), F.lit(1))))


def letter_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(texts, LETTERS) how often each has letters of each column, and the lengths."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    flat = np.repeat(np.arange(len(texts)), sizes) * LETTERS + points % LETTERS
    return np.bincount(flat, minlength=len(texts) * LETTERS).reshape(len(texts), LETTERS), sizes


def _best(name: str, own: np.ndarray, options: list[str], counts: np.ndarray, sizes: np.ndarray, cutoff: float, best: int) -> list[tuple[float, str]]:
    """The nearest options of one cell, the nearest first."""
    total = sizes + len(name)
    bound = 2 * np.minimum(counts, own).sum(axis=1) / np.maximum(total, 1)
    bound[total == 0] = 1.0
    near = np.flatnonzero(bound >= cutoff)
    found: list[tuple[float, str]] = []
    matcher = SequenceMatcher()
    matcher.set_seq2(name)
    for i in near[np.argsort(-bound[near], kind="stable")].tolist():
        if len(found) == best and bound[i] < found[0][0]:
            break
        matcher.set_seq1(options[i])
        entry = (matcher.ratio(), options[i])
        if entry[0] < cutoff:
            continue
        if len(found) < best:
            heapq.heappush(found, entry)
        elif entry > found[0]:
            heapq.heapreplace(found, entry)
    return sorted(found, reverse=True)


def closest(names: DataFrame, options: DataFrame, best: int = BEST, cutoff: float = CUTOFF) -> DataFrame:
    """(name, rank, option, nearness): the `best` nearest options (option) of each name (name), from the cutoff on."""
    x, y = names.select("name").filter("name IS NOT NULL").distinct(), options.select("option").filter("option IS NOT NULL").distinct()
    rows, columns = max(1, ceil(x.count() / CELL)), max(1, ceil(y.count() / CELL))
    at = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    x = x.select(F.col("name").alias("t"), at("name", rows).alias("row"), every(columns).alias("column"), F.lit(1).alias("side"))
    y = y.select(F.col("option").alias("t"), every(rows).alias("row"), at("option", columns).alias("column"), F.lit(0).alias("side"))

    def run(batches):
        cell, held, counts, sizes = None, [], None, None
        for batch in batches:
            out = []
            columns = [batch.column(k).to_pylist() for k in range(4)]
            for text, row, column, side in zip(*columns, strict=True):
                if (row, column) != cell:
                    cell, held, counts = (row, column), [], None
                if side == 0:
                    held.append(text)
                    continue
                if counts is None:
                    counts, sizes = letter_counts(held)
                out += [(text, option, nearness) for nearness, option in _best(text, letter_counts([text])[0][0], held, counts, sizes, cutoff, best)]
            arrays = [pa.array([o[k] for o in out], type=t) for k, t in enumerate((pa.string(), pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["name", "option", "nearness"])

    cells = x.unionByName(y).repartition(max(1, min(rows * columns, MOST_TASKS)), "row", "column").sortWithinPartitions("row", "column", "side")
    found = cells.select("t", "row", "column", "side").mapInArrow(run, "name string, option string, nearness double")
    order = Window.partitionBy("name").orderBy(F.col("nearness").desc(), F.col("option").desc())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best).select("name", "rank", "option", "nearness")
