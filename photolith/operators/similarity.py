"""Hashes within a Hamming distance.

Distinct hashes of both sides meet, never rows: copies of a hash cost nothing and come back by a join at the end. A hash
is cut into bands with a radius each, such that two hashes within the threshold are within the radius in at least one
band (the radii plus one add up to more than the threshold). The left side looks up every value within the radius of its band's
value, the right side only its own. Few long bands with large radii make many look-ups and few chance meetings, many
short ones the opposite; the numbers of hashes decide which costs least.

A pair that meets by a band is a row of a join, which costs some hundred times what comparing two words of memory does. So where bands
would meet a large part of all pairs (from a threshold of about 14 of 64 bits, as no band tells random hashes apart then, and no pivot does), nothing
meets: hashes are dealt out to a grid of cells of bounded size, and a task takes the exclusive or of whole arrays of a cell
and counts bits. Only pairs within the threshold become rows. That costs left x right comparisons, of about a nanosecond each, no more memory and no
hot task.

Hashes are 64-bit longs, or arrays of their hexadecimal digits' number and 64-bit words (`values.hash_words`); only hashes of equal length are
compared. Rows without a hash have no partners. Hashes of more than 16 digits meet by the word that differs least.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = 64
MOST_MASKS = 1 << 16
CELL = 1 << 14
#: What comparing two hashes in memory costs, a row of a join being 1.
COMPARED = 0.01
#: The most partitions that cells are dealt to.
MOST_TASKS = 10_000
#: The most pairs in a batch of results.
FOUND = 1 << 16


def bands(width: int, threshold: int, count: int) -> list[tuple[int, int, int]]:
    """(low, high, radius) of each of `count` bands of `width` bits."""
    edges = [width * i // count for i in range(count + 1)]
    spare = threshold - count + 1
    return [(low, high, min(spare // count + (i < spare % count), high - low)) for i, (low, high) in enumerate(zip(edges, edges[1:], strict=False))]


def _volume(low: int, high: int, radius: int) -> int:
    return sum(comb(high - low, k) for k in range(radius + 1))


def cheapest(width: int, threshold: int, left: int, right: int) -> list[tuple[int, int, int]] | None:
    """The bands that cost least for so many hashes, or None where comparing every pair in memory costs less than any."""
    best, plan = COMPARED * left * right + left * ceil(right / CELL) + right * ceil(left / CELL), None
    for count in range(1, min(threshold + 1, width) + 1):
        cut = bands(width, threshold, count)
        looked_up = sum(_volume(*b) for b in cut)
        met = left * right * sum(_volume(*b) / 2 ** (b[1] - b[0]) for b in cut)
        cost = 4 * (left * looked_up + right * count) + met
        if looked_up <= MOST_MASKS and cost < best:
            best, plan = cost, cut
    return plan


def _signed(x: int) -> int:
    return x - (1 << WORD) if x >> (WORD - 1) else x


def _masks(low: int, high: int, radius: int) -> Column:
    """All changes of up to `radius` bits of a band, as an array that is made once."""
    changes = [_signed(sum(1 << bit for bit in chosen)) for k in range(radius + 1) for chosen in combinations(range(low, high), k)]
    return F.from_json(F.lit(json.dumps(changes)), "array<bigint>")


def _part(word: Column, low: int, high: int) -> Column:
    return word.bitwiseAND(F.lit(_signed(((1 << high) - 1) ^ ((1 << low) - 1))))


def _as_words(bits: Column, kind: T.DataType) -> Column:
    return bits if isinstance(kind, T.ArrayType) else F.array(F.lit(16).cast("bigint"), bits)


def distance(left: Column, right: Column) -> Column:
    """Bits that differ between two arrays of words of one length."""
    return F.aggregate(F.zip_with(left, right, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda acc, n: acc + n)


def _words(column: pa.Array) -> np.ndarray:
    """The words (rows, words) of hashes that all have one length, without their number of digits."""
    flat = column.flatten().to_numpy().view(np.uint64)
    return flat.reshape(len(column), -1)[:, 1:]


def _within(left: np.ndarray, right: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of the pairs within the threshold, about FOUND at a time."""
    held, size = [], 0
    for i in range(len(left)):
        apart = np.bitwise_count(right[:, 0] ^ left[i, 0])
        for w in range(1, left.shape[1]):
            apart = apart + np.bitwise_count(right[:, w] ^ left[i, w]).astype(np.uint16)
        j = np.flatnonzero(apart <= threshold)
        if len(j):
            held.append((np.full(len(j), i), j, apart[j]))
            size += len(j)
        if size >= FOUND or held and i + 1 == len(left):
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _grid(left: DataFrame, right: DataFrame, digits: int, threshold: int, sizes: tuple[int, int]) -> DataFrame:
    """Every pair of a cell is compared in memory: the left hashes of a cell come first and are held, the right ones stream past them."""
    rows, columns = ceil(sizes[0] / CELL), ceil(sizes[1] / CELL)
    at = lambda h, n: F.pmod(F.xxhash64(h), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    x = left.filter(F.col("l")[0] == digits).select(F.col("l").alias("h"), at("l", rows).alias("row"), every(columns).alias("column"), F.lit(0).alias("side"))
    y = right.filter(F.col("r")[0] == digits).select(F.col("r").alias("h"), every(rows).alias("row"), at("r", columns).alias("column"), F.lit(1).alias("side"))

    def run(batches):
        cell, held, mine = None, [], None
        for batch in batches:
            part = np.stack([batch.column(k).to_numpy() for k in (1, 2, 3)])
            cuts = [0, *(np.flatnonzero((part[:, 1:] != part[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                own, hashes = tuple(part[:2, a]), batch.column(0).slice(a, b - a)
                if own != cell:
                    cell, held, mine = own, [], None
                if part[2, a] == 0:
                    held.append(hashes)
                    continue
                if not held:
                    continue
                if mine is None:
                    ours = pa.concat_arrays(held)
                    mine = _words(ours)
                for i, j, apart in _within(mine, _words(hashes), threshold):
                    yield pa.RecordBatch.from_arrays([ours.take(pa.array(i)), hashes.take(pa.array(j)), pa.array(apart.astype(np.int32))], names=["l", "r", "distance"])

    cells = x.unionByName(y).repartition(max(1, min(rows * columns, MOST_TASKS)), "row", "column").sortWithinPartitions("row", "column", "side")
    return cells.select("h", "row", "column", "side").mapInArrow(run, "l array<bigint>, r array<bigint>, distance int")


def _banded(left: DataFrame, right: DataFrame, digits: int, threshold: int, words: int, cut: list[tuple[int, int, int]]) -> DataFrame:
    own = lambda h, i: F.col(h)[i + 1]
    each = [(i, *b) for i in range(words) for b in cut]
    looked = F.array(*[F.struct(F.lit(n).alias("n"), F.transform(_masks(low, high, radius), lambda m: m.bitwiseXOR(_part(own("l", i), low, high))).alias("values")) for n, (i, low, high, radius) in enumerate(each)])  # noqa: B023
    x = left.filter(F.col("l")[0] == digits).select("l", F.inline(looked)).select("l", F.col("n").alias("band"), F.explode("values").alias("value"))
    kept = F.array(*[_part(own("r", i), low, high) for i, low, high, _ in each])
    y = right.filter(F.col("r")[0] == digits).select("r", F.posexplode(kept).alias("band_", "value_"))
    near = F.array(*[F.bit_count(_part(own("l", i).bitwiseXOR(own("r", i)), low, high)) <= radius for i, low, high, radius in each])
    apart = distance(F.col("l"), F.col("r"))
    first = F.array_position(near, F.lit(True)) == F.col("band") + 1
    return x.join(y, (F.col("band") == F.col("band_")) & (F.col("value") == F.col("value_")) & (apart <= threshold) & first).select("l", "r", apart.alias("distance"))


def near_hashes(left: DataFrame, right: DataFrame, threshold: int, bits: str = "bits") -> DataFrame:
    """(l, r, distance): the pairs of a distinct hash of the left and one of the right table that differ in at most `threshold` bits."""
    kind = left.schema[bits].dataType
    x = left.select(_as_words(F.col(bits), kind).alias("l")).filter(F.col("l").isNotNull() & F.col("l")[1].isNotNull()).distinct()
    y = right.select(_as_words(F.col(bits), right.schema[bits].dataType).alias("r")).filter(F.col("r").isNotNull() & F.col("r")[1].isNotNull()).distinct()
    of = lambda df, c: df.select(F.col(c)[0].alias("d"), F.lit(c).alias("side"))
    sizes = of(x, "l").unionByName(of(y, "r")).groupBy("side", "d").agg(F.count(F.lit(1)).alias("n")).collect()
    xs, ys = ({r.d: r.n for r in sizes if r.side == side} for side in ("l", "r"))
    found = None
    for digits in sorted(set(xs) & set(ys)):
        words = -(-digits // 16)
        width = min(4 * digits, WORD)
        cut = cheapest(width, min(threshold // words, width), xs[digits] * words, ys[digits])
        one = _grid(x, y, digits, threshold, (xs[digits], ys[digits])) if cut is None else _banded(x, y, digits, threshold, words, cut)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = x.select("l", F.col("l").alias("r"), F.lit(0).alias("distance")).limit(0)
    back = lambda c, k: F.col(c) if isinstance(k, T.ArrayType) else F.col(c)[1]
    return found.select(back("l", kind).alias("l"), back("r", right.schema[bits].dataType).alias("r"), "distance")


def pairs_within(left: DataFrame, right: DataFrame, threshold: int, bits: str = "bits", keep: Column | None = None) -> DataFrame:
    """(l, r, distance): structs of a left and a right row whose hashes differ in at most `threshold` bits.

    `keep` is a further condition on l and r. Every two rows are a pair of their own, so many rows of one hash make many pairs: where they only
    need to be known as copies, use `links`.
    """
    near = near_hashes(left, right, threshold, bits).withColumnsRenamed({"l": "l_hash", "r": "r_hash"})
    x, y = left.select(F.struct("*").alias("l"), F.col(bits).alias("l_hash")), right.select(F.struct("*").alias("r"), F.col(bits).alias("r_hash"))
    found = near.join(x, "l_hash").join(y, "r_hash")
    return (found.filter(keep) if keep is not None else found).select("l", "r", "distance")


def links(rows: DataFrame, ident: str, threshold: int, bits: str = "bits") -> DataFrame:
    """(a, b, distance): every two hashes within the threshold, named by their smallest ids, and every further row of a hash with
    that id, at distance 0. Rows without a hash aren't linked."""
    hashed = rows.filter(F.col(bits).isNotNull()).select(F.col(ident).alias("i"), F.col(bits).alias("h"))
    named = hashed.groupBy("h").agg(F.min("i").alias("lead"))
    near = near_hashes(named, named, threshold, "h").filter("l < r")
    x, y = named.select(F.col("h").alias("l"), F.col("lead").alias("x")), named.select(F.col("h").alias("r"), F.col("lead").alias("y"))
    apart = near.join(x, "l").join(y, "r").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")
    again = hashed.withColumnRenamed("h", "h_").join(named.withColumn("h", _dealt(F.col("h"), rows.schema[bits].dataType)), F.col("h") == _dealt(F.col("h_"), rows.schema[bits].dataType))
    return apart.unionByName(again.filter("i <> lead").select(F.col("lead").alias("a"), F.col("i").alias("b"), F.lit(0).alias("distance")))


def _dealt(bits: Column, kind: T.DataType) -> Column:
    """The hash as a key that has no partitioning yet, so that a join deals both sides anew and AQE can split a hot one."""
    return F.to_json(F.struct(bits.alias("h"))) if isinstance(kind, T.ArrayType) else bits + F.lit(0).cast("bigint")
