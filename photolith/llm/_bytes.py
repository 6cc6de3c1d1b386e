"""Vectorised text primitives over the UTF-8 buffers of Arrow string columns.

All word rules here separate words by ASCII characters only, so they can be applied to UTF-8 bytes:
every byte of a non-ASCII code point is >= 0x80 and belongs to a word. Work is done in slices of a
few MB, so memory depends on the slice and the longest single text, never on a partition.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20
ARROW_BYTES = 4 << 20
CHUNK = 1 << 18

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C17)
BASE_INV = np.uint64(pow(0x9E3779B97F4A7C17, -1, 2**64))
WORD_BASE = np.uint64(0xD6E8FEB86659FD95)
WORD_BASE_INV = np.uint64(pow(0xD6E8FEB86659FD95, -1, 2**64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
KEEP = np.arange(256, dtype=np.uint8)

#: Words between ASCII white space: [^\x20\x09-\x0D]+
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Words of ASCII letters and digits and any non-ASCII character: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing
ALNUM = np.ones(256, dtype=bool)
ALNUM[:0x30] = ALNUM[0x3A:0x41] = ALNUM[0x5B:0x61] = ALNUM[0x7B:0x80] = False

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, inverse: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and inverse**i modulo 2**64 for i <= n."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) <= n:
        size = 1 << max(16, int(n).bit_length())
        out = []
        for b in (base, inverse):
            a = np.ones(size, dtype=np.uint64)
            a[1:] = b
            out.append(np.cumprod(a))
        have = _powers[int(base)] = (out[0], out[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, end to end, and the len + 1 offsets of its values (null: empty)."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, dtype=np.int64)
    data = column.buffers()[2]
    if data is None or not len(offsets) or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold about `limit` bytes; a longer text stands alone."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, start = np.concatenate(([0], np.cumsum(sizes))), 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(total, total[start] + limit, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text: str = "text") -> DataFrame:
    """Apply `fn` to bounded slices of each partition's rows."""
    bound_batches(df)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                yield fn(part)

    return df.mapInArrow(run, schema)


def bound_batches(df: DataFrame) -> None:
    """Limit the Arrow batches that go to Python by bytes, not only by rows, since texts may be long; a lower limit stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = df.sparkSession.conf.get(key, None)
    if have is None or not have.isdigit() or int(have) > ARROW_BYTES:
        df.sparkSession.conf.set(key, str(ARROW_BYTES))


def segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of each segment; those of floats are summed each on its own, so a long neighbour costs no precision."""
    if values.dtype.kind in "bui":
        total = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(values, dtype=np.int64)))
        return total[bounds[1:]] - total[bounds[:-1]]
    out = np.zeros(len(bounds) - 1)
    filled = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(filled):
        out[filled] = np.add.reduceat(values.astype(np.float64, copy=False), bounds[:-1][filled])
    return out


def spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of member bytes; runs end at the ends of texts."""
    if not len(data):
        z = np.zeros(0, dtype=np.int64)
        return z, z
    inside = member[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = KEEP) -> np.ndarray:
    """A 64-bit hash of each span's bytes (spans in order, not overlapping), in chunks of bounded size."""
    out = np.zeros(len(starts), dtype=np.uint64)
    code = BYTE_CODE[fold]
    at = 0
    while at < len(starts):
        origin = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, origin + CHUNK, side="right")))
        piece = code[data[origin : ends[stop - 1]]]
        up, down = powers(BASE, BASE_INV, len(piece))
        piece *= up[: len(piece)]
        total = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(piece, out=total[1:])
        s, e = starts[at:stop] - origin, ends[at:stop] - origin
        out[at:stop] = (total[e] - total[s]) * down[s]
        at = stop
    return mix(out)


class Words:
    """The words of the texts of a column: hash, start and end of each, and the len + 1 bounds of each text's words."""

    def __init__(self, column: pa.Array, member: np.ndarray = SPACED, fold: np.ndarray = KEEP):
        self.data, self.offsets = text_buffer(column)
        self.start, self.end = spans(self.data, self.offsets, member)
        self.hash = span_hashes(self.data, self.start, self.end, fold)
        self.bounds = np.searchsorted(self.start, self.offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def windows(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each window of `size` words inside one text, and the windows' hashes."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    up, down = powers(WORD_BASE, WORD_BASE_INV, n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * up[:n], out=total[1:])
    ok = np.ones(n - size + 1, dtype=bool)
    cuts = bounds[1:-1]
    for back in range(1, size):
        at = cuts - back
        ok[at[(at >= 0) & (at < len(ok))]] = False
    first = np.flatnonzero(ok)
    return first, mix((total[first + size] - total[first]) * down[first])


def owner(bounds: np.ndarray) -> np.ndarray:
    """For each item the number of the text that holds it."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def columns(df: DataFrame, **kept: str) -> DataFrame:
    """Only the named columns, under the operator's own names."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in kept.items()])


def with_own_id(result: str, df: DataFrame, id_col: str) -> str:
    """The schema text `result` with its first column, the id, in the type that `df` has it."""
    name, *rest = result.split(", ")
    return ", ".join([f"{name.split()[0]} {df.schema[id_col].dataType.simpleString()}", *rest])


class Shared:
    """A broadcast object of this package's own classes, which workers need not be able to import."""

    def __init__(self, spark: SparkSession, value):
        self._sent, self._value = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    def __getstate__(self) -> dict:
        return {"_sent": self._sent, "_value": None}

    @property
    def value(self):
        if self._value is None:
            self._value = self.load()
        return self._value

    def load(self):
        """The object anew, not kept."""
        return pickle.loads(self._sent.value)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, longer by underscores where `df` has them, for helper columns beside a caller's own."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan's rows dealt over all cores, where it has fewer splits than there are cores; else `df` itself.

    A file of one row group is one task however large it is. Work in Python costs a hundred times what dealing texts out costs, so
    this pays where cores would idle; where there are splits enough, as on any large table, nothing is shuffled. For plain scans: the
    plan of anything else would have to run before its partitions are known.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
