"""Near-duplicate embeddings by lattice hashing.

Vectors of one label are linked if their cosine, in double precision, reaches a threshold. Candidates come from tables: each projects the
unit vectors to 8 * `blocks` random orthonormal coordinates, shifts and scales them, and decodes every 8 coordinates to the nearest
point of the lattice E8, the densest packing in 8 dimensions. The points of a table are a vector's home cell; the `PROBES` cells that
lie nearest otherwise, each one of the 240 minimal vectors of E8 away, are visited too. Two vectors meet in a cell that is the home of
one at least. The share of pairs at the threshold that a table brings together depends on `blocks` alone (`FOUND`), as cell
sizes follow the threshold and the dimension; the number of tables follows from it, for fewer than `LOST` of pairs at the threshold
not to meet, and far fewer above it. Blocks follow the rows of the largest label, so that strangers rarely meet however many there are.

1. Equal vectors of a label are one node, named by a hash of 128 bits; all below is about nodes.
2. Nodes send their cells (narrow rows); cells in which no two meet are dropped.
3. Of a dense cell the mean direction is a centre. Nodes within half the threshold's angle of one centre are a ball: any two of them are
   linked, by the triangle inequality of angles, so they are counted and never compared. A huge group of near copies is a ball.
4. The others meet in their cells, in blocks of bounded size, and are verified in the task. A pair that shares several cells counts in the
   first only, which both vectors' cells tell. A task passes on, of each node, the number of its links and the smallest node
   that it is connected with there, never the pairs, so what it sends grows with its rows.
5. Links are added up, components found by alternating star steps.

Cells are computed from integers (coordinates rounded to 2^-20 whose products doubles hold exactly), so that they're the same in every task.

Defined cases: vectors that are null, empty, zero or with null or non-finite components, and those without a label, link with nothing, as do
vectors of different lengths; repeated rows are linked with each other; a null id never names a component that has another; rows
of one id are each on their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolith.llm._bytes import bound_batches, columns, mix
from photolith.llm._store import drop, stored_compact
from photolith.llm._vectors import lengths, matrix
from photolith.llm.near_dup import components, loose

THRESHOLD = 0.93
PROBES = 4
LOST = 0.0005
#: By blocks: the width of a cell, for 64 dimensions and a cosine of 0.93, and the share of pairs at the threshold that one table finds (measured).
WIDTH = {2: 0.3, 3: 0.35, 4: 0.35}
FOUND = {2: 0.57, 3: 0.40, 4: 0.24}
#: The most rows of a label for so many blocks; strangers that a vector meets: about rows / 120, / 900 and / 20,000.
ROWS = {2: 1 << 12, 3: 1 << 17}
BLOCK = 512
DENSE = 256
PAIRS = 1 << 14
MARGIN = 1e-6
FINE = float(1 << 20)


def _minimal() -> np.ndarray:
    """The 240 minimal vectors of E8."""
    out = [np.bincount([i, j], [s, t], 8) for i, j in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    return np.array(out + [x for x in itertools.product((0.5, -0.5), repeat=8) if np.prod(x) > 0])


MINIMAL = _minimal()


def _even(y: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum: where rounding gives an odd one, the worst coordinate goes the other way."""
    out = np.rint(y)
    off = y - out
    worst = np.abs(off).argmax(axis=1)
    row = np.flatnonzero(out.sum(axis=1) % 2 != 0)
    out[row, worst[row]] += np.where(off[row, worst[row]] >= 0, 1.0, -1.0)
    return out


def decode(y: np.ndarray) -> np.ndarray:
    """The nearest points of E8, which are the integer points with an even sum and those shifted by one half in every coordinate."""
    a, b = _even(y), _even(y - 0.5) + 0.5
    nearer = np.square(y - a).sum(axis=1) <= np.square(y - b).sum(axis=1)
    return np.where(nearer[:, None], a, b)


class Lattice:
    """The tables for vectors of one dimension."""

    def __init__(self, dim: int, threshold: float, blocks: int):
        self.blocks, self.tables = blocks, math.ceil(math.log(LOST) / math.log(1 - FOUND[blocks]))
        rng = np.random.Generator(np.random.PCG64([11, dim, blocks]))
        size = 8 * blocks
        frames = []
        for _ in range(self.tables):
            random = rng.normal(size=(dim, size))
            frames.append(np.linalg.qr(random)[0].T if size <= dim else random.T / math.sqrt(dim))
        self.frames = np.rint(np.concatenate(frames) * FINE)
        width = WIDTH[blocks] * math.sqrt((2 - 2 * threshold) / 0.14) * math.sqrt(64 / dim)
        self.scale = 1 / (FINE * FINE * width)
        self.shift = np.rint(rng.uniform(0, 2, self.tables * size) * FINE) / FINE
        self.code = rng.integers(1, 1 << 62, (self.tables, size), dtype=np.int64) * 2 + 1
        self.salt = rng.integers(1, 1 << 62, self.tables, dtype=np.uint64)

    def cells(self, unit: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The home cell of each unit vector in every table, and its visited ones."""
        n, size = len(unit), 8 * self.blocks
        flat = np.rint((np.rint(unit * FINE) @ self.frames.T) * self.scale * FINE) / FINE + self.shift
        homes = np.empty((n, self.tables), dtype=np.uint64)
        visits = np.empty((n, self.tables, PROBES), dtype=np.uint64)
        for t in range(self.tables):
            y = flat[:, t * size : (t + 1) * size].reshape(n * self.blocks, 8)
            point = decode(y)
            near = ((y - point) @ MINIMAL.T).reshape(n, self.blocks * len(MINIMAL))  # the larger, the nearer
            step = np.argpartition(-near, PROBES, axis=1)[:, :PROBES]
            own = (2 * point).astype(np.int64).reshape(n, size) @ self.code[t]
            away = ((2 * MINIMAL).astype(np.int64) @ self.code[t].reshape(self.blocks, 8).T).T.reshape(-1)
            named = lambda x: mix(mix(x.view(np.uint64) ^ self.salt[t]) ^ (group if x.ndim == 1 else group[:, None]))  # noqa: B023, E731
            homes[:, t] = named(own)
            visits[:, t] = named(own[:, None] + away[step])
        return homes, visits


_lattices: dict[tuple, Lattice] = {}


def lattice(dim: int, threshold: float, blocks: int) -> Lattice:
    """The tables, made once in a task."""
    key = (dim, threshold, blocks)
    if key not in _lattices:
        _lattices[key] = Lattice(*key)
    return _lattices[key]


def units(x: np.ndarray) -> np.ndarray:
    """The vectors at length 1; none is zero."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.square(x).sum(axis=1, keepdims=True))


def valid(vector: str, label: str):
    """Whether a row can link with others."""
    number = lambda x: x.cast("double")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(number(x)) & (F.abs(number(x)) < float("inf")))
    return F.coalesce(F.col(label).isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: number(x) != 0), F.lit(False))


def cells_of(nodes: DataFrame, threshold: float, blocks: int) -> DataFrame:
    """(cell, node, home) of all nodes."""

    def run(batches):
        for batch in batches:
            node, group = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for dim in np.unique(lengths(batch.column(2))).tolist():
                rows, x = matrix(batch.column(2), dim)
                for at in range(0, len(rows), 1024):
                    own = rows[at : at + 1024]
                    homes, visits = lattice(dim, threshold, blocks).cells(units(x[at : at + 1024]), group[own])
                    cell = np.concatenate([homes, visits.reshape(len(own), -1)], axis=1)
                    home = np.arange(cell.shape[1]) < homes.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(cell.reshape(-1).view(np.int64)), pa.array(np.repeat(node[own], cell.shape[1])), pa.array(np.tile(home, len(own)))], names=["cell", "node", "home"])

    return nodes.select("node", "grp", "vector").mapInArrow(run, "cell long, node long, home boolean")


def balls_of(members: DataFrame, sizes: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, ball): for nodes within half the threshold's angle of a dense cell's mean direction, the cell, of several the largest."""
    reach = math.cos(math.acos(threshold) / 2 - MARGIN)
    dense = sizes.filter(F.col("homes") > DENSE).select("cell", "homes")
    rows = loose(members, "cell").join(loose(dense, "cell"), "cell").join(nodes.select("node", "vector"), "node").select("cell", "homes", "node", "home", "vector")

    def sums(batches):
        for batch in batches:
            for dim in np.unique(lengths(batch.column(1))).tolist():
                at, x = matrix(batch.column(1), dim)
                cells, which = np.unique(batch.column(0).to_numpy()[at], return_inverse=True)
                total = np.zeros((len(cells), dim))
                np.add.at(total, which, units(x))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cells, dim)), pa.array(np.tile(np.arange(dim, dtype=np.int32), len(cells))), pa.array(total.reshape(-1))], names=["cell", "i", "x"])

    parts = rows.filter("home").select("cell", "vector").mapInArrow(sums, "cell long, i int, x double")
    centres = parts.groupBy("cell", "i").agg(F.sum("x").alias("x")).groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("i", "x")))["x"].alias("centre"))

    def near(batches):
        for batch in batches:
            for dim in np.unique(lengths(batch.column(3))).tolist():
                at, x = matrix(batch.column(3), dim)
                same, c = matrix(batch.column(4).take(pa.array(at)), dim)
                size = np.abs(c).max(axis=1, initial=0)
                same, c, x, at = same[size > 0], c[size > 0], x[same][size > 0], at[same][size > 0]
                held = at[(units(x) * units(c)).sum(axis=1) >= reach] if len(at) else at
                yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(held)) for k in range(3)], names=["node", "cell", "homes"])

    placed = loose(rows, "cell").join(loose(centres, "cell"), "cell").select("node", "cell", "homes", "vector", "centre").mapInArrow(near, "node long, cell long, homes long")
    return placed.groupBy("node").agg(F.max_by("cell", F.struct("homes", "cell")).alias("ball"))


def _canonical(cells: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The cell in which each pair counts: the first table's in which one is at home and the other too, or visiting."""
    homes, visits = cells
    out, open_ = np.zeros(len(i), dtype=np.uint64), np.ones(len(i), dtype=bool)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    for t in range(homes.shape[1]):
        left = np.flatnonzero(open_)
        if not len(left):
            break
        a, b = i[left], j[left]
        x, y = homes[a, t], homes[b, t]
        at_x = (x == y) | (visits[b, t] == x[:, None]).any(axis=1)
        at_y = (visits[a, t] == y[:, None]).any(axis=1)
        best = np.minimum(np.where(at_x, x, none), np.where(at_y, y, none))
        out[left] = best
        open_[left] = ~(at_x | at_y)
    return out


class Slab:
    """Rows of cells (or of a pair of blocks of one) that lie together: their links, by pairs that meet in a cell."""

    def __init__(self, rows: pa.Table, dim: int, threshold: float, blocks: int):
        column = lambda name: rows.column(name).to_numpy()
        self.dim, self.threshold, self.blocks = dim, threshold, blocks
        self.cell, self.node, self.side = column("cell").view(np.uint64), column("node"), column("side")
        self.group, self.home, self.major = column("grp").view(np.uint64), column("home").astype(bool), column("major").astype(bool)
        self.ball, self.copies = rows.column("ball").to_numpy(), column("copies")  # a ball of 0: none
        part = np.stack([column("cell"), column("bx"), column("by")])
        self.cut = np.concatenate(([0], np.flatnonzero((part[:, 1:] != part[:, :-1]).any(axis=0)) + 1, [len(self.node)]))
        self.unit = units(matrix(rows.column("vector").combine_chunks(), dim)[1])

    def pairs(self):
        """Arrays of pairs that may be links, and their cosines: those of small cells as lists, of large ones as a matrix product."""
        lists, size = [], 0
        for a, b in zip(self.cut[:-1].tolist(), self.cut[1:].tolist(), strict=True):
            both = bool(self.side[a] == 2)
            middle = b if both else a + int(np.searchsorted(self.side[a:b], 1))
            n = (b - a) * (b - a) if both else (middle - a) * (b - middle)
            if n >= PAIRS // 4:
                left, right = (slice(a, b), slice(a, b)) if both else (slice(a, middle), slice(middle, b))
                cosine = self.unit[left] @ self.unit[right].T
                i, j = np.nonzero(cosine >= self.threshold)
                cosine, i, j = cosine[i, j], i + left.start, j + right.start
                keep = i < j if both else i >= 0
                yield i[keep], j[keep], cosine[keep]
                continue
            if both:
                i, j = np.triu_indices(b - a, 1)
                i, j = i + a, j + a
            else:
                i, j = np.repeat(np.arange(a, middle), b - middle), np.tile(np.arange(middle, b), middle - a)
            lists.append((i, j))
            size += len(i)
            if size >= PAIRS:
                yield self._listed(lists)
                lists, size = [], 0
        if lists:
            yield self._listed(lists)

    def _listed(self, lists: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j = (np.concatenate(x) for x in zip(*lists, strict=True))
        may = self.home[i] | self.home[j]
        i, j = i[may], j[may]
        return i, j, np.einsum("ij,ij->i", self.unit[i], self.unit[j])

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node, links, root) of the nodes with links here: the links that count here, and the smallest node that it is connected with."""
        count, root = np.zeros(len(self.node), dtype=np.int64), self.node.copy()
        found = []
        for i, j, cosine in self.pairs():
            ok = (cosine >= self.threshold) & (self.home[i] | self.home[j]) & (self.group[i] == self.group[j])
            ok &= (self.ball[i] == 0) | (self.ball[i] != self.ball[j])
            ok &= (self.side[i] == 2) | self.major[j] | (self.node[i] < self.node[j])
            if ok.any():
                found.append((i[ok], j[ok]))
        if not found:
            z = np.zeros(0, dtype=np.int64)
            return z, z, z
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        used = np.unique(np.concatenate([i, j]))
        cells = lattice(self.dim, self.threshold, self.blocks).cells(self.unit[used], self.group[used])
        for at in range(0, len(i), PAIRS):
            a, b = i[at : at + PAIRS], j[at : at + PAIRS]
            here = _canonical(cells, np.searchsorted(used, a), np.searchsorted(used, b)) == self.cell[a]
            np.add.at(count, a[here], self.copies[b[here]])
            np.add.at(count, b[here], self.copies[a[here]])
        while True:
            least = np.minimum(root[i], root[j])
            if (least == root[i]).all() and (least == root[j]).all():
                return self.node[used], count[used], root[used]
            np.minimum.at(root, i, least)
            np.minimum.at(root, j, least)


def dealt(members: DataFrame, sizes: DataFrame, balls: DataFrame | None, nodes: DataFrame) -> DataFrame:
    """The members with their vectors, dealt to blocks where cells are large: of those, what isn't in the cell's largest ball meets all."""
    if balls is None:
        members = members.withColumn("ball", F.lit(0).cast("long"))
    else:
        members = members.join(balls, "node", "left").withColumn("ball", F.coalesce("ball", F.lit(0).cast("long")))
    large = sizes.filter(F.col("n") > BLOCK).select("cell", "n")
    inside = loose(members.filter("ball <> 0"), "cell").join(loose(large, "cell"), "cell").groupBy("cell", "ball").agg(F.count(F.lit(1)).alias("k"))
    largest = inside.groupBy("cell").agg(F.max_by("ball", F.struct("k", "ball")).alias("top"), F.max("k").alias("k"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    plan = large.join(largest, "cell", "left").select("cell", F.coalesce("top", F.lit(0)).alias("top"), blocks(F.col("n")).alias("all"), blocks(F.col("n") - F.coalesce("k", F.lit(0))).alias("rest"))
    rows = loose(members, "cell").join(loose(plan, "cell"), "cell", "left")
    zero = F.lit(0)
    whole = rows.filter("all IS NULL").select("cell", "node", "home", "ball", F.lit(False).alias("major"), F.lit(2).alias("side"), zero.alias("bx"), zero.alias("by"))
    split = rows.filter("all IS NOT NULL AND rest > 0").withColumn("major", F.expr("ball <> 0 AND ball = top"))
    deal = lambda n: F.pmod(F.xxhash64("node", F.lit(5)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = split.filter("NOT major").select("cell", "node", "home", "ball", "major", F.lit(0).alias("side"), deal("rest").alias("bx"), every("all").alias("by"))
    right = split.select("cell", "node", "home", "ball", "major", F.lit(1).alias("side"), every("rest").alias("bx"), deal("all").alias("by"))
    return whole.unionByName(left).unionByName(right).join(nodes.select("node", "grp", "copies", "vector"), "node")


def compared(rows: DataFrame, threshold: float, blocks: int) -> DataFrame:
    """(node, links, root) by the task's cells."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def out(table: pa.Table):
            dims = lengths(table.column("vector").combine_chunks())
            for dim in np.unique(dims).tolist():  # the vectors of a cell have one length
                node, links, root = Slab(table.filter(pa.array(dims == dim)), dim, threshold, blocks).links()
                if len(node):
                    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(root)], names=["node", "links", "root"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            part = np.stack([table.column(c).to_numpy() for c in ("cell", "bx", "by")])
            last = np.flatnonzero((part[:, 1:] != part[:, :-1]).any(axis=0))
            if len(last):  # all but the last cell is whole
                yield from out(table.slice(0, last[-1] + 1))
                held = table.slice(last[-1] + 1).combine_chunks().to_batches()
        if held:
            yield from out(pa.Table.from_batches(held))

    order = ["cell", "bx", "by"]
    return rows.select(*order, "side", "node", "home", "major", "ball", "grp", "copies", "vector").repartition(*order).sortWithinPartitions(*order, "side", "node").mapInArrow(run, "node long, links long, root long")


def link_counts(df: DataFrame, threshold: float = THRESHOLD, blocks: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row. blocks: 2 to 4; without it they follow the rows of the largest label."""
    bound_batches(df)
    spark = df.sparkSession
    rows = columns(df, vec_id=id_col, vector=vector_col, label=label_col)
    known = valid("vector", "label")
    keyed = rows.select("vec_id", "vector", "label", F.when(known, F.xxhash64("label", "vector")).alias("h"), F.when(known, F.xxhash64(F.lit(1), "vector", "label")).alias("g"))
    nodes = keyed.filter("h IS NOT NULL").groupBy("h", "g").agg(F.first("vector").alias("vector"), F.first("label").alias("label"), F.min("vec_id").alias("name"), F.count(F.lit(1)).alias("copies"))
    made: list[DataFrame] = []

    def kept(x: DataFrame) -> DataFrame:
        made.append(stored_compact(x, "lattice"))
        return made[-1]

    nodes = kept(nodes.select(F.monotonically_increasing_id().alias("node"), "h", "g", "name", "copies", "vector", F.xxhash64("label", F.size("vector")).alias("grp")))
    if blocks is None:
        most = nodes.groupBy("grp").count().agg(F.max("count")).head()[0] or 0
        blocks = next((b for b, limit in ROWS.items() if most <= limit), 4)
    sent = kept(cells_of(nodes, threshold, blocks))
    sizes = kept(sent.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("home").cast("long")).alias("homes")).filter("n > 1 AND homes > 0"))
    members = kept(loose(sent, "cell").join(loose(sizes.select("cell"), "cell"), "cell"))
    balls = None
    if not sizes.filter(F.col("homes") > DENSE).isEmpty():
        balls = kept(balls_of(members, sizes, nodes, threshold))
    found = kept(compared(dealt(members, sizes, balls, nodes), threshold, blocks))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    if balls is not None:
        inside = balls.join(nodes.select("node", "copies"), "node")
        whole = inside.groupBy("ball").agg(F.sum("copies").alias("inside"), F.min("node").alias("first"))
        inside = kept(loose(inside, "ball").join(loose(whole, "ball"), "ball").select("node", (F.col("inside") - F.col("copies")).alias("links"), "first"))
        links = links.unionByName(inside.select("node", "links")).groupBy("node").agg(F.sum("links").alias("links"))
        edges = edges.unionByName(inside.filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")))
    joined = nodes.select("node", "h", "g", "name", "copies").join(links, "node", "left").join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = joined.groupBy("root").agg(F.min("name").alias("component"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    solved = loose(joined, "root").join(loose(named, "root"), "root", "left").select("h", "g", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "name").alias("component"))
    solved = stored_compact(solved.filter("n > 0"), "lattice-links")
    drop(*made)
    other = loose(solved, "h").withColumnRenamed("h", "h2").withColumnRenamed("g", "g2")
    out = keyed.select("vec_id", "h", "g").join(other, (F.col("h") == F.col("h2")) & (F.col("g") == F.col("g2")), "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
