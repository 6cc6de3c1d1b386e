import itertools
import math
import random

import numpy as np
import pytest

from photolith.llm import lattice as L

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.93):
    """(vec_id, n_links, component_id, kept) by every pair, in plain doubles."""
    n = len(rows)
    fine = [v is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    unit = [np.asarray(v, dtype=float) / math.sqrt(math.fsum(float(x) ** 2 for x in v)) if ok else None for (_, v, _), ok in zip(rows, fine)]
    links, root = [0] * n, list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, j in itertools.combinations([k for k in range(n) if fine[k]], 2):
        if rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= threshold:
            links[i] += 1
            links[j] += 1
            root[find(i)] = find(j)
    least = {}
    for k in range(n):
        ids = [rows[k][0]] if rows[k][0] is not None else []
        least[find(k)] = min(least.get(find(k), []) + ids, default=None, key=lambda x: x)
        least[find(k)] = [] if least[find(k)] is None else [least[find(k)]]
    named = [next(iter(least[find(k)]), None) for k in range(n)]
    return sorted([(rows[k][0], links[k], named[k], rows[k][0] == named[k]) for k in range(n)], key=str)


def got(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted([tuple(r) for r in L.link_counts(df, **more).collect()], key=str)


def near(rng, v, cosine):
    z = rng.normal(size=len(v))
    z -= (z @ v) * v
    return cosine * v + math.sqrt(1 - cosine * cosine) * z / np.linalg.norm(z)


def unit(rng, dim=64):
    v = rng.normal(size=dim)
    return v / np.linalg.norm(v)


def test_decoding_gives_the_nearest_lattice_point():
    assert len(L.MINIMAL) == 240 and np.allclose(np.square(L.MINIMAL).sum(axis=1), 2)
    rng = np.random.default_rng(1)
    y = rng.uniform(-3, 3, (500, 8))
    point = L.decode(y)
    whole = (2 * point).round().astype(int)
    assert ((whole % 2 == whole[:, :1] % 2).all(axis=1) & (point.sum(axis=1) % 2 == 0)).all()
    near = np.square(y[:, None, :] - (point[:, None, :] + L.MINIMAL)).sum(axis=2).min(axis=1)
    assert (np.square(y - point).sum(axis=1) <= near + 1e-9).all()
    assert (np.square(y - point).sum(axis=1) <= 1 + 1e-9).all()  # the covering radius of E8 is 1


@pytest.mark.parametrize("blocks", [2, 3, 4])
@pytest.mark.parametrize(("dim", "threshold"), [(64, 0.93), (128, 0.93), (64, 0.8)])
def test_pairs_at_the_threshold_meet(blocks, dim, threshold):
    rng = np.random.default_rng(blocks)
    x = np.array([unit(rng, dim) for _ in range(1000)])
    y = np.array([near(rng, v, threshold) for v in x])
    tables, group = L.lattice(dim, threshold, blocks), np.zeros(1000, dtype=np.uint64)
    (hx, vx), (hy, vy) = tables.cells(x, group), tables.cells(y, group)
    met = (hx == hy) | (vx == hy[:, :, None]).any(axis=2) | (vy == hx[:, :, None]).any(axis=2)
    assert met.mean() >= L.FOUND[blocks] - 0.05
    assert met.any(axis=1).mean() >= 1 - 5 * L.LOST


def test_cells_do_not_depend_on_the_batch():
    rng = np.random.default_rng(3)
    x = L.units(np.array([unit(rng) for _ in range(300)], dtype=np.float32).astype(float))
    group = np.arange(300, dtype=np.uint64)
    homes, visits = L.lattice(64, 0.93, 2).cells(x, group)
    for at in (0, 7, 299):
        h, v = L.lattice(64, 0.93, 2).cells(x[at : at + 1], group[at : at + 1])
        assert (h[0] == homes[at]).all() and set(v[0].reshape(-1)) == set(visits[at].reshape(-1))


@pytest.mark.parametrize("blocks", [None, 3])
def test_links_equal_all_pairs(spark, blocks):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(120):
        v = unit(rng)
        rows.append((10 * k, v.tolist(), k % 3))
        for i in range(k % 4):
            rows.append((10 * k + i + 1, near(rng, v, rng.choice([0.91, 0.94, 0.96, 0.99])).tolist(), k % 3 if i < 2 else (k + 1) % 3))
    assert got(spark, rows, blocks=blocks) == brute(rows)


def test_a_dense_group_is_counted_as_a_ball(spark, monkeypatch):
    monkeypatch.setattr(L, "DENSE", 20)
    monkeypatch.setattr(L, "BLOCK", 32)
    rng = np.random.default_rng(6)
    v, w = unit(rng), unit(rng)
    rows = [(k, near(rng, v, rng.choice([0.97, 0.985, 0.995])).tolist(), 1) for k in range(300)]
    rows += [(1000 + k, near(rng, w, 0.96).tolist(), 1) for k in range(100)]  # too wide for a ball
    rows += [(2000 + k, near(rng, v, 0.93).tolist(), 1) for k in range(30)]  # at the ball's edge
    assert got(spark, rows) == brute(rows)


def test_hot_copies_and_odd_rows(spark):
    rng = np.random.default_rng(7)
    v = unit(rng).astype(np.float32).tolist()
    rows = [(k, v, 1) for k in range(2000)] + [(5000, near(rng, np.array(v), 0.97).tolist(), 1), (5001, v, 2), (5002, v, None), (3, v, 1), (None, v, 1), (None, v, 7)]
    found = got(spark, rows)
    by = {}
    for r in found:
        by.setdefault(r[0], []).append(r[1:])
    assert by[0] == [(2002, 0, True)] and by[5000] == [(2002, 0, False)] and by[5001] == [(0, 5001, True)] and by[5002] == [(0, 5002, True)]
    assert by[3] == [(2002, 0, False)] * 2 and sorted(by[None], key=str) == [(0, None, True), (2002, 0, False)]


def test_undefined_vectors_link_with_nothing(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0, 0.0], 1), (4, [1.0, None, 3.0], 1), (5, [1.0, float("nan"), 3.0], 1), (6, [1.0, float("inf"), 3.0], 1), (7, v, 1), (8, [2.0, 4.0, 6.0], 1), (9, [1.0, 2.0, 3.0, 0.0], 1), (10, v, None), (11, v, None)]
    rows += [(12, None, 1), (13, [0.0, 0.0, 0.0], 1)]
    assert got(spark, rows) == brute(rows)
    assert {r[0]: r[1] for r in got(spark, rows)}[8] == 1


def test_extreme_sizes_of_components(spark):
    big, small = [1e300, 1e300], [1e-300, 1.1e-300]
    df = spark.createDataFrame([(1, big, "a"), (2, small, "a"), (3, [1e300, -1e300], "a")], "vec_id long, embedding array<double>, label string")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in L.link_counts(df).collect()) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]


def test_empty_tables_other_columns_and_names(spark):
    assert got(spark, []) == []
    df = spark.createDataFrame([(1, [1.0, 0.0], 1, 9, "x"), (2, [1.0, 0.0], 1, 9, "y")], "i long, v array<double>, l int, node int, cell string")
    out = L.link_counts(df, id_col="i", vector_col="v", label_col="l")
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_other_thresholds(spark):
    rng = np.random.default_rng(9)
    rows = []
    for k in range(60):
        v = unit(rng)
        rows += [(2 * k, v.tolist(), 0), (2 * k + 1, near(rng, v, 0.75 if k % 2 else 0.85).tolist(), 0)]
    random.Random(1).shuffle(rows)
    assert got(spark, rows, threshold=0.8) == brute(rows, 0.8)
