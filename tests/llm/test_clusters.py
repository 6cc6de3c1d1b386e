import hashlib
import math
import random
from fractions import Fraction

import numpy as np

from photolith.llm import clusters as C

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=16, rounds=3, dim=64):
    """The definition in Python's own integers."""
    kept = [(i, [math.floor(Fraction(float(np.float32(x))) * 64) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) and abs(x) < 2**21 for x in v)]
    key = lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "~", r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own) if o == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [(i, *nearest(v)) for i, v in kept]
    of = lambda n: sum(d for _, d, m in last if m == n)
    total = sum(d for _, d, _ in last)
    return sorted([(i, n, d, of(n), total, hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, d, n in last], key=str)


def got(spark, rows, **more):
    return sorted([tuple(r) for r in C.cluster(spark.createDataFrame(rows, SCHEMA), **more).collect()], key=str)


def test_equals_the_definition(spark):
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(9, 64))
    rows = [(k, (middles[k % 9] + 0.3 * rng.normal(size=64)).astype(np.float32).tolist()) for k in range(400)]
    assert got(spark, rows) == brute(rows)


def test_ties_go_to_the_smaller_number(spark):
    rng = random.Random(2)
    rows = [(k, [float(rng.choice([0, 1]))] * 2 + [0.0] * 62) for k in range(60)]  # very few different vectors: many equal centroids
    assert got(spark, rows) == brute(rows)


def test_large_components_overlap_and_are_settled_in_integers(spark):
    rng = np.random.default_rng(3)
    rows = [(k, (np.float32(1 << 20) + rng.integers(-2, 3, 64)).astype(np.float32).tolist()) for k in range(80)]
    assert got(spark, rows) == brute(rows)


def test_intervals_hold_the_exact_distance():
    rng = np.random.default_rng(4)
    for size in (10, 1 << 12, 1 << 20, 1 << 27):
        x, c = rng.integers(-size, size, (200, 64)), rng.integers(-size, size, (16, 64))
        low, high = C.Screen(c).intervals(x)
        for i in range(0, 200, 7):
            for j in range(16):
                true = sum(int(v) ** 2 for v in c[j]) - 2 * sum(int(a) * int(b) for a, b in zip(x[i], c[j]))
                assert Fraction(float(low[i, j])) <= true <= Fraction(float(high[i, j]))


def test_rows_that_are_not_kept(spark):
    v = [0.5] * 64
    rows = [(1, v), (2, None), (3, []), (4, v[:63]), (5, v + [0.5]), (6, v[:63] + [None]), (7, v[:63] + [float("nan")]), (8, v[:63] + [float("-inf")]), (9, v[:63] + [float(1 << 21)]), (None, [0.25] * 64), (1, v), (1, [0.75] * 64)]
    found = got(spark, rows)
    assert found == brute(rows) and len(found) == 4
    assert got(spark, rows[1:9]) == [] and got(spark, []) == []


def test_other_columns_and_names(spark):
    df = spark.createDataFrame([(7, [1.0, 2.0], 3), (8, [1.0, 2.5], 3)], "i int, v array<double>, cluster int")
    out = C.cluster(df, k=1, rounds=1, dim=2, id_col="i", vector_col="v")
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((r.vec_id, r.cluster, r.distance) for r in out.collect()) == [(7, 0, 16 * 16), (8, 0, 16 * 16)]
