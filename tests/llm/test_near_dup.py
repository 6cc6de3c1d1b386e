import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from photolith.llm import near_dup as N


def plain_sets(texts):
    """Shingle -> weight of each text, from the definition alone: words, counts, exact document frequencies."""
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    counts = [Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else []) for w in words]
    df, n = Counter(k for c in counts for k in c), len(texts)
    clip = max(2.0, min(256, 2**21 * n / max(sum(map(len, counts)), 1)))
    idf = {k: 1 + 0.25 * math.log(min((1 + n) / (1 + d), clip)) / math.log(clip) for k, d in df.items()}
    return words, [{k: (1 + math.log(m)) * idf[k] for k, m in c.items()} for c in counts]


def plain_similarity(a, b):
    if len(a) > len(b):
        a, b = b, a
    both = sum(min(w, b[k]) for k, w in a.items() if k in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


def brute_classes(rows, threshold=N.THRESHOLD):
    """Class of each row by comparing every pair of different texts that share a shingle."""
    words, sets = plain_sets([t for _, t in rows])
    node = [" ".join(w) if w else None for w in words]
    first = {}
    for i, n in enumerate(node):
        if n is not None:
            first.setdefault(n, i)
    holders, met = defaultdict(list), set()
    for n, i in first.items():
        for k in sets[i]:
            for m in holders[k]:
                met.add((m, n))
            holders[k].append(n)
    root = {n: n for n in first}

    def top(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in met:
        if top(a) != top(b) and plain_similarity(sets[first[a]], sets[first[b]]) >= threshold:
            root[top(a)] = top(b)
    ids, size = defaultdict(list), defaultdict(int)
    for (i, _), n in zip(rows, node, strict=True):
        if n is not None:
            size[top(n)] += 1
            if i is not None:
                ids[top(n)].append(i)
    out = []
    for (i, _), n in zip(rows, node, strict=True):
        out.append((i, i, 1) if n is None else (i, min(ids[top(n)], default=None), size[top(n)]))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string").repartition(3)
    return sorted((tuple(r) for r in N.classes(df).collect()), key=str)


def test_samples_collide_as_often_as_the_sets_are_similar():
    rng = np.random.default_rng(1)
    for size, kind in ((100, N.full_samples), (2000, N.dealt_samples)):
        hits, sims = [], []
        for _ in range(30):
            keys = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            weight = rng.uniform(0.5, 4, len(keys))
            a, b = keys[: int(size * 0.9)], keys[int(size * 0.15) :]
            wa, wb = weight[: int(size * 0.9)], weight[int(size * 0.15) :] * rng.choice([1.0, 1.3], len(b))
            hits.append(np.mean(kind(a, np.log(wa).astype(np.float32)) == kind(b, np.log(wb).astype(np.float32))))
            sims.append(N.similarity((a, wa), (b, wb)))
        assert np.mean(hits) == pytest.approx(np.mean(sims), abs=0.03)


def test_whole_table_against_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in N.classes(docs).collect()), key=str)
    assert got == brute_classes(rows)


def test_larger_table_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in N.classes(docs).collect()), key=str) == brute_classes(rows)


def test_weights_are_those_of_exact_document_frequencies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = [r.text for r in docs.collect()]
    idf = N.idf_of(docs)
    _, sets = plain_sets(texts)
    shingled = N.Shingled(pa.array(texts, type=pa.string()))
    assert len(idf.keys) and all(np.allclose(sorted(shingled.weighted(i, idf)[1]), sorted(s.values())) for i, s in enumerate(sets))


def test_repeated_texts_across_the_limits_of_both_kinds(spark):
    rng = random.Random(8)
    rows = []
    for case, more in enumerate((60, 70, 81, 90, 100, 120)):
        words = [f"c{case}w{rng.randrange(10**9)}" for _ in range(256)]
        rows.append((10 * case, " ".join(words * 3)))
        rows.append((10 * case + 1, " ".join(words * 3 + [f"c{case}n{i}" for i in range(more)])))
    rows += [(1000 + i, f"filler {i} " + " ".join(f"f{i}x{j}" for j in range(30))) for i in range(100)]
    got = run(spark, rows)
    assert got == brute_classes(rows)
    assert {i: c for i, c, _ in got}[31] == 30


def test_blocks_of_a_large_bucket_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 3)
    rng = random.Random(4)
    rows = [(b, i, rng.randrange(4), 0.1, 0.1, 90.0, 1.0, 100.0) for b in (1, 2) for i in range(40)] + [(3, 1, 1, 0.1, 0.1, 90.0, 1.0, 100.0)]
    df = spark.createDataFrame(rows, "bucket long, b long, root long, d double, e double, inside double, outside double, weight double")
    got = sorted(map(tuple, N._further_pairs(df, 0.8).collect()))
    assert got == sorted({(x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[1] < y[1] and x[2] != y[2]})


def test_chains_and_edge_rows(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = [(1, None), (2, ""), (3, " ...\n"), (4, "one two"), (5, "One, TWO!"), (5, "One, TWO!"), (6, "one two three"), (None, "one two"), (None, "lonely text of nobody at all"), (7, "same id text a b c d e"), (7, "quite other words f g h i j k")]
    # Chains: neighbours are links, ends aren't; and a large group of near copies.
    for chain in range(6):
        words = [word() for _ in range(300)]
        for step in range(8):
            rows.append((100 + 10 * chain + step, " ".join(words)))
            at = rng.randrange(250)
            words[at : at + 22] = [word() for _ in range(22)]
    base = [word() for _ in range(400)]
    for i in range(400):
        own = list(base)
        for _ in range(4):
            own[rng.randrange(400)] = word()
        rows.append((1000 + i, " ".join(own)))
    for i in range(300):  # a passage that many texts share
        rows.append((2000 + i, " ".join(base[:60] + [word() for _ in range(60)])))
    got = run(spark, rows)
    assert got == brute_classes(rows)
    assert run(spark, [(1, None), (2, None)]) == [(1, 1, 1), (2, 2, 1)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert N.classes(empty).count() == 0


def kept_ids(spark, rows):
    df = spark.createDataFrame([(*r, "kept", 1, 2, 3) for r in rows], "doc_id long, text string, class_id string, node int, other_id int, Root int")
    got = N.keep_one(df)
    assert got.columns == df.columns
    return sorted(((r.doc_id, r.text) for r in got.collect()), key=str)


def test_keep_one(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "x y z"), (4, None), (5, None)]
    assert kept_ids(spark, rows) == [(1, "a b c d e f g"), (3, "x y z"), (4, None), (5, None)]


def test_keep_one_where_ids_are_null_or_repeated(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A b c d e f g"), (None, "a b c d e f g"), (None, "lonely"), (None, "twin w"), (None, "twin w"), (7, "one text"), (7, "other text"), (None, None), (None, ""), (8, "other text")]
    assert kept_ids(spark, rows) == sorted([(1, "a b c d e f g"), (None, "lonely"), (None, "twin w"), (7, "one text"), (7, "other text"), (None, None), (None, "")], key=str)
