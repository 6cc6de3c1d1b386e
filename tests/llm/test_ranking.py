import math
import random
import re

import pytest

from photolith.llm import ranking as R

DOCS, ITEMS = "doc_id long, text string", "item_id string, text string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=20):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n, total, df = len(held), sum(len(w) for _, w in held), {}
    for _, w in held:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for i, w in held:
            m = 75 + 25 * len(w) * n // total
            gain = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * w.count(t) // (1000 * w.count(t) + 12 * m)) for t in terms(text) if t in df)
            if gain > 0:
                scores.append((-gain, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def got(spark, docs, items, parts=3, **more):
    found = R.search(spark.createDataFrame(docs, DOCS).repartition(parts), spark.createDataFrame(items, ITEMS), **more)
    return sorted([tuple(r) for r in found.collect()], key=str)


def made(seed, n=300):
    rng = random.Random(seed)
    words = [f"w{int(rng.expovariate(0.05))}" for _ in range(200)] + ["The", "the", "ÄÖ", "äö"]
    docs = [(rng.randrange(10**9), " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40, 200])))) for _ in range(n)]
    items = [(f"i{k}", ", ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))) for k in range(20)]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_definition(spark, seed):
    docs, items = made(seed)
    assert got(spark, docs, items) == brute(docs, items)


def test_many_windows_and_segments(spark, monkeypatch):
    monkeypatch.setattr(R, "WINDOW", 64)
    monkeypatch.setattr(R, "POSTINGS", 500)
    docs, items = made(3, 600)
    assert got(spark, docs, items, parts=2) == brute(docs, items)


def test_items_in_several_blocks(spark):
    docs, items = made(4)
    assert got(spark, docs, items, block_words=40) == brute(docs, items)


def test_ties_are_in_the_order_of_ids(spark):
    docs = [(k, "same text here") for k in random.Random(5).sample(range(1000), 90)] + [(2000, "other"), (None, "same text here"), (7, "other words")]
    items = [("a", "text"), ("b", "here here text"), ("c", "absent"), ("d", "other")]
    assert got(spark, docs, items) == brute(docs, items)


def test_few_documents_nulls_and_repeats(spark):
    docs = [(1, None), (2, ""), (3, "!?"), (4, "alpha beta"), (4, "alpha beta"), (None, "beta"), (5, "A-lpha x ALPHA"), (6, "gamma " * 50000), (8, "y")]
    items = [("a", "alpha beta"), ("a", "alpha beta"), ("b", None), ("c", ""), (None, "gamma"), ("d", "...")]
    assert got(spark, docs, items) == brute(docs, items)


def test_a_term_that_all_documents_hold_weighs_nothing(spark):
    assert got(spark, [(k, "common") for k in range(50)], [("a", "common")]) == brute([(k, "common") for k in range(50)], [("a", "common")])


def test_empty_tables(spark):
    docs, items = made(6, 5)
    assert got(spark, [], items) == [] and got(spark, docs, []) == [] and got(spark, [(1, None)], items) == []


def test_other_columns_and_names(spark):
    docs = spark.createDataFrame([("x", "one two", 1), ("y", "one", 2)], "key string, body string, rank int")
    items = spark.createDataFrame([(5, "two", 1)], "no int, q string, item int")
    out = R.search(docs, items, id_col="key", text_col="body", item_id_col="no", item_text_col="q")
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert [tuple(r)[:3] for r in out.collect()] == [(5, 1, "x")]


def test_lengths_beyond_64_bits():
    import numpy as np

    n, documents, total = np.array([1, 10**6, 10**9]), 10**12, 10**15
    assert R.lengths(n, documents, total).tolist() == [75 + 25 * x * documents // total for x in n.tolist()]
