import hashlib
import random
import re

import pytest

from photolith.llm import decontaminate as D


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            size = min(13, len(v))
            grams = {tuple(v[k : k + size]) for k in range(len(v) - size + 1)} if size else set()
            for k in range(len(w) - size + 1) if size else ():
                if tuple(w[k : k + size]) in grams:
                    hit.update(range(k, k + size))
                    found.add(str(item))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def made(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(6)] if seed % 2 else [f"w{i}" for i in range(400)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 6, 7, 12, 13, 14, 20, 40])))) for k in range(12)] + [(50, None), (51, "éa B-c"), (11, "w1 w2")]
    docs = []
    for k in range(40):
        parts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(30))) for _ in range(3)]
        item = words(rng.choice(items)[1])
        a = rng.randrange(len(item) + 1)
        parts.insert(1, " ".join(item[a : a + rng.choice([12, 13, 14, 30])]).upper().replace("É", "é"))
        docs.append((k, " , ".join(parts)))
    return [*docs, (90, None), (91, ""), (92, "ÉA b c"), (92, "éa b c"), (None, "x " * 20_000 + (items[0][1] or ""))], items


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("block_words", [D.BLOCK_WORDS, 30])
def test_against_brute_force(spark, seed, block_words):
    docs, items = made(seed)
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, own_key int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in D.find(df, bench, block_words=block_words).collect()), key=str)
    want = brute(docs, items)
    assert got == want
    key = lambda x: (str(x[0]), str(x[1]))
    kept = sorted(((r.doc_id, r.text) for r in D.keep_clean(df, bench, block_words=block_words).collect()), key=key)
    bad = {key(d) for d in docs if brute([d], items)[0][5]}
    assert kept == sorted((d for d in docs if key(d) not in bad), key=key)


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.find(df, bench).head().n_hit == 0 and D.keep_clean(df, bench).count() == 1
    assert D.find(df.limit(0), df.select(df.doc_id.alias("item_id"), "text")).count() == 0


def test_winnowing_meets_every_span_of_thirteen():
    import numpy as np
    import pyarrow as pa

    from photolith.llm._bytes import ALNUM, LOWER, Words

    rng = random.Random(9)
    for _ in range(200):
        span = [f"s{rng.randrange(50)}" for _ in range(13)]
        item, doc = ([f"{p}{rng.randrange(50)}" for _ in range(rng.randrange(30))] + span + [f"{p}{rng.randrange(50)}" for _ in range(rng.randrange(30))] for p in "ab")
        left, right, _ = D.common_spans(Words(pa.array([" ".join(doc)]), ALNUM, LOWER), D.Index([("i", " ".join(item))]))
        assert len(left) and int(np.max(right - left)) >= 13
