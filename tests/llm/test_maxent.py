import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from photolith.llm import maxent


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows):
    """Base columns by id, repeated rows alike."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter()
    for i, t in rows:
        if not held(i):
            counts.update(words(t) + ["\0end"])
    total, kinds = sum(counts.values()), len(counts)
    out = {}
    for i, t in rows:
        w = words(t) + ["\0end"]
        out[i] = (held(i), len(w), sum(counts[x] > 0 for x in w), total, sum(np.log10((counts[x] + 1) / (total + kinds + 1)) for x in w))
    return out


def check(got, want):
    for r in got:
        a = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == a[:4], r.doc_id
        assert r.base_score == pytest.approx(a[4], rel=1e-9)
        assert np.isfinite(r.score) and r.score <= 0


@pytest.mark.parametrize("head", [0, 50, 300_000])
def test_base_columns_against_brute_force(spark, sf_dir, head):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = maxent.score(docs, head_size=head).collect()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert len(got) == len(rows)
    check(got, brute(rows))


def test_held_out_texts_score_better_than_the_unigram(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = maxent.score(docs).filter("held_out").agg(F.sum("score"), F.sum("base_score")).head()
    assert r[0] > r[1]


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "A b\tB"), (3, "A b\tB"), (None, "b " * 50_000), (5, "zz")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    check(maxent.score(df).collect(), brute(rows))
    assert maxent.score(df.limit(0)).count() == 0


def plain_score(model, text, counts):
    """The log10 probability of a text from the model's definition, one token at a time."""
    head, weights = model.head, model.weights.astype(float)
    bits = int(np.log2(len(weights) // 2))
    h, bounds = maxent.tokens(pa.array([text]))
    total, out = head.tail_total + head.tail_kinds + 1, 0.0
    for i in range(len(h)):
        one = h[i - 1 : i] if i > 0 else np.array([maxent.START])
        two = h[i - 2 : i - 1] if i > 1 else np.array([maxent.START])
        slot = int(h[i] >> np.uint64(64 - maxent.SLOT_BITS))
        known = head.keys[slot] == h[i]
        cls = int(head.cls[slot]) if known else maxent.CLASSES - 1

        def log_p(bias, rows, k):
            x = bias.astype(float) + sum(weights[int(r[0])] for r in rows)
            return x[k] - np.log(np.exp(x).sum())

        p = log_p(head.bias, maxent.features(one, two, bits), cls)
        if known:
            leaf = int(head.leaf[slot])
            if maxent.SINGLE <= cls < maxent.CLASSES - 1:
                p += log_p(head.leaf_bias[cls], maxent.leaf_features(one, two, np.array([cls]), bits), leaf)
            mates = (head.keys > 0) & (head.cls == cls) & (head.leaf == leaf)
            p += np.log(head.count[slot] / head.count[mates].sum())
        else:
            p += np.log((counts.get(int(h[i].view(np.int64)), 0) + 1) / total)
        out += p / np.log(10)
    return out


@pytest.mark.parametrize("head_size", [60, 2000])
def test_scores_against_the_definition(spark, sf_dir, head_size):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn("held_out", F.col("doc_id") % 5 == 0)
    model = maxent.fit(docs.filter("NOT held_out"), head_size)
    assert np.abs(model.weights).max() > 0
    counts = {r.h: r.n for r in model.counts.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.score for r in maxent.apply(model, docs).collect()}
    for i in sorted(texts, key=lambda i: len(texts[i] or ""))[:40]:
        assert got[i] == pytest.approx(plain_score(model, texts[i] or "", counts), rel=1e-4), i


def test_probabilities_of_all_tokens_sum_to_one():
    h = mix_of(range(1, 400))
    n = np.arange(400, 1, -1)
    head = maxent.make_head(h, n, int(n.sum()) + 500, len(h) + 100)
    rng = np.random.default_rng(1)
    weights = rng.normal(0, 0.5, (2 << 6, maxent.CLASSES)).astype(np.float32)
    kept = np.flatnonzero(head.keys)
    for before in (h[5:6], h[77:78]):
        p = np.exp(maxent.log_softmax(maxent.logits(head.bias, weights, maxent.features(before, h[:1], 6))))[0].astype(float)
        total = p[maxent.CLASSES - 1]
        for s in kept:
            c = int(head.cls[s])
            inner = np.exp(maxent.log_softmax(maxent.logits(head.leaf_bias[[c]], weights, maxent.leaf_features(before, h[:1], np.array([c]), 6))))[0] if maxent.SINGLE <= c else np.ones(maxent.LEAVES)
            total += p[c] * inner[head.leaf[s]] * 10.0 ** head.logp[s]
        assert total == pytest.approx(1, abs=1e-3)


def mix_of(values):
    return maxent.mix(np.array(list(values), dtype=np.uint64))


def test_the_weight_table_grows_with_the_corpus():
    assert [maxent.table_bits(n) for n in (0, 10**6, 10**8, 10**9, 10**12)] == [15, 15, 16, 17, 17]


def test_a_held_out_copy_of_common_phrases_gains_by_its_history(spark):
    """The leaf factor sees history: with its weights alone set to zero, held-out texts score worse."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").withColumn("held_out", F.col("doc_id") % 7 == 2)
    model = maxent.fit(docs.filter("NOT held_out"))
    with_it = maxent.apply(model, docs).filter("held_out").agg(F.sum("score")).head()[0]
    model.weights[len(model.weights) // 2 :] = 0
    assert with_it > maxent.apply(model, docs).filter("held_out").agg(F.sum("score")).head()[0]


def held_out_gain(model, docs):
    """log10 per token above the add-one unigram, over the held-out texts."""
    r = maxent.apply(model, docs).filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).head()
    return (r[0] - r[1]) / r[2]


def test_training_does_not_depend_on_the_number_of_tasks(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
    gains, weights = [], []
    for parts, tokens in ((1, 10**9), (7, 50_000), (30, 10_000)):
        monkeypatch.setattr(maxent, "TOKENS_PER_TASK", tokens)
        monkeypatch.setattr(maxent, "LEAST_TOKENS", 10**9)
        rows = docs.repartition(parts, "doc_id")
        model = maxent.fit(rows.filter("NOT held_out"))
        gains.append(held_out_gain(model, docs))
        weights.append(model.weights)
    assert min(gains) > 0.2 and max(gains) - min(gains) < 0.05 * min(gains), gains
    assert all(np.abs(w - weights[0]).max() < 0.05 for w in weights[1:])


def test_training_equals_a_plain_version(spark, sf_dir, monkeypatch):
    """Rounds of summed gradients, token by token, in double precision, against the distributed ones."""
    monkeypatch.setattr(maxent, "ROUNDS", 2)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("length(text) < 900").select("text").limit(40)
    rows = docs.collect()
    model = maxent.fit(spark.createDataFrame(rows, "text string").repartition(3))
    turns = {r.text: r.t for r in spark.createDataFrame(rows, "text string").select("text", F.pmod(F.xxhash64("text", F.lit(29)), F.lit(2)).alias("t")).collect()}
    head, bits = model.head, int(np.log2(len(model.weights) // 2))
    weights, squares = np.zeros(model.weights.shape), np.zeros(model.weights.shape)
    for turn in range(2):
        total = np.zeros(weights.shape)
        for (text,) in rows:
            if turns[text] != turn:
                continue
            h, bounds = maxent.tokens(pa.array([text]))
            for i in range(len(h)):
                one = h[i - 1 : i] if i > 0 else np.array([maxent.START])
                two = h[i - 2 : i - 1] if i > 1 else np.array([maxent.START])
                slot = int(h[i] >> np.uint64(64 - maxent.SLOT_BITS))
                cls = int(head.cls[slot]) if head.keys[slot] == h[i] else maxent.CLASSES - 1
                asked = [(head.bias, maxent.features(one, two, bits), cls)]
                if maxent.SINGLE <= cls < maxent.CLASSES - 1:
                    asked.append((head.leaf_bias[cls], maxent.leaf_features(one, two, np.array([cls]), bits), int(head.leaf[slot])))
                for bias, at, k in asked:
                    x = bias.astype(float) + sum(weights[int(r[0])] for r in at)
                    p = np.exp(x - x.max())
                    p /= p.sum()
                    p[k] -= 1
                    for r in at:
                        total[int(r[0])] += p
        squares += total**2
        weights -= maxent.RATE * total / np.sqrt(squares + maxent.EASE)
    assert np.abs(weights).max() > 0.5 and np.abs(weights - model.weights).max() < 0.02
