"""Language identification with interpolated Kneser-Ney character models.

Per language, n-grams of up to `ORDER` characters (lower-cased letters; everything else is one space) are counted in a bounded
sample of labelled texts: raw counts for the highest order, continuation counts below, one absolute discount per
order. Every language is counted in a task of its own, from its own sample; only models come to the driver. Each model is a set of sorted arrays of n-gram hashes with log probabilities, and of context hashes with
back-off weights. A text goes to the language with the lowest cross-entropy per character.

Calibration on texts held back from the sample: the temperature of the score, and for each language the cross-entropy that all but
one in `REJECT_SHARE` of its own texts keep below, so that single mislabelled texts don't open a language. Beyond it, with some slack, `rejected` is set,
and the score falls with the distance to it: (limit / cross-entropy) ** `REJECT_POWER` of what it would be.

The sample of a language is its first `SAMPLE_TEXTS` texts by a hash of id and text, long ones after all others, as far as they have `SAMPLE_CHARS` characters
together; of a language all of whose texts have more, it is the shortest text. No language is left out. Models are sent in blocks of at most `BLOCK_BYTES`: one block
stays in a worker; where all languages' models are larger than that, a worker holds one block at a time. Prediction covers whole texts of all rows.

Defined cases: null or letterless text: `und` with score 0, not rejected; rows without a language aren't learned from;
with no language learned all texts are `und`; ties go to the language that sorts first; repeated rows are judged each on
its own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from photolith.llm._bytes import Shared, columns, map_texts, mix, segment_sum, slices, with_own_id
from photolith.llm._store import stored

ORDER = 4
BITS = 16
SPACE, UNKNOWN = 1, 2
SAMPLE_TEXTS = 300
SAMPLE_CHARS = 2_000_000
BLOCK_BYTES = 128 << 20
BROADCAST_LANGUAGES = 100_000
MEMO_BITS = 19
REJECT_SLACK = 1.15
REJECT_SHARE = 50
REJECT_POWER = 8
SHARPNESS = (0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0)

RESULT = "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean"

_MASK = [np.uint64((1 << (BITS * k)) - 1) if BITS * k < 64 else np.uint64(2**64 - 1) for k in range(ORDER + 1)]


class Letters:
    """Character ids: 1 for all but letters, 2 for letters not in the sample, then the sample's letters."""

    def __init__(self, known: list[int]):
        table = np.full(0x110000, SPACE, dtype=np.uint16)
        for i in range(0x110000):
            if chr(i).isalpha():
                table[i] = UNKNOWN
        for i, c in enumerate(known[: (1 << BITS) - 4]):
            table[c] = UNKNOWN + 1 + i
        self.table = table

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts end to end with runs of spaces made one, the len + 1 bounds, and letters a text."""
        lowered = [(t or "").lower() for t in texts]
        sizes = np.array([len(t) for t in lowered], dtype=np.int64)
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.table[np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        blank = ids == SPACE
        keep = ~blank
        keep[1:] |= ~blank[:-1]
        starts = bounds[:-1][sizes > 0]
        keep[starts] = ~blank[starts]
        kept = np.concatenate(([0], np.cumsum(keep)))
        letters = np.concatenate(([0], np.cumsum(~blank)))
        return ids[keep], kept[bounds], letters[bounds[1:]] - letters[bounds[:-1]]


def grams(ids: np.ndarray, bounds: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For each character the code of it and the order - 1 before it; spaces stand before a text."""
    code = ids.astype(np.uint64)
    before = ids
    for back in range(1, order):
        before = np.concatenate((np.full(1, SPACE, dtype=before.dtype), before[:-1])) if len(before) else before
        starts = bounds[:-1][np.diff(bounds) > 0]
        before[starts] = SPACE
        code |= before.astype(np.uint64) << np.uint64(BITS * back)
    return code


@dataclass
class Level:
    """Sorted hashes of the n-grams of an order with their log probabilities, and of contexts with back-off weights."""

    keys: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    weight: np.ndarray


def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashed = mix(keys)
    order = np.argsort(hashed)
    return hashed[order], values[order].astype(np.float32)


def _find(keys: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashed = mix(codes)
    at = np.minimum(np.searchsorted(keys, hashed), max(len(keys) - 1, 0))
    return at, keys[at] == hashed if len(keys) else np.zeros(len(codes), dtype=bool)


class Model:
    """An interpolated Kneser-Ney model of one language."""

    def __init__(self, codes: np.ndarray, symbols: int):
        seen, counts = np.unique(codes, return_counts=True)
        by_order: list[tuple[np.ndarray, np.ndarray]] = [(seen, counts)]
        for k in range(ORDER - 1, 0, -1):
            shorter, kinds = np.unique(by_order[0][0] & _MASK[k], return_counts=True)
            by_order.insert(0, (shorter, kinds))
        self.levels: list[Level] = []
        lower_keys, lower_p = np.zeros(0, dtype=np.uint64), np.zeros(0)
        for k, (keys, count) in enumerate(by_order, start=1):
            once, twice = int((count == 1).sum()), int((count == 2).sum())
            discount = once / (once + 2 * twice) if once and twice else 0.5
            contexts, of = np.unique(keys >> np.uint64(BITS), return_inverse=True)
            total = np.bincount(of, weights=count)
            rest = discount * np.bincount(of) / total
            if k == 1:
                lower = np.full(len(keys), 1.0 / symbols)
                self.unseen = float(np.log(rest[0] / symbols)) if len(rest) else 0.0
            else:
                lower = lower_p[np.searchsorted(lower_keys, keys & _MASK[k - 1])]
            p = np.maximum(count - discount, 0) / total[of] + rest[of] * lower
            self.levels.append(Level(*_sorted(keys, np.log(p)), *_sorted(contexts, np.log(rest))))
            lower_keys, lower_p = keys, p

    def logp(self, codes: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probabilities of the last characters of n-gram codes."""
        out = np.full(len(codes), self.unseen, dtype=np.float32)
        for k, level in enumerate(self.levels, start=1):
            own = codes & _MASK[k]
            at, seen = _find(level.keys, own)
            if k > 1:
                context_at, known = _find(level.contexts, own >> np.uint64(BITS))
                out[known] += level.weight[context_at[known]]
            out[seen] = level.logp[at[seen]]
        return out


def _training(texts: list[str]) -> list[str]:
    return [t for i, t in enumerate(texts) if i % 5 or len(texts) < 5]


def letters_of(samples: DataFrame) -> list[int]:
    """The letters of all training texts, sorted."""

    def run(batches):
        for batch in batches:
            seen = {ord(c) for t in batch.column(0).to_pylist() for c in set(t.lower()) if c.isalpha()}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), type=pa.int32())], names=["letter"])

    rows = samples.filter("nth % 5 <> 0 OR size < 5").select("text").mapInArrow(run, "letter int").distinct()
    return sorted(r.letter for r in rows.collect())


def trained(samples: DataFrame, known: list[int]) -> DataFrame:
    """(lang, model): each language's model, pickled, made where its sample is."""

    def run(pdf):
        ids, bounds, _ = Letters(known).ids(_training(pdf.sort_values("nth")["text"].tolist()))
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "model": [cloudpickle.dumps(Model(grams(ids, bounds), len(known) + 3))]})

    return samples.select("lang", "nth", "text").groupBy("lang").applyInPandas(run, "lang string, model binary")


@dataclass
class Identifier:
    """The models of a block of languages, and the letters they know."""

    names: list[str]
    models: list[Model]
    known: list[int]


def calibrate(samples: DataFrame, names: list[str], entropies) -> tuple[float, np.ndarray]:
    """The temperature and each language's limit, from the texts that no model was made of."""
    limits, temperature = np.full(len(names), np.inf), 1.0
    held = samples.filter("nth % 5 = 0").select("lang", "text")
    at = {n: k for k, n in enumerate(names)}

    def run(batches):
        scorers: dict = {}
        for batch in batches:
            for part in slices(batch, "text"):
                mean, _, letters = entropies(scorers, part.column(1).to_pylist())
                ok = letters > 0
                truth = np.array([at[x] for x in part.column(0).to_pylist()])[ok]
                mean = mean[ok]
                own = mean[np.arange(len(truth)), truth] if len(truth) else np.zeros(0)
                losses = [-np.log(np.maximum(confidence(mean, s)[np.arange(len(truth)), truth], 1e-12)) for s in SHARPNESS]
                yield pa.RecordBatch.from_arrays([pa.array(truth, type=pa.int32()), pa.array(own), *map(pa.array, losses)], names=["k", "own", *(f"loss{i}" for i in range(len(SHARPNESS)))])

    said = held.mapInArrow(run, "k int, own double, " + ", ".join(f"loss{i} double" for i in range(len(SHARPNESS))))
    rows = said.groupBy("k").agg(F.percentile("own", 1 - 1 / REJECT_SHARE).alias("own"), F.count(F.lit(1)).alias("n"), *[F.sum(f"loss{i}").alias(f"loss{i}") for i in range(len(SHARPNESS))]).collect()
    for r in rows:
        limits[r["k"]] = r["own"] * REJECT_SLACK
    if rows:
        temperature = min((sum(r[f"loss{i}"] for r in rows), s) for i, s in enumerate(SHARPNESS))[1]
    return temperature, limits


def confidence(entropy: np.ndarray, sharpness: float) -> np.ndarray:
    x = -sharpness * (entropy - entropy.min(axis=1, keepdims=True))
    e = np.exp(x)
    return e / e.sum(axis=1, keepdims=True)


class Scorer:
    """Cross-entropies of texts, with a table of n-grams scored before (one slot each, newer ones win)."""

    def __init__(self, identifier: Identifier, letters: Letters | None = None):
        self.identifier = identifier
        self.letters = letters or Letters(identifier.known)
        self.keys = np.zeros(1 << MEMO_BITS, dtype=np.uint64)
        self.values = np.zeros((len(identifier.names), 1 << MEMO_BITS), dtype=np.float32)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nats per character under each model, characters, and letters of each text."""
        ids, bounds, letters = self.letters.ids(texts)
        codes = grams(ids, bounds)
        slot = (mix(codes) >> np.uint64(64 - MEMO_BITS)).astype(np.int64)
        missing = self.keys[slot] != codes
        new = np.unique(codes[missing])
        values = [m.logp(new) for m in self.identifier.models]
        place = np.searchsorted(new, codes[missing])
        sums = []
        for k, v in enumerate(values):
            each = self.values[k][slot]
            each[missing] = v[place]
            sums.append(segment_sum(each, bounds))
        at = (mix(new) >> np.uint64(64 - MEMO_BITS)).astype(np.int64)
        self.keys[at] = new
        winners = self.keys[at] == new
        for k, v in enumerate(values):
            self.values[k][at[winners]] = v[winners]
        size = np.diff(bounds)
        return -np.stack(sums, axis=1) / np.maximum(size, 1)[:, None] if sums else np.zeros((len(texts), 0)), size, letters


def held_out(id_column: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % parts == part, F.lit(False))


def sample(df: DataFrame, texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """(lang, nth, size, text) of each language's sample, a written table, from rows (doc_id, text, lang).

    Rows are thinned by their hash before they meet, to about twice what is wanted, so that no task gets a large language's texts.
    """
    rows = df.filter("lang IS NOT NULL AND text IS NOT NULL").withColumn("draw", F.abs(F.xxhash64("doc_id", "text", F.lit(17)) % F.lit(1 << 62)) / F.lit(float(1 << 62)))
    rows = rows.withColumn("long", F.length("text") > chars // 20)
    length = F.struct(F.length("text"), "draw")
    sizes = rows.groupBy(F.col("lang").alias("lang_")).agg(F.count_if(~F.col("long")).alias("n"), F.count_if("long").alias("n_long"), F.min(length).alias("least"))
    sizes = stored(sizes, "language-sizes")
    if sizes.count() <= BROADCAST_LANGUAGES:  # 60 bytes each
        sizes = F.broadcast(sizes)
    share = F.when(~F.col("long"), 2.0 * texts / F.col("n")).otherwise(F.when(F.col("n") < texts, 2.0 * texts / F.col("n_long")).otherwise(0.0))
    picked = rows.join(sizes, F.col("lang") == F.col("lang_")).filter((F.col("draw") <= share) | (length == F.col("least")))
    own = Window.partitionBy("lang")
    picked = picked.withColumn("turn", F.row_number().over(own.orderBy("long", "draw", "doc_id", "text")))
    picked = picked.withColumn("total", F.sum(F.length("text").cast("long")).over(own.orderBy("turn")))
    # Rows are dealt by a hash, so a language may by chance have fewer than wanted; those that are there are first.
    fits = (F.col("total") <= chars) & (F.col("turn") <= texts)
    picked = picked.withColumn("fits", fits).withColumn("any", F.max("fits").over(own)).filter(F.col("fits") | ~F.col("any") & (length == F.col("least")))
    chosen = picked.withColumn("at", F.row_number().over(own.orderBy("turn"))).filter(F.col("any") | (F.col("at") == 1))
    return stored(chosen.select("lang", (F.col("at") - 1).alias("nth"), F.count(F.lit(1)).over(own).alias("size"), "text"), "language-samples")


def fit(samples: DataFrame, block_bytes: int = BLOCK_BYTES):
    """What `identify` needs: names, shared blocks of models, temperature and limits."""
    spark, known = samples.sparkSession, letters_of(samples)
    names: list[str] = []
    sent: list[Shared] = []
    block: list[tuple[str, bytes]] = []

    def send() -> None:
        if block:
            sent.append(Shared(spark, Identifier([n for n, _ in block], [pickle.loads(m) for _, m in block], known)))
            names.extend(n for n, _ in block)
            block.clear()

    # One model at a time comes to the driver, by name.
    for r in stored(trained(samples, known), "language-models").orderBy("lang").toLocalIterator():
        if block and sum(len(m) for _, m in block) + len(r["model"]) > block_bytes:
            send()
        block.append((r["lang"], bytes(r["model"])))
    send()

    def entropies(scorers: dict, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = []
        for k, shared in enumerate(sent):
            scorer = scorers.get(k) or Scorer(shared.value if len(sent) == 1 else shared.load())
            if len(sent) == 1:
                scorers[k] = scorer
            found.append(scorer.entropies(texts))
        return np.concatenate([f[0] for f in found], axis=1), found[0][1], found[0][2]

    temperature, limits = calibrate(samples, names, entropies) if names else (1.0, np.zeros(0))
    return names, entropies, temperature, limits


def identify(df: DataFrame, parts: int = 4, part: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Learn from rows outside the held-out part, then predict all rows: one pass, no shuffle."""
    rows = columns(df, doc_id=id_col, text=text_col, lang=lang_col)
    names, entropies, temperature, limits = fit(sample(rows.filter(~held_out(F.col("doc_id"), parts, part))), block_bytes)
    scorers: dict = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        if names:
            entropy, _, letters = entropies(scorers, batch.column(1).to_pylist())
            known, best = letters > 0, entropy.argmin(axis=1)
            score = np.where(known, confidence(entropy, temperature)[np.arange(n), best], 0.0)
            lowest = np.where(known, entropy[np.arange(n), best], np.nan)
            rejected = known & (lowest > limits[best])
            score = np.where(rejected, score * (limits[best] / np.where(rejected, lowest, 1.0)) ** REJECT_POWER, score)
            said = [names[b] if k else "und" for b, k in zip(best, known, strict=True)]
        else:
            score, lowest, rejected, said = np.zeros(n), np.full(n, np.nan), np.zeros(n, dtype=bool), ["und"] * n
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(said, type=pa.string()), pa.array(score), pa.array(lowest, from_pandas=True), pa.array(rejected)],
            names=[x.split()[0] for x in RESULT.split(", ")],
        )

    return map_texts(rows.select("doc_id", "text", held_out(F.col("doc_id"), parts, part).alias("held_out")), run, with_own_id(RESULT, df, id_col))
