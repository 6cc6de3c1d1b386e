"""Quality rules: plain word rules, then tokeniser fertility measured with public vocabularies.

Words are `[^\\x20\\x09-\\x0D]+`. Every distinct word of a slice is encoded once, by a SentencePiece
vocabulary with byte fallback and by a byte-level one; a bounded memo keeps the encodings. Both vocabularies cut texts at white space before they
merge, so the words' tokens are the text's, but for tokens of mere white space. From them each
text gets characters per token under both vocabularies, the share of byte-fallback tokens, and the
entropy of its token distribution, and is rejected where any of these leaves the band of its language, or
of its script where the language is unknown. Bands have limits for each vocabulary by itself, where labelled text was there to fit them to
(`fit`), and else limits that both must leave. Texts of fewer than `SHORT_TOKENS` tokens vary more and have wider bands, by the square root
of what they lack.

Defined cases: a null or empty text has no words and fails the base rules; a null language means the script's band; repeated rows are
judged each on its own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolith.llm._bytes import SPACED, Words, columns, map_texts, mix, owner, segment_sum, span_hashes, windows, with_own_id

MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30
SHORT_TOKENS = 64
MEMO_TOKENS = 1 << 20

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class Band:
    """Limits of a language or script; a text outside any of them is rejected."""

    least_chars: float
    most_chars: float
    most_fallback: float
    least_entropy: float
    #: The byte vocabulary's own limits; without them the other two are for both, and a text must leave them under both.
    least_byte_chars: float = np.nan
    most_byte_chars: float = np.nan


#: By language, else by the script of most letters. Where there are limits for the byte vocabulary, the least characters per token are the 0.25 %
#: quantiles of sf0.1's texts labelled as clean that have even ids (`latin`: the lowest of the four languages); the most are wide, as clean text's own
#: quantiles would cost more clean text than junk. No text of other scripts is labelled: their limits are wide and for both vocabularies.
BANDS = {
    "en": Band(2.05, 7.5, 0.20, 4.2, 2.09, 7.5),
    "de": Band(2.06, 7.0, 0.20, 4.2, 2.17, 7.0),
    "fr": Band(1.73, 7.0, 0.20, 4.2, 1.87, 7.0),
    "es": Band(1.78, 7.0, 0.20, 4.2, 1.92, 7.0),
    "latin": Band(1.73, 8.0, 0.35, 4.0, 1.87, 8.0),
    "cyrillic": Band(1.20, 7.0, 0.40, 4.0),
    "greek": Band(0.80, 6.0, 0.60, 4.0),
    "other": Band(0.35, 8.0, 0.95, 3.5),
}

RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "n_tokens long, chars_per_token double, chars_per_byte_token double, fallback_share double, token_entropy double, band string"
)


class Vocabularies:
    """Token ids of words under both vocabularies, in flat arrays sorted by word hash."""

    def __init__(self, piece_path: str, byte_path: str):
        import base64

        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.piece = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        with open(byte_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.byte = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.fallback = np.array([self.piece.is_byte(i) for i in range(self.piece.get_piece_size())])
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.first = np.zeros(0, dtype=np.int64)
        self.length = np.zeros(0, dtype=np.int32)
        self.byte_length = np.zeros(0, dtype=np.int32)
        self.tokens = np.zeros(0, dtype=np.int32)

    def find(self, words: Words) -> np.ndarray:
        """The place of every word in the arrays, after encoding those not there yet."""
        if len(self.tokens) > MEMO_TOKENS:
            self._clear()
        distinct, sample, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), dtype=bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == distinct
        if not known.all():
            new = np.flatnonzero(~known)
            raw = words.data.tobytes()
            texts = [raw[words.start[i] : words.end[i]].decode("utf-8", "replace") for i in sample[new]]
            ids = self.piece.encode(texts, num_threads=1)
            length = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids))
            byte_length = np.fromiter((len(self.byte.encode_ordinary(" " + t)) for t in texts), dtype=np.int32, count=len(ids))
            flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(length.sum()))
            keys = np.concatenate((self.keys, distinct[new]))
            first = np.concatenate((self.first, len(self.tokens) + np.cumsum(length) - length))
            order = np.argsort(keys, kind="stable")
            self.keys, self.first = keys[order], first[order]
            self.length = np.concatenate((self.length, length))[order]
            self.byte_length = np.concatenate((self.byte_length, byte_length))[order]
            self.tokens = np.concatenate((self.tokens, flat))
            at = np.searchsorted(self.keys, distinct)
        return at[inverse]


def repeats(keys: np.ndarray) -> np.ndarray:
    """Which of the keys are there twice or more."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), dtype=bool)
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys


def base_counts(words: Words) -> dict[str, np.ndarray]:
    """The plain counts of each text."""
    data, offsets, bounds = words.data, words.offsets, words.bounds
    texts = len(offsets) - 1
    points = SPACED[data] & ((data & 0xC0) != 0x80)
    counts = {"n_words": words.counts(), "word_chars": segment_sum(points, offsets), "n_symbols": segment_sum(SYMBOLS[data], offsets)}

    # Lines: from a text's start or after a \n up to the next \n or the text's end.
    cut = np.flatnonzero(data == 10)
    start = np.union1d(offsets[:-1], cut + 1)
    start = start[start < len(data)]
    of = np.searchsorted(offsets, start, side="right") - 1
    cuts = np.append(cut, len(data))
    stop = np.minimum(cuts[np.searchsorted(cuts, start)], offsets[of + 1]) if len(start) else start
    worded = np.searchsorted(words.start, stop) > np.searchsorted(words.start, start)
    start, stop, of = start[worded], stop[worded], of[worded]
    keys = span_hashes(data, start, stop) ^ mix(of.astype(np.uint64))
    distinct, first = np.unique(keys, return_index=True)
    counts["n_dup_lines"] = np.bincount(of, minlength=texts)[:texts] - np.bincount(of[first], minlength=texts)[:texts]

    first_word, keys = windows(words.hash, bounds, REPEAT_WINDOW)
    text_of = owner(bounds)
    again = first_word[repeats(keys ^ mix(text_of[first_word].astype(np.uint64)))]
    change = np.zeros(len(words.hash) + 1, dtype=np.int64)
    np.add.at(change, again, 1)
    np.add.at(change, again + REPEAT_WINDOW, -1)
    counts["n_repeat_words"] = segment_sum(np.cumsum(change[:-1]) > 0, bounds)
    n = counts["n_words"]
    counts["base_failed"] = (n < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * n)
    return counts


def scripts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The commonest script of each text's letters: 0 latin, 1 cyrillic, 2 greek, 3 other, by lead bytes of UTF-8."""
    latin = ((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122)) | ((data >= 0xC3) & (data <= 0xC9))
    cyrillic = (data >= 0xD0) & (data <= 0xD3)
    greek = (data == 0xCE) | (data == 0xCF)
    other = (data >= 0xD4) & (data != 0xE2)
    return np.argmax(np.stack([segment_sum(x, offsets) for x in (latin, cyrillic, greek, other)]), axis=0)


def fertility(words: Words, vocabularies: Vocabularies) -> dict[str, np.ndarray]:
    """Characters per token, fallback share and token entropy (bits) of each text; NaN without words."""
    bounds, texts = words.bounds, len(words.bounds) - 1
    place = vocabularies.find(words)
    length = vocabularies.length[place].astype(np.int64)
    tokens = segment_sum(length, bounds)
    byte_tokens = segment_sum(vocabularies.byte_length[place], bounds)
    chars = segment_sum(SPACED[words.data] & ((words.data & 0xC0) != 0x80), words.offsets)
    before = np.cumsum(length) - length
    flat = vocabularies.tokens[np.repeat(vocabularies.first[place] - before, length) + np.arange(int(length.sum()))]
    text_of = np.repeat(owner(bounds), length)
    fallback = np.bincount(text_of[vocabularies.fallback[flat]], minlength=texts)[:texts]
    ordered = np.sort((text_of << 32) | flat)
    edge = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, dtype=np.int64)
    count = np.diff(np.append(edge, len(ordered)))
    of = ordered[edge] >> 32
    with np.errstate(divide="ignore", invalid="ignore"):
        share = count / tokens[of]
        entropy = np.bincount(of, weights=-share * np.log2(share), minlength=texts)[:texts]
        return {
            "n_tokens": tokens,
            "chars_per_token": chars / tokens,
            "chars_per_byte_token": chars / byte_tokens,
            "fallback_share": fallback / tokens,
            "token_entropy": np.where(tokens > 0, entropy, np.nan),
        }


def _judged(texts: pa.Array, langs: list[str | None], vocabularies: Vocabularies, bands: dict[str, Band]) -> tuple[dict, dict, list[str], np.ndarray]:
    """Base counts, measures, band and verdict of each text."""
    names, limits = list(bands), list(bands.values())
    script_at = [names.index(x) for x in ("latin", "cyrillic", "greek", "other")]
    words = Words(texts, SPACED)
    base, measured = base_counts(words), fertility(words, vocabularies)
    script = scripts(words.data, words.offsets)
    band = np.array([names.index(x) if x in bands else script_at[s] for x, s in zip(langs, script, strict=True)], dtype=np.int64)
    return base, measured, [names[b] for b in band], ~base["base_failed"] & ~_outside(measured, [limits[b] for b in band])


def _outside(measured: dict[str, np.ndarray], bands: list[Band]) -> np.ndarray:
    """Which texts leave their band."""
    of = lambda k: np.array([getattr(b, k) for b in bands], dtype=np.float64)
    piece, byte, n = measured["chars_per_token"], measured["chars_per_byte_token"], np.maximum(measured["n_tokens"], 1)
    wider = np.sqrt(np.maximum(SHORT_TOKENS / n, 1.0))
    # n tokens can't have more than log2(n) bits.
    least_entropy = of("least_entropy") * np.minimum(np.log2(n) / np.log2(SHORT_TOKENS), 1.0) / wider
    low, low_byte = piece < of("least_chars") / wider, byte < of("least_byte_chars") / wider
    high, high_byte = piece > of("most_chars") * wider, byte > of("most_byte_chars") * wider
    shared = np.isnan(of("least_byte_chars"))
    both_low, both_high = np.maximum(piece, byte) < of("least_chars") / wider, np.minimum(piece, byte) > of("most_chars") * wider
    out = np.where(shared, both_low | both_high, low | low_byte | high | high_byte)
    return out | (measured["fallback_share"] > of("most_fallback") * wider) | (measured["token_entropy"] < least_entropy)


def fit(judged: DataFrame, share: float = 0.0025) -> dict[str, Band]:
    """`BANDS` with the least characters per token under which `share` of each band's rows lie; `judged`: rows of `judge` that are known to be clean.

    Of all rows of at least `SHORT_TOKENS` tokens that the base rules keep; bands without such rows stay as they are.
    """
    low = lambda c: F.percentile(c, F.lit(share)).alias(c)
    rows = judged.filter(~F.col("base_failed") & (F.col("n_tokens") >= SHORT_TOKENS)).groupBy("band").agg(low("chars_per_token"), low("chars_per_byte_token")).collect()
    fitted = {r.band: replace(BANDS[r.band], least_chars=r.chars_per_token, least_byte_chars=r.chars_per_byte_token, most_byte_chars=BANDS[r.band].most_chars) for r in rows}
    return BANDS | fitted


def judge(df: DataFrame, piece_path: str | None = None, byte_path: str | None = None, bands: dict[str, Band] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """One row of measures and verdicts for each row of `df`; one pass, no shuffle."""
    import public_tokenizers

    piece_path = piece_path or public_tokenizers.path("piece_bpe_32k.model")
    byte_path = byte_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    bands = bands or BANDS
    rows = columns(df, doc_id=id_col, text=text_col, lang=lang_col or text_col)
    made: list[Vocabularies] = []

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Vocabularies(piece_path, byte_path))
        langs = batch.column(2).to_pylist() if lang_col else [None] * batch.num_rows
        base, measured, band, kept = _judged(batch.column(1), langs, made[0], bands)
        arrays = [batch.column(0)]
        arrays += [pa.array(base[k], type=pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        arrays += [pa.array(base["base_failed"]), pa.array(kept), pa.array(measured["n_tokens"], type=pa.int64())]
        arrays += [pa.array(measured[k], type=pa.float64(), from_pandas=True) for k in ("chars_per_token", "chars_per_byte_token", "fallback_share", "token_entropy")]
        arrays.append(pa.array(band, type=pa.string()))
        return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in RESULT.split(", ")])

    return map_texts(rows, part, with_own_id(RESULT, df, id_col))


def keep(df: DataFrame, piece_path: str | None = None, byte_path: str | None = None, bands: dict[str, Band] | None = None, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """The rows of `df` that the rules keep, with all their columns; one pass, no shuffle, no join by id."""
    import public_tokenizers

    piece_path = piece_path or public_tokenizers.path("piece_bpe_32k.model")
    byte_path = byte_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    bands = bands or BANDS
    text_at, lang_at = df.columns.index(text_col), df.columns.index(lang_col) if lang_col else None
    made: list[Vocabularies] = []

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Vocabularies(piece_path, byte_path))
        langs = [None] * batch.num_rows if lang_at is None else batch.column(lang_at).to_pylist()
        return batch.filter(pa.array(_judged(batch.column(text_at), langs, made[0], bands)[3]))

    return map_texts(df, part, df.schema, text=text_col)
