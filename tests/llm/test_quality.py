import math
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from photolith.llm import quality as Q


def test_words_have_the_tokens_of_their_text(spark, sf_dir, tools):
    """Encoding word by word loses nothing but tokens of white space."""
    piece, byte = tools
    texts = [" ".join((r.text or "").split()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()][:60] + ["x_1 (a-b) don't $5,000 f(x)=2 ##tag"]
    for t in filter(None, texts):
        assert piece.encode(t) == [i for w in t.split(" ") for i in piece.encode(w)]
        assert byte.encode_ordinary(" " + t) == [i for w in t.split(" ") for i in byte.encode_ordinary(" " + w)]


@pytest.fixture(scope="module")
def tools():
    import base64

    piece = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return piece, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def brute(text, lang, tools):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    grams = Counter(tuple(words[i : i + 8]) for i in range(n - 7))
    hit = {j for i in range(n - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = n < 20 or 100 * len(hit) > 30 * n
    piece, byte = tools
    tokens = [t for w in words for t in piece.encode(w)]
    byte_tokens = sum(len(byte.encode_ordinary(" " + w)) for w in words)
    chars = sum(map(len, words))
    bad = False
    if tokens:
        k = len(tokens)
        counts = Counter(tokens)
        entropy = -sum(c / k * math.log2(c / k) for c in counts.values())
        fallback = sum(piece.is_byte(t) for t in tokens) / k
        band, wider = Q.BANDS[lang], math.sqrt(max(64 / k, 1))
        own = ((chars / k, band.least_chars, band.most_chars), (chars / byte_tokens, band.least_byte_chars, band.most_byte_chars))
        if math.isnan(band.least_byte_chars):
            bad = all(x < band.least_chars / wider for x, _, _ in own) or all(x > band.most_chars * wider for x, _, _ in own)
        else:
            bad = any(x < least / wider or x > most * wider for x, least, most in own)
        bad = bad or fallback > band.most_fallback * wider or entropy < band.least_entropy * min(math.log2(k) / 6, 1) / wider
    return n, chars, sum(c in "#*$%&|<>" for c in text), dup, len(hit), failed, not failed and not bad


def fields(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept


def test_whole_table_against_brute_force(spark, sf_dir, tools):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: (r.text, r.lang) for r in docs.collect()}
    got = Q.judge(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert fields(r) == brute(*texts[r.doc_id], tools), r.doc_id
    kept = {r.doc_id for r in Q.keep(docs).collect()}
    assert kept == {r.doc_id for r in got if r.kept}


EDGE = [
    (1, None, "en"), (2, "", None), (3, "\n\n \t", "en"), (4, "a\n\na\na \nb", None), (4, "a\n\na\na \nb", None), (None, "Слово " * 30, None), (5, "αβγ δεζ " * 40, "xx"),
    (6, " ".join(f"w{i}" for i in range(20)), "en"), (7, " ".join(f"w{i % 8}" for i in range(16)) + " " + " ".join(f"x{i}" for i in range(40)), "en"), (8, "漢字仮名 " * 30_000, "zh"), (9, "\x1c\x85 x", "de"),
]


def test_edge_rows(spark, tools):
    df = spark.createDataFrame([(*r, True) for r in EDGE], "doc_id long, text string, lang string, kept boolean")
    got = {r.doc_id: r for r in Q.judge(df).collect()}
    for i, text, lang in EDGE:
        want = brute(text, lang if lang in Q.BANDS else got[i].band, tools)
        assert fields(got[i]) == want, i
    assert got[None].band == "cyrillic" and got[5].band == "greek" and got[8].band == "other"
    assert Q.judge(df).count() == len(EDGE)
    assert Q.judge(df.limit(0)).count() == 0 == Q.keep(df.limit(0)).count()
