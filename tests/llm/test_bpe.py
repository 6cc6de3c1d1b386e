import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from photolith.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(PATH)


ALPHABETS = ["ab", "aeiounst", "abcdefghijklmnopqrstuvwxyz", "aé漢ñ", "!?.-", "ha", "thein"]


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_long_words_stream_as_the_library_encodes_them(library, encoder, alphabet):
    rng = random.Random(alphabet)
    for size in (1, 7, 30, 700, 5000):
        text = "".join(rng.choice(alphabet) for _ in range(size))
        assert list(encoder.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_repeats_of_tokens_stream(library, encoder):
    rng = random.Random(5)
    plain = [t for t in encoder.tokens if t.isascii() and t.isalpha()]
    for _ in range(300):
        text = "".join(rng.choice(plain) for _ in range(400))
        assert list(encoder.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_noise(library, encoder):
    rng = random.Random(3)
    parts = ["a", "B", "é", "é", "́", " ", "\n", "\x1c", "\x85", " ", "'s", "'", "’re", "'ll", "9", "½", "²", "Σ", "ΑΣ ", "İ", "ß", "漢字", "<|endoftext|>", "<|startoftext|>", "<|", "_", "!!", "​", "ⅷ", "🙂", "ำ", "don't"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        want = library.encode(text, add_special_tokens=False)
        got = list(encoder.encode(text))
        assert got == want.ids, text
        decoder = bpe.Decoder(encoder)
        cut = rng.randrange(len(got) + 1)
        assert decoder.feed(got[:cut]) + decoder.feed(got[cut:]) + decoder.finish() == library.decode(want.ids, skip_special_tokens=False)


def test_pieces_change_nothing(library, encoder, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 9)
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["ab", " ", "'s", "x!", "<|endoftext|>", "<", "é", "́", "12", "|>", "don't", "a'"]) for _ in range(60))
        assert list(encoder.encode(text)) == library.encode(text, add_special_tokens=False).ids, text


def test_plain_decoding_round_trip(encoder):
    text = "héllo wörld 漢字 ok"
    ids = list(encoder.encode(text))
    decoder = bpe.Decoder(encoder, plain=True)
    assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == text + " "


def test_whole_table_against_the_library(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    rows = bpe.digests(docs, PATH).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "a b", 5), (3, "a b", 5), (None, "z" * 300_000, 5)], "doc_id long, text string, n_tokens int")
    rows = bpe.digests(df, PATH).collect()
    assert sorted(r.n_tokens for r in rows)[:4] == [0, 0, 2, 2]
    assert bpe.digests(df.limit(0), PATH).count() == 0
