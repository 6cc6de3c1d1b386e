import hashlib

import corpus_pipeline as C
import public_tokenizers
from tokenizers import Tokenizer


def test_token_ids_are_decoded_as_by_the_library(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    extra = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", "s", 0), (-3, "Ünï ﬁ ΣΑΣ 漢字 it's <|endoftext|> x" * 9_000, "en", "s", 0)], docs.schema)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text or "" for r in docs.unionByName(extra).collect()}
    got = C.token_ids_stage(spark, docs.unionByName(extra), sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.token_ids == ids
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
