import corpus_pipeline as C
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from photolith.llm import pii
from tests.llm import test_decontaminate, test_near_dup, test_quality


@pytest.fixture(scope="module")
def outputs(spark, sf_dir, tmp_path_factory):
    """What each stage made of what the one before it kept."""
    at, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = [docs]
    for name, stage in C.STAGES:
        stage(spark, found[-1], sf_dir).write.parquet(f"{at}/{name}")
        found.append(spark.read.parquet(f"{at}/{name}"))
    return found


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_every_stage_against_brute_force(spark, sf_dir, outputs):
    docs, quality, single, clean, private, ids = map(rows, outputs)
    assert all(x.columns == outputs[0].columns for x in outputs[1:5])
    tools = _tools()
    assert set(quality) == {i for i, r in docs.items() if test_quality.brute(r.text, r.lang, tools)[-1]}
    assert all(quality[i] == docs[i] for i in quality)
    classes = test_near_dup.brute_classes([(i, r.text) for i, r in quality.items()])
    assert set(single) == {c for _, c, _ in classes}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    judged = test_decontaminate.brute([(i, r.text) for i, r in single.items()], items)
    assert set(clean) == {r[0] for r in judged if not r[5]}
    anchors = pii.automaton()
    assert set(private) == set(clean)
    for i, r in private.items():
        assert r.text == pii.redacted(clean[i].text, pii.find_spans(clean[i].text, anchors)) and r.n_chars == len(r.text)
        assert not {k for k in pii.find_spans(r.text, anchors) if k in pii.BASE_KINDS}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {i: r.token_ids for i, r in ids.items()} == {i: library.encode(r.text, add_special_tokens=False).ids for i, r in private.items()}
    assert any(private[i].text != clean[i].text for i in private)
    assert len(docs) > len(quality) > len(single) > len(clean) > 0


def _tools():
    import base64

    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_run_is_the_stages_in_a_row(spark, sf_dir, outputs):
    assert rows(C.run(spark, sf_dir)) == rows(outputs[-1])


def test_empty_and_null_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0
        docs = docs if out.columns != docs.columns else out
    nulls = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0)], docs.schema)
    assert C.quality_stage(spark, nulls, sf_dir).count() == 0
    assert C.near_duplicates_stage(spark, nulls, sf_dir).count() == 2
    assert C.decontamination_stage(spark, nulls, sf_dir).count() == 2
    assert C.personal_data_stage(spark, nulls, sf_dir).count() == 2
    assert sorted(map(len, (r.token_ids for r in C.token_ids_stage(spark, nulls, sf_dir).collect()))) == [0, 0]
