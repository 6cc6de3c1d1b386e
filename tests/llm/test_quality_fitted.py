import pytest

from photolith.llm import quality as Q
from photolith.llm import queries


def test_labelled_junk_goes_and_clean_text_stays(spark, sf_dir):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    judged = [r for r in queries.op9_quality_rules(spark, sf_dir).collect() if not r.base_failed]
    junk, clean = ([r.kept for r in judged if labels.get(r.doc_id) == k] for k in (0, 1))
    assert len(junk) >= 6 and junk.count(True) <= len(junk) // 3
    assert clean.count(False) <= len(clean) // 20


def test_scripts_without_labelled_text_have_shared_limits():
    assert all(Q.BANDS[k].least_byte_chars != Q.BANDS[k].least_byte_chars for k in ("greek", "cyrillic", "other"))
    assert all(Q.BANDS["latin"].least_byte_chars <= Q.BANDS[k].least_byte_chars for k in ("en", "de", "fr", "es"))


def test_short_texts_are_judged_by_wider_bands(spark):
    odd, plain = "zq#x|wv$k", "the river was calm and the old house by the water stood empty all winter while nobody came to see it again"
    rows = [(1, " ".join(odd + str(i) for i in range(22)), "en"), (2, plain, "en"), (3, "same " * 19 + "same", "en")]
    got = {r.doc_id: r for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[2].n_tokens < Q.SHORT_TOKENS and got[2].kept and not got[1].kept and not got[3].kept


def test_fit_gives_the_quantiles_of_clean_text(spark, sf_dir):
    judged = Q.judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    own = sorted(r.chars_per_token for r in judged.collect() if not r.base_failed and r.n_tokens >= Q.SHORT_TOKENS and r.band == "en")
    fitted = Q.fit(judged, 0.0)
    assert fitted["en"].least_chars == pytest.approx(own[0]) and fitted["en"].most_byte_chars == Q.BANDS["en"].most_chars and fitted["greek"] is Q.BANDS["greek"]
