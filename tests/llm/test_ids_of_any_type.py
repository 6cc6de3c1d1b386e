"""Ids need not be numbers: every operator passes them on as they are."""

import public_tokenizers
from pyspark.sql import functions as F

from photolith.llm import bpe, chat, decontaminate, language_id, maxent, near_dup, pii, quality, url_rules, warc


def test_text_ids(spark):
    rows = [("a>b", "one two three four five six a@b.de"), (None, "x y z"), ("none", None), ("7", "one two three four five six a@b.de")]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id string, text string, lang string")
    items = spark.createDataFrame([("i", "two three four")], "item_id string, text string")
    want = sorted((r[0] for r in rows), key=str)
    found = (
        pii.find(docs), bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json")), quality.judge(docs), language_id.identify(docs), maxent.score(docs), near_dup.classes(docs),
        decontaminate.find(docs, items), decontaminate.find(docs, items.unionByName(items), block_words=1),
    )
    for out in found:
        assert sorted((r[0] for r in out.select("doc_id").collect()), key=str) == want
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a.com/").alias("url"), F.col("text").alias("html"))
    assert sorted((r.page_id for r in url_rules.judge(pages).collect()), key=str) == want
    read = {r.page_id: r.refers_to for r in warc.write_and_read(pages).collect()}
    assert read == {"a>b": "7", "7": None, "none": None, None: None}
    turns = docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), "text")
    assert sorted((r.conv_id for r in chat.digests(chat.format_conversations(turns)).collect()), key=str) == want
