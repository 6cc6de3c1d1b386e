"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. The first four return rows with the columns of `documents`; the last one
token ids and the digest of their decoding.

* `quality` drops what the quality rules reject.
* `near_duplicates` keeps of each class the document with the smallest id.
* `decontamination` drops documents contaminated with the benchmark.
* `personal_data` replaces personal data in the texts by the name of its kind, and sets n_chars anew.
* `token_ids` encodes the texts and decodes the ids; what they decode to is returned as a digest.

Defined cases: rows with null or empty texts fail the quality rules; rows that repeat an id with the same text are one
class, of which the rows with its smallest id stay; an empty table goes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolith.llm import bpe, decontaminate, near_dup, pii, quality
from photolith.llm._bytes import read, spread
from photolith.llm._store import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs).select(*COLUMNS)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def token_ids_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("token_ids", token_ids_stage),
]

#: SQL can't express the tokenisers' measures, the near-duplicate classes and the encoding; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each but the last written to the shared folder and read again."""
    docs = spread(read(spark, sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
