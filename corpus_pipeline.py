"""A training-corpus pipeline over ``documents``.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next stage's ``docs``. All but
the last return the columns of documents.

1. quality: rows that a quality rule rejects go.
2. near_duplicates: of each group of linked documents (five-word shingles, Jaccard 0.8 or
   more) the one with the least doc_id stays; rows of one doc_id with different texts are
   documents of their own.
3. pii: personal data is masked in the text.
4. mixing: documents are sampled by probabilities raked to source, language and topic.
5. encode: SentencePiece ids of every text, and the text that they decode to.

Every stage reads whole texts of any length. Nulls, empty and long texts, repeated rows, empty tables and extra columns are handled as
each operator's docstring says; extra columns pass through stages 1 to 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetgrade.llm import jaccard_join, mixing, pii, quality, sentencepiece_bpe
from fleetgrade.session import cut_lineage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_documents(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_per_group(docs, k=5, num=80, den=100)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_documents(docs, sentencepiece_bpe.default_model(), decoded=True)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("encode", encode_stage),
]

# Bootstrapping, raking and token ids have no SQL form; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
