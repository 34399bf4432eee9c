"""Documents to token ids through five operators: toxic ones go, one of each near-duplicate group
stays, personal data is masked, sources are mixed to their targets, and texts are encoded."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formwork.llm import bpe, jaccard, mixing, personal, toxicity
from formwork.llm.common import scratch, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labelled ones, doesn't reject."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8."""
    return jaccard.keep_one(docs, n=5, percent=80)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, spans of personal data replaced by their kinds; ``n_chars`` follows the text."""
    return personal.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` of each row."""
    ids = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]
#: SQL expresses neither the trained models nor the join on whole tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` through all stages, each written and read again; what a stage wrote on its way
    and what it read are deleted once its result is written."""
    docs = table(spark, sf_dir, "documents")
    with scratch() as kept:
        for _, stage in STAGES:
            docs = kept(written(stage(spark, docs, sf_dir)))
    return docs
