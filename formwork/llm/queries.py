"""The registered queries of this subpackage: one for each operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formwork.llm import alignment, bpe, jaccard, licences, mixing, neighbours, personal, quality, toxicity, urls, whitening, windows
from formwork.llm.common import table


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors to each whose id is divisible by 50."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and the log-likelihood ratio's verdict for all documents."""
    found = quality.resemblance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op3_licence_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in all documents."""
    return licences.scan(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of all documents, by a model of the labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.grade(docs, model).select("doc_id", "severity", "grade", "rejected")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in a mix of sources that weigh 3, 1, 2 in turn."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of 35-word windows that occur twice."""
    return windows.remove_repeated_words(table(spark, sf_dir, "documents"), whole=False)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents to token ids and back."""
    path = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    digest = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(ids).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a similarity of 0.9 or more."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), 3, 90)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 200-byte strings that occur twice."""
    return windows.remove_repeated_bytes(table(spark, sf_dir, "documents"), whole=False)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in all documents."""
    found = personal.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    secrets = F.size(F.filter("spans", lambda s: s["kind"] == "secret")).cast("long").alias("n_secret")
    return found.select("doc_id", *map(count, personal.KINDS[:4]), F.sha2(F.encode(listed(base), "UTF-8"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), secrets)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 4 whitened coordinates of all embeddings."""
    found = whitening.whitened(table(spark, sf_dir, "embeddings"), 4)
    return found.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all pages' URLs."""
    return urls.judged(table(spark, sf_dir, "pages"))


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens in all documents."""
    found = alignment.aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") != "", F.sha2(F.encode("groups", "UTF-8"), 256)).otherwise("")
    return found.select("*", digest.alias("groups_sha256")).drop("groups")


QUERIES = {
    "op1_nearest_neighbours": op1_nearest_neighbours,
    "op2_quality_rules": op2_quality_rules,
    "op3_licence_scans": op3_licence_scans,
    "op4_toxicity": op4_toxicity,
    "op5_mixing": op5_mixing,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_bpe": op7_bpe,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_personal_data": op10_personal_data,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_url_filters": op12_url_filters,
    "op13_cross_tokenizer_alignment": op13_cross_tokenizer_alignment,
}
