"""Registered queries of the corpus operators, each over its whole table, and the SQL of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landwatch.llm import align, bestfit, dialogue, language, mixing, packing, pii, quality, repeats, simhash, tokens, toxicity, vectors
from landwatch.llm.common import remainder, table

Query = Callable[[SparkSession, str], DataFrame]

#: Longest segment of a packed batch, in words.
MAX_LEN = 2048
#: Shares of all tokens that the mix aims at.
MIX_TARGETS = {"clean": 0.90, "noisy": 0.08, "toxic": 0.02}


def domain_labels(labels: DataFrame) -> DataFrame:
    """doc_id and domain: toxic, else noisy or clean by the quality label."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "noisy").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs, labels.where(remainder("doc_id", 4) != 2))
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return toxicity.scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the texts and languages that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(remainder("doc_id", 3) != 1))
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    return language.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch and slot for every segment of every document; lengths are words."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack(packing.stored_segments(docs, packing.word_count(), MAX_LEN), MAX_LEN)


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms of every document."""
    return pii.digest(pii.personal_data(table(spark, sf_dir, "documents")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate and copies of every document, for target shares of the labelled domains."""
    labels = domain_labels(table(spark, sf_dir, "labels"))
    return mixing.rates(table(spark, sf_dir, "documents"), labels, "domain", MIX_TARGETS)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, each document encoded once."""
    return tokens.section_tokens(table(spark, sf_dir, "documents"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that are covered by a 100-byte string that starts earlier."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), 100)


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and kept flag of every embedding."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and verdict of every document, with cutoffs certified on the labels."""
    columns = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(columns)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle_words=3, max_bits=3)


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, least cost and least audit of every conversation, and a digest of its repaired rows."""
    given = table(spark, sf_dir, "conversations")
    return dialogue.digest(*dialogue.repair(dialogue.damage(given), given.select("conv_id")))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers in every document, with the corpus-wide counts of the linked pairs."""
    return align.align_tokens(table(spark, sf_dir, "documents"))


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence and place for every piece of every document."""
    return bestfit.pack_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_toxicity, op2_language, op3_packing, op4_repeats, op5_vectors, op6_quality, op7_simhash, op8_personal_data, op9_mixing, op10_token_counts,
                                                      op11_conversations, op12_alignment, op13_best_fit)}
ORACLES: dict[str, str] = {"op6_quality": quality.judge_sql(), "op11_conversations": dialogue.digest_sql()}
