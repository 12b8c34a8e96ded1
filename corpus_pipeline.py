"""The corpus pipeline: filter, deduplicate, sanitise, mix and pack the documents of a folder of tables.

Each stage takes (spark, docs, sf_dir) and gets what the stage before it kept, as a stored table.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landwatch.llm import mixing, packing, pii, simhash, toxicity
from landwatch.llm.common import stage, table
from landwatch.llm.queries import MAX_LEN, MIX_TARGETS, domain_labels

#: Documents with at least this toxicity are rejected.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below ``TOXIC``; the classifier is fitted on labelled documents."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    return docs.where(toxicity.score(model)(F.col("text")) < TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a similarity of 0.8 or more on five-word shingles.

    SimHash fingerprints meet in vantage-point trees; every link is checked on the whole texts,
    and an exact search finds the similar texts whose fingerprints are too far apart.
    """
    return simhash.drop_similar(docs, similarity=0.8, shingle_words=5)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data and disclosing terms masked; n_chars follows the new text."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the domains' tokens come near their target shares.

    Stage 1 has removed what is toxic, so that is no domain here; the other targets keep their
    ratio. Priors come from the labels of documents that are still there.
    """
    targets = {d: share for d, share in MIX_TARGETS.items() if d != "toxic"}
    labels = domain_labels(table(spark, sf_dir, "labels")).where(F.col("domain").isin(*targets))
    return mixing.mix(docs, labels.join(docs.select("doc_id"), "doc_id", "left_semi"), "domain", targets)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A batch and slot for every segment; the copies of a document are told apart by nothing but their slots."""
    return packing.pack(packing.stored_segments(docs, packing.word_count(), MAX_LEN), MAX_LEN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_domains),
    ("packing", pack_batches),
]

#: No stage but the word counts can be put in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
