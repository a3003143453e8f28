"""A training corpus from `documents`: toxic ones go, one of each near-duplicate group stays, benchmark leaks go, secrets are masked, sources are mixed.

Cases: documents with a null or empty text pass all stages and take part in the mix with size 0; without labels of both
classes none is toxic; a null doc_id is a document, ordered last in its group of near duplicates; of repeated rows one
stays, if they have words; a null source is a source. Other columns (lang, n_chars, any other) are kept up to the mix, which
has the columns of its own result and the text; n_chars counts the masked text. Empty tables give an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalassa.llm import jaccard, leaks, mixing, scratch, secrets, toxicity


def remove_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.stage(spark, docs, sf_dir)


def deduplicate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.deduplicate(docs)


def decontaminate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return leaks.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def redact_secrets(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document with its text, the words taken of it and where they start in the mix."""
    plan = mixing.mix_sources(docs)
    texts = docs.select(mixing.key().alias("_k"), "text").groupBy("_k").agg(F.first("text").alias("text"))
    return plan.join(texts, F.col("key") == F.col("_k")).select("doc_id", "text", "source", "size", "source_size", "target", "taken", "mix_start")


STAGES = [
    ("toxicity", remove_toxic),
    ("near-duplicates", deduplicate),
    ("decontamination", decontaminate),
    ("secrets", redact_secrets),
    ("mixing", mix),
]

#: The classifier of the first stage is beyond SQL.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.materialize(stage(spark, docs, sf_dir))
    return docs
