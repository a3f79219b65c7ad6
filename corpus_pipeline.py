"""From documents to token ids: each stage is a Parquet table that the next one reads.

Every stage takes null and empty texts as texts without words, keeps repeated rows as its operator says, gives an empty
table for an empty one and passes columns of any names through (the last one returns its own).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import jaccard, mixing, pieces, secrets, toxicity
from sparkloom.llm.common import documents, free_name, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold; the model learns from the labelled training rows among `docs`.

    Empty texts have scores like others; equal texts stay or go together.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name(docs, "score")
    return toxicity.with_scores(docs, model, column=score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each component of sets of five-word shingles 0.8 or more alike.

    Texts without words stay; of rows with one doc_id and one text a single row stays.
    """
    return jaccard.one_of_each(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the name of its kind in the place of each secret and n_chars counted anew."""
    found = secrets.secret_spans(docs, docs.columns)
    changed = F.size("secret_spans") > 0
    cleaned = found.withColumn("text", secrets.redact(F.col("text"), F.col("secret_spans")))
    return cleaned.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*[f"`{c}`" for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the sources' target weights ask for; texts without words add none and go."""
    return mixing.mix_sources(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and piece_ids of every copy, with an end id each; an empty text has the end id alone."""
    import public_tokenizers

    encoded = pieces.encode_pieces(docs.select("doc_id", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select("doc_id", "source", F.size("piece_ids").cast("long").alias("n_tokens"), "piece_ids")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near duplicates", near_duplicates_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("pieces", pieces_stage),
]

#: The toxicity model and the tokenizer have no SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), spark)
    return docs
