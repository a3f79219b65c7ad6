"""Embeddings by content: each distinct text goes through the model once, whole, and is kept under its hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.scratch import stored
from sparkloom.sources.tables import VersionedTable

from . import chunking
from .models import Embedder, embedding


def store(spark, path: str, buckets: int = 64) -> VersionedTable:
    """A table of vectors by model and content hash, which syncs and backfills can share."""
    return VersionedTable(spark, path, "content", buckets)


def embedded(texts: DataFrame, embedder: Embedder, kept: VersionedTable | None = None, model: str = "default") -> DataFrame:
    """content_hash and vector of every distinct content_hash of `texts` (content_hash, text).

    Texts whose vector `kept` has of this model don't reach the model; new vectors are kept. Null texts count as empty.
    """
    distinct = texts.groupBy("content_hash").agg(F.first("text").alias("text"))
    content = F.concat(F.lit(f"{model}:"), "content_hash")
    old = kept.read() if kept is not None else None
    if old is None:
        fresh = distinct
    else:
        old = old.where(F.col("model") == model)
        fresh = distinct.join(old.select("content_hash"), "content_hash", "left_anti")
    made = stored(fresh.select("content_hash", embedding(embedder)("text").alias("vector")))
    if kept is not None and not made.isEmpty():
        kept.upsert(made.select(content.alias("content"), F.lit(model).alias("model"), "content_hash", "vector"))
    if old is None:
        return made
    return made.unionByName(old.select("content_hash", "vector").join(distinct.select("content_hash"), "content_hash", "left_semi"))


def payloads(chunks: DataFrame, embedder: Embedder, kept: VersionedTable | None = None, model: str = "default") -> DataFrame:
    """id, data, metadata and vector of chunks. The vector is that of the whole text; data and metadata hold excerpts."""
    vectors = embedded(chunks.select("content_hash", "text"), embedder, kept, model)
    rows = chunking.vector_payloads(chunks)
    return rows.join(vectors.withColumnRenamed("content_hash", "__hash"), F.col("metadata.content_hash") == F.col("__hash")).select("id", "data", "metadata", "vector")
