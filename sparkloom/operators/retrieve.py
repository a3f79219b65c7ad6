"""Vector search and the two-stage retrieval on top of it."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import paths

from . import blocks, terms
from .models import Embedder, Scorer, embedding
from .terms import overlap_boost
from .vector_index import VectorIndex

#: Defaults of the retrieval: results, candidates at most, score floors.
TOP_K, POOL, MIN_SCORE, MIN_RERANK = 5, 60, 0.5, 0.0
# Ids of records that aren't chunks.
CONTROL_IDS = ("__manifest__", "__backfill_manifest__")


def clamp_top_k(k: int | None) -> int:
    return min(20, max(1, TOP_K if k is None else int(k)))


def pool_size(k: Column, asked: Column | None = None, cap: int = POOL) -> Column:
    """How many candidates to look at for k results: six times as many, within bounds, unless asked otherwise."""
    usual = F.least(F.lit(cap), F.greatest(6 * k, k + 5))
    return usual if asked is None else F.least(F.lit(cap), F.greatest(k, F.coalesce(F.floor(asked), usual)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similar(queries: DataFrame, vectors: DataFrame, k: int | None = None, floor: float | None = None, query_id: str = "query_id", id_: str = "vec_id", vector: str = "vector") -> DataFrame:
    """query_id, vec_id, score of each query's k best vectors, or of all that reach `floor`.

    Queries and vectors are dealt into tiles; a task scores its tile by matrix products and keeps each query's k best, so
    what is shuffled for the final ranking is small. Nothing is collected. Null vectors are left out; vectors of another
    length than a query's don't meet it.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("vector"))
    rows = vectors.select(F.col(id_).alias("id"), F.col(vector).alias("vector"))
    kinds = (asked.schema["query_id"].dataType.simpleString(), rows.schema["id"].dataType.simpleString())
    found = blocks.nearest(blocks.dealt(asked, rows, k, ("id",)), blocks.compared(floor), k, kinds).withColumnRenamed("id", "vec_id")
    if k is None:
        return found
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k)


def coerced(ann: Column, ce: Column, guarantee: float = 0.5) -> Column:
    """The cross-encoder's score, but the similarity where that is high and the other negative."""
    return F.when((ann > guarantee) & (ce < 0), ann).otherwise(ce)


def best_per_essay(rows: DataFrame, k: int, essay: str = "essay_slug", score: str = "score", tie: str = "vec_id", query: str = "query_id") -> DataFrame:
    """Each query's best row of an essay, then its k best of those."""
    one = F.row_number().over(Window.partitionBy(query, essay).orderBy(F.desc(score), tie))
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), tie))
    return rows.withColumn("__one", one).where("__one = 1").withColumn("rank", rank).where(F.col("rank") <= k).drop("__one")


def retrieve(hits: DataFrame, top_k: int | None = None, min_score: float = MIN_SCORE, rerank: Column | None = None, min_rerank: float = MIN_RERANK) -> DataFrame:
    """From hits (query_id, vec_id, essay_slug, body, terms, score) to each query's results.

    Floor, second score, its floor, boost by query terms, best of each essay, top k. Vectors are never returned.
    """
    k = clamp_top_k(top_k)
    rows = hits.where(F.col("score") >= min_score)
    if rerank is not None:
        rows = rows.withColumn("score", coerced(F.col("score"), rerank)).where(F.col("score") >= min_rerank)
    heading = F.col("heading") if "heading" in hits.columns else None
    rows = rows.withColumn("score", F.round(F.col("score") + overlap_boost(F.col("terms"), F.col("body"), heading), 6))
    return best_per_essay(rows, k)


def chunks_of_hits(hits: DataFrame) -> DataFrame:
    """From hits (id, score, metadata and others) to chunks: metadata unpacked, what is missing filled in.

    Control records and pre-examined essays are left out. A missing text, slug or path is empty, a missing index 0, a
    missing score 0; a missing heading stays null. A hit without metadata is a chunk with all of that.
    """
    rows = hits.where(~F.col("id").isin(*CONTROL_IDS))
    some = lambda name, usual: F.coalesce(F.col(f"metadata.{name}"), F.lit(usual)).alias(name)
    rest = [c for c in hits.columns if c not in ("metadata", "score")]
    rows = rows.select(*rest, some("essay_slug", ""), some("essay_path", ""), F.col("metadata.heading").alias("heading"), some("chunk_index", 0), F.coalesce("metadata.text", F.lit("")).alias("body"), F.coalesce("score", F.lit(0.0)).alias("score"))
    return rows.where(~F.col("essay_path").startswith(paths.PRE_EXAMINED.rstrip("/")))


def checked_request(query: object, top_k: object = None, min_score: object = None, rerank: object = None, candidate_pool: object = None) -> dict:
    """A request's values: the query must have 1 to 2000 characters; others of a wrong type count as not given."""
    if not isinstance(query, str) or not 1 <= len(query) <= 2000:
        raise ValueError("query must be 1\u20132000 characters")
    number = lambda x, usual: x if isinstance(x, int | float) and not isinstance(x, bool) else usual
    return {"query": query, "top_k": clamp_top_k(number(top_k, TOP_K)), "min_score": number(min_score, MIN_SCORE), "rerank": rerank if isinstance(rerank, bool) else True, "candidate_pool": number(candidate_pool, None)}


def search(queries: DataFrame, vectors: DataFrame, glossary: DataFrame, embedder: Embedder, top_k: int | None = None, min_score: float = MIN_SCORE, scorer: Scorer | None = None, min_rerank: float = MIN_RERANK, pool: int | None = None, index: VectorIndex | None = None) -> tuple[DataFrame, DataFrame]:
    """The whole retrieval of queries (query_id, query) from vectors (id, vector, metadata): results, candidates.

    Queries are expanded by the glossary and embedded, the pool's nearest chunks are the candidates; those above the
    floor are scored by the cross-encoder if there is one, boosted by the query's own terms and cut to each essay's best.
    With an index the candidates are those that it finds, else all vectors are compared.
    """
    k = clamp_top_k(top_k)
    aliases = terms.short_aliases(glossary)
    asked = terms.expand_queries(queries, glossary, aliases).withColumn("vector", embedding(embedder)("expanded"))
    size = min(POOL, max(k, pool)) if pool is not None else min(POOL, max(6 * k, k + 5))
    sought = asked.select("query_id", "vector")
    near = similar(sought, vectors, size, id_="id").withColumnRenamed("vec_id", "id") if index is None else index.search(sought, vectors, size)
    near = near.drop("rank")
    found = chunks_of_hits(near.join(vectors.select("id", "metadata"), "id")).withColumnRenamed("id", "vec_id")
    candidates = best_per_essay(found, max(k, size))
    hits = found.join(asked.select("query_id", "expanded"), "query_id").join(terms.query_terms(queries, glossary, aliases).select("query_id", "terms"), "query_id")
    second = None
    if scorer is not None:
        hits = hits.where(F.col("score") >= min_score).withColumn("second", scorer(F.col("expanded"), F.col("body")))
        second = F.col("second")
    results = retrieve(hits, k, min_score, second, min_rerank)
    return results.drop("second", "expanded", "terms"), candidates


class Retrieval(NamedTuple):
    """The chunks that answer, the nearest ones before any second score, and what is said about them."""

    chunks: DataFrame
    ann_chunks: DataFrame
    meta: dict


#: Statuses of a manifest without an index to search.
WITHOUT_INDEX = ("no_index", "sync_failed")


def retrieval(header: dict, stale: bool, queries: DataFrame, vectors: DataFrame, glossary: DataFrame, embedder: Embedder, bi_encoder: str, rerank_model: str | None = None, scorer: Scorer | None = None, **options: object) -> Retrieval:
    """A search as the manifest's header allows it, with its metadata.

    Without an index, or after a failed sync, there are no chunks, and no query is embedded. An index that the corpus has
    left behind is searched all the same and called stale. The model named is the one that scored last.
    """
    rerank = scorer is not None
    meta = {"index_status": "stale" if stale and header["status"] not in WITHOUT_INDEX else header["status"], "manifest_digest": header.get("manifest_digest"), "stale": stale, "bi_encoder_model": bi_encoder, "rerank_model": rerank_model if rerank else None, "rerank": rerank, "model": rerank_model if rerank and rerank_model else bi_encoder}
    if header["status"] in WITHOUT_INDEX:
        queries, vectors = queries.limit(0), vectors.limit(0)
    return Retrieval(*search(queries, vectors, glossary, embedder, scorer=scorer, **options), meta)


def confident(top: Column, reranked: bool, floor: float = MIN_RERANK) -> Column:
    return F.coalesce(top >= (floor if reranked else MIN_SCORE), F.lit(False))


def index_meta(status: Column, stale: Column, rerank_model: Column, bi_encoder: Column) -> Column:
    return F.struct(F.when(stale, "stale").otherwise(status).alias("index_status"), F.coalesce(rerank_model, bi_encoder).alias("model"))
